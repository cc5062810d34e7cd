"""Oversized texts in ordered pieces under a limit, cut where the topic changes.

Lexical cohesion: at each claim or sentence end the words before and after it are
compared; a low similarity between higher ones is a valley, and the deepest valley
of each size window is where the text is cut. Word ends, then any place, serve
where a window holds no such end. Each further piece starts with the last
``overlap`` characters of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Ends of claims: before a numbered claim on a new line. Other line ends are as good as sentence ends.
_CLAIM = re.compile(r"\s*\n\s*(?=(?:\d{1,3}\s*[.．)]|【|제\s*\d+\s*항|請求項))")
_SENTENCE = re.compile(r"(?:[.!?;](?=\s)|[。．！？；])[\"'”’)\]]*\s*|\s*\n\s*")
_WORD = re.compile(r"\s+")
_TERM = re.compile(r"[A-Za-z0-9]+|[가-힣]+|[぀-ヿ㐀-鿿]")
_COMBINING = re.compile(r"[̀-ͯᅠ-ᇿ⃐-゙゚⃰️‍]")
#: Words compared on either side of a boundary.
BLOCK = 40


def _ends(rx: re.Pattern, text: str, ok: bool = True) -> np.ndarray:
    return np.array([m.end() for m in rx.finditer(text)] if ok else [], dtype=np.int64)


def _similarity(ids: np.ndarray, at: np.ndarray, chunk: int = 2000) -> np.ndarray:
    """Cosine of the word counts of the blocks before and after each place in ``at``.

    The product of two blocks' counts is the number of equal pairs of words, so
    each place costs the square of a block, whatever the vocabulary.
    """
    wide = np.concatenate([np.full(BLOCK, -1), ids, np.full(BLOCK, -2)])
    out = np.zeros(len(at))
    step = np.arange(BLOCK)
    pairs = lambda x, y: ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).sum((1, 2)).astype(float)
    for i in range(0, len(at), chunk):
        t = at[i : i + chunk, None]
        a, b = wide[t + step], wide[t + BLOCK + step]
        norm = np.sqrt(pairs(a, a) * pairs(b, b))
        out[i : i + chunk] = np.divide(pairs(a, b), norm, out=np.zeros(len(norm)), where=norm > 0)
    return out


def _depths(sim: np.ndarray) -> np.ndarray:
    """How far each similarity lies below the nearest peaks on its two sides, in one pass each way."""

    def peaks(x: list[float]) -> list[float]:
        out: list[float] = []
        for i, v in enumerate(x):
            out.append(out[-1] if i and x[i - 1] >= v else v)
        return out

    x = sim.tolist()
    return np.array(peaks(x)) + np.array(peaks(x[::-1])[::-1]) - 2 * sim if x else np.zeros(0)


def cut(text: str, limit: int = 3000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces of ``text``: ``text[start:end]`` has at most ``limit`` characters.

    kind names the end: claim, sentence, word, none or last. A text within the
    limit is one piece; an empty one has none. The deepest valley among the claim
    and sentence ends of a window's second half is cut at (of equally deep ones a
    claim end, then the last), else of its first half, else the last word end; a
    window without any end is cut at the limit, but not before a combining
    character.
    """
    if limit <= 2 * overlap:
        raise ValueError("the limit must be more than twice the overlap")
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n, "last")]
    claims, sentences, words = _ends(_CLAIM, text), _ends(_SENTENCE, text), _ends(_WORD, text)
    natural = np.unique(np.concatenate([claims, sentences]))
    terms = list(_TERM.finditer(text))
    starts = np.array([m.start() for m in terms], dtype=np.int64)
    vocab: dict[str, int] = {}
    ids = np.array([vocab.setdefault(m.group().lower(), len(vocab)) for m in terms], dtype=np.int64)
    is_claim = np.isin(natural, claims)
    depth = np.round(_depths(_similarity(ids, np.searchsorted(starts, natural))), 9) if len(natural) else np.zeros(0)
    out: list[tuple[int, int, str]] = []
    at, head = 0, 0  # first new character of the piece; its repeated characters start at head
    while n - head > limit:
        last = head + limit
        half = at + (last - at) // 2
        place, kind = 0, "none"
        upper = np.searchsorted(natural, last, side="right")
        for low in (half, at + overlap):
            near = np.arange(np.searchsorted(natural, low, side="right"), upper)
            if len(near):
                best = near[np.lexsort((-natural[near], ~is_claim[near], -depth[near]))[0]]
                place, kind = int(natural[best]), "claim" if is_claim[best] else "sentence"
                break
        if not place:
            w = int(np.searchsorted(words, last, side="right")) - 1
            place, kind = (int(words[w]), "word") if w >= 0 and words[w] > at + overlap else (last, "none")
            if kind == "none":
                while place > at + 1 and _COMBINING.match(text[place]):
                    place -= 1
        out.append((head, place, kind))
        at, head = place, place - overlap
    out.append((head, n, "last"))
    return out


def pieces(items: DataFrame, limit: int = 3000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """(tbl, item_id, piece_no, n_pieces, start_pos, end_pos, cut_kind[, piece]) of items longer than ``limit``.

    ``items``: (tbl, item_id, text). Lengths are code points. Null, empty and short
    texts have no pieces. Repeated rows come out once per distinct text. Only the
    oversized texts leave the JVM, whole, in Arrow batches.
    """
    long = items.where(F.length("text") > limit).select("tbl", "item_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tbl, item, text in b.itertuples(index=False):
                found = cut(text, limit, overlap)
                out += [(tbl, item, k, len(found), s, e, kind, text[s:e] if with_text else None) for k, (s, e, kind) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["tbl", "item_id", "piece_no", "n_pieces", "start_pos", "end_pos", "cut_kind", "piece"])

    made = long.mapInPandas(run, "tbl string, item_id string, piece_no int, n_pieces int, start_pos int, end_pos int, cut_kind string, piece string")
    return made.distinct() if with_text else made.drop("piece").distinct()
