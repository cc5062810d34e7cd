"""Near-duplicate texts with small edits, by multi-index hashing of fingerprints.

A text's words (split at blanks, counted with repeats: the n-th occurrence of a
word is a word of its own) give a fingerprint of two-bit minimum hashes, cut into
segments (``design``). A segment of one text is looked up in the table of that
segment together with its Hamming ball of radius 1; what the tables give is verified
by the complete Hamming distance, then by the exact overlap of words.

The balls are never shuffled: of two segments that differ in one bit at most, one
half is equal, so each segment is sent to two places, one for each half, and a ball
is enumerated where it lies, over the other half. Every row carries a check word of
128 one-bit minimum hashes, so that most of what meets by chance is told on the spot.

``design`` takes so many segments that a pair just at the threshold is missed with a
probability of a tenth of one in the number of texts: with at most one such pair a
text, fewer than a tenth of a pair is expected to be lost in a whole collection of
any size, and pairs above the threshold are missed far less often.

Equal texts are one text throughout; their rows are joined back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.keys import doc_key, has_value
from loomgraph.operators.components import components
from loomgraph.session import materialize, release, spread

#: Characters of text, rows of cells and pairs that a task looks at together: bounds of memory, not of what is found.
_CHUNK, _ROWS, _PAIRS = 500_000, 400_000, 2_000_000
#: Rows of cells that lie in the shuffle at one time, more are made segment by segment (8 at least); texts that a task holds to verify.
_CELLS, _HELD = 5_000_000, 20_000
#: Texts that lie in the shuffle at one time, of more a quarter at least.
_TEXTS = 250_000
#: Bits of the check word.
CHECK = 128


@dataclass(frozen=True)
class Design:
    """Fingerprints of ``segments`` x ``width`` bits; ``reach`` and ``reach_check`` are the largest distances kept."""

    threshold: float
    width: int
    segments: int
    reach: int
    reach_check: int

    @property
    def hashes(self) -> int:
        return max(CHECK, self.width // 2 * self.segments)


def design(n_texts: int, threshold: float = 0.85, miss: float | None = None) -> Design:
    """Segments as wide as log2 of the number of texts, and as many as recall needs.

    At overlap t the Jaccard similarity is J >= t / (2 - t); a minimum hash differs
    with probability 1 - J, and then its two bits are anything. ``miss`` is the
    largest probability that a pair just at the threshold is found in no segment
    (default 0.1 / n_texts). Both reaches lie six standard deviations beyond the
    mean distance of such a pair.
    """
    j = threshold / (2 - threshold)
    m = max(10, min(20, math.ceil((math.log2(max(2, n_texts)) + 3) / 2)))
    same, one = j + (1 - j) / 4, (1 - j) / 2
    hit = same**m + m * one * same ** (m - 1)
    segments = max(4, math.ceil(math.log(miss or 0.1 / max(2, n_texts)) / math.log(1 - hit)))
    q, n = (1 - j) / 2, m * segments
    variance = (1 - j) * 1.5 - (1 - j) ** 2
    return Design(threshold, 2 * m, segments, math.ceil((1 - j) * n + 6 * math.sqrt(n * variance)), math.ceil(CHECK * q + 6 * math.sqrt(CHECK * q * (1 - q))))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of a public hash, MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word, occurrence) of all texts in a row, and the number of words of each text."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words])
    flat = [x for w in words for x in w]
    if not flat:
        return np.zeros(0, np.uint64), sizes
    codes, vocab = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(vocab, categorize=False)[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    by = np.lexsort((codes, owner))  # stable, so the n-th of equal words is the n-th of its run
    fresh = np.ones(len(by), bool)
    fresh[1:] = (codes[by][1:] != codes[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    at = np.arange(len(by))
    nth = np.empty(len(by), np.uint64)
    nth[by] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return _mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), sizes


def fingerprints(texts: list[str], d: Design) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(segments, check words, sorted word hashes) of each text; texts without words must not be given."""
    flat, sizes = _tokens(texts)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    odd = (_mix(np.arange(1, d.hashes + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = _mix(np.arange(1, d.hashes + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).astype(np.uint32)
    m, segs, check = d.width // 2, np.zeros((len(texts), d.segments), np.int64), np.zeros((len(texts), 2), np.uint64)
    for k in range(d.hashes):
        least = _mix(np.minimum.reduceat((short ^ shift[k]) * odd[k], starts).astype(np.uint64) + np.uint64(k))
        if k < m * d.segments:
            segs[:, k // m] |= (least & np.uint64(3)).astype(np.int64) << np.int64(2 * (k % m))
        if k < CHECK:
            check[:, k // 64] |= ((least >> np.uint64(2)) & np.uint64(1)) << np.uint64(k % 64)
    signed = flat.view(np.int64)
    return segs, check.view(np.int64), [np.sort(signed[a : a + n]) for a, n in zip(starts, sizes, strict=True)]


def sketch(texts: DataFrame, d: Design) -> DataFrame:
    """(nid, side, segs, check, words) of (nid, text, side); whole texts, in Arrow batches. Segments of at most 31 bits take four bytes each."""
    small = d.width < 32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["text"].str.strip().str.len() > 0]
            size = b["text"].str.len().cumsum() // _CHUNK  # bounds the memory of long texts
            for _, part in b.groupby(size, sort=False):
                segs, check, words = fingerprints(part["text"].tolist(), d)
                yield pd.DataFrame({"nid": part["nid"], "side": part["side"], "segs": list(segs.astype(np.int32) if small else segs), "check": list(check), "words": words})

    return texts.select("nid", "side", "text").mapInPandas(run, f"nid bigint, side int, segs array<{'int' if small else 'bigint'}>, check array<bigint>, words array<bigint>")


def _cells(s: DataFrame, d: Design, first: int, many: int) -> DataFrame:
    """(cell, other, nid, side, n, c0, c1): each of ``many`` segments from ``first`` on twice, under either half; even numbers of place are first halves."""
    h = d.width // 2
    low, high = F.expr(f"code & {(1 << h) - 1}L"), F.expr(f"shiftright(cast(code as bigint), {h})")
    place = lambda half, value: F.expr(f"shiftleft(cast(2 * (k + {first}) + {half} as bigint), {h})").bitwiseOR(value)
    code = s.select("nid", "side", F.size("words").alias("n"), F.col("check")[0].alias("c0"), F.col("check")[1].alias("c1"), F.posexplode(F.slice("segs", first + 1, many)).alias("k", "code"))
    both = F.explode(F.array(F.struct(place(0, low).alias("cell"), high.alias("other")), F.struct(place(1, high).alias("cell"), low.alias("other"))))
    return code.select("nid", "side", "n", "c0", "c1", both.alias("x")).select("x.cell", "x.other", "nid", "side", "n", "c0", "c1")


def _meetings(rows: pd.DataFrame, d: Design, between: bool) -> Iterator[pd.DataFrame]:
    """(a, b) with a < b of rows, sorted by cell and other, whose segments differ by one bit at most and whose check words and lengths fit."""
    h = d.width // 2
    cell, other = rows["cell"].to_numpy(), rows["other"].to_numpy()
    nid, side, size = rows["nid"].to_numpy(), rows["side"].to_numpy(), rows["n"].to_numpy()
    c0, c1 = rows["c0"].to_numpy().view(np.uint64), rows["c1"].to_numpy().view(np.uint64)  # signed numbers would be counted by their size
    group = np.concatenate([[0], np.cumsum(cell[1:] != cell[:-1])]).astype(np.int64)
    key = (group << np.int64(h)) | other
    n = len(key)
    end = np.searchsorted(key, key, side="right")
    at = np.arange(n)
    first_half = (cell >> np.int64(h)) & 1 == 0
    looks = [(at[first_half], at[first_half] + 1, end[first_half])]  # equal segments, once
    for bit in range(h):
        i = at[(other >> np.int64(bit)) & 1 == 1]  # the one with the bit looks for the one without
        want = key[i] ^ np.int64(1 << bit)
        lo = np.searchsorted(key, want)
        hit = (lo < n) & (key[np.minimum(lo, n - 1)] == want)
        looks.append((i[hit], lo[hit], end[lo[hit]]))
    for i, lo, hi in looks:
        many = hi - lo
        upto = np.cumsum(many)
        done = 0
        while done < len(i):
            base = upto[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(upto, base + _PAIRS, side="right")))
            left, right = np.repeat(i[done:stop], many[done:stop]), np.repeat(lo[done:stop], many[done:stop])
            right = right + np.arange(len(right)) - np.repeat(upto[done:stop] - many[done:stop] - base, many[done:stop])
            far = np.bitwise_count(c0[left] ^ c0[right]) + np.bitwise_count(c1[left] ^ c1[right])
            x, y = size[left], size[right]  # the longer text shares at most all words of the shorter
            keep = (far <= d.reach_check) & (np.minimum(x, y) >= d.threshold * np.maximum(x, y) - 1e-9)
            if between:
                x, y = side[left], side[right]
                keep &= ((x & 1 > 0) & (y & 2 > 0)) | ((x & 2 > 0) & (y & 1 > 0))
            a, b = nid[left[keep]], nid[right[keep]]
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            done = stop


def candidates(s: DataFrame, d: Design, between: bool, n_texts: int = 0) -> DataFrame:
    """(a, b) once each, a < b; rows of one cell lie in one task, sorted, and are looked at cell by cell.

    Of many texts a few segments are taken at a time, so that the shuffle holds the cells of these only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= _ROWS:
                whole = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(whole["cell"].to_numpy(), whole["cell"].iloc[-1]))
                if last:
                    yield from _meetings(whole.iloc[:last], d, between)
                held = [whole.iloc[last:]]
                size = len(whole) - last
        if size:
            yield from _meetings(pd.concat(held, ignore_index=True), d, between)

    many = min(d.segments, max(8, _CELLS // (2 * max(1, n_texts))))
    parts = []
    for first in range(0, d.segments, many):
        rows = _cells(s, d, first, many).repartition("cell").sortWithinPartitions("cell", "other")
        met = rows.mapInPandas(run, "a bigint, b bigint").distinct()
        parts.append(materialize(met, "met"))
    if len(parts) == 1:
        return parts[0]
    out = materialize(_all(parts).distinct(), "candidates")
    release(*parts)
    return out


def _together(met: DataFrame, s: DataFrame, columns: list[str], look, schema: str) -> DataFrame:
    """What ``look`` gives of pairs (a, b) with ``columns`` of their texts.

    Pairs that hang together mostly have one least neighbour; they are looked at in
    one place, to which each of their texts is sent once, however many pairs it is in.
    """
    both = met.select("a", "b").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
    places = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), low.count() // _HELD + 1)
    put = met.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b").select("a", "b", F.pmod(F.xxhash64(F.least("la", "lb")), F.lit(places)).alias("place"))
    put = materialize(put, "places")
    need = put.select(F.col("place").alias("at"), F.explode(F.array("a", "b")).alias("nid")).distinct()
    texts = need.join(s.select("nid", *columns), "nid")
    out = materialize(put.groupBy("place").cogroup(texts.groupBy("at")).applyInPandas(look, schema), "looked")
    release(low, put)
    return out


def _at(pairs: pd.DataFrame, held: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """``held`` by nid, and where the ends of ``pairs`` stand in it."""
    held = held.sort_values("nid", ignore_index=True)
    nid = held["nid"].to_numpy()
    return held, np.searchsorted(nid, pairs["a"].to_numpy()), np.searchsorted(nid, pairs["b"].to_numpy())


def _verified(met: DataFrame, s: DataFrame, d: Design) -> DataFrame:
    """(a, b, side_a, side_b, overlap) of the pairs of ``met`` within the complete distance, then the exact overlap; only what is within the distance has its words sent."""

    def distance(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held, x, y = _at(pairs, held)
        segs = np.stack(held["segs"].to_numpy()) if len(held) else np.zeros((0, d.segments), np.int64)
        step = max(1, 16 * _ROWS // d.segments)  # segments compared at once
        near = [np.bitwise_count(segs[x[i : i + step]] ^ segs[y[i : i + step]]).sum(axis=1, dtype=np.int64) <= d.reach for i in range(0, len(x), step)]
        return pairs.loc[np.concatenate(near) if near else np.zeros(0, bool), ["a", "b"]]

    def overlap(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held, x, y = _at(pairs, held)
        nid, side, words = held["nid"].to_numpy(), held["side"].to_numpy(), held["words"].to_numpy()
        size = held["words"].str.len().to_numpy(np.int64)
        shared = np.array([len(np.intersect1d(words[i], words[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
        share = shared / np.maximum(size[x], size[y])
        keep = share >= d.threshold
        x, y = x[keep], y[keep]
        return pd.DataFrame({"a": nid[x], "b": nid[y], "side_a": side[x], "side_b": side[y], "overlap": share[keep]})

    close = _together(met, s, ["segs"], distance, "a bigint, b bigint")
    near = _together(close, s, ["side", "words"], overlap, "a bigint, b bigint, side_a int, side_b int, overlap double")
    release(close)
    return near


def near_texts(texts: DataFrame, threshold: float = 0.85, between: bool = False) -> DataFrame:
    """(text_a, text_b, overlap): different texts near the same, each pair once.

    ``texts``: (text_id, text, side), text_id unique. ``side`` is a bit set; with
    ``between``, only pairs of a text with bit 1 and a text with bit 2 are looked
    for (text_a has bit 1), else all pairs (text_a < text_b). overlap is the share
    of the words of the longer text that stand in the other too.
    """
    return near_sketches(*sketches(texts, threshold), between)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sketches(texts: DataFrame, threshold: float = 0.85, **notes: Column) -> tuple[Design, int, list[DataFrame], list[DataFrame]]:
    """(design, number of texts, sketches, names) of ``texts`` as of ``near_texts``; names (nid, text_id, side) and ``notes`` are told from each text while it is there.

    Whole texts are the largest part, so of many a quarter is taken at a time, told by the hash of text_id: that much of them lies in a shuffle or a stage.
    """
    n = texts.select("text_id").count()
    d, slices = design(n, threshold), min(4, n // _TEXTS + 1)
    held, names = [], []
    for i in range(slices):
        part = texts if slices == 1 else texts.where(F.pmod(F.xxhash64("text_id"), F.lit(slices)) == i)
        part = materialize(part.withColumn("nid", F.monotonically_increasing_id() * slices + i), "texts")  # written once, so the numbers stay
        held.append(materialize(sketch(spread(part), d), "sketches"))
        names.append(materialize(part.select("nid", "text_id", "side", *(c.alias(k) for k, c in notes.items())), "names"))
        release(part)  # each stage goes once the next one is written
    return d, n, held, names


def near_sketches(d: Design, n: int, held: list[DataFrame], named: list[DataFrame], between: bool = False) -> DataFrame:
    """What ``near_texts`` gives of the texts of ``sketches``, whose stages of sketches go."""
    s, names = _all(held), _all(named).select("nid", "text_id")
    met = candidates(s, d, between, n)
    near = _verified(met, s, d)
    release(*held, met)
    named = near.join(names.toDF("a", "text_a"), "a").join(names.toDF("b", "text_b"), "b")
    if not between:
        return named.select(F.least("text_a", "text_b").alias("text_a"), F.greatest("text_a", "text_b").alias("text_b"), "overlap")
    one = named.where("side_a & 1 > 0 and side_b & 2 > 0").select("text_a", "text_b", "overlap")
    return one.unionByName(named.where("side_b & 1 > 0 and side_a & 2 > 0").select(F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b"), "overlap"))


def distinct_texts(df: DataFrame, id_col: str, fields: list[str], side: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (field_name, id, text_id) of fields with a value, texts (text_id, text, side).

    A text that a third of all rows hold leaves each map task as one row.
    """
    rows = None
    for f in fields:
        part = df.where(has_value(f)).select(F.lit(f).alias("field_name"), F.col(id_col).alias("id"), F.sha2(F.col(f), 256).alias("text_id"), F.col(f).alias("text"), (F.lit(3) if side is None else side).alias("side"))
        rows = part if rows is None else rows.unionByName(part)
    texts = rows.groupBy("text_id").agg(F.first("text").alias("text"), F.bit_or("side").alias("side"))
    return rows.drop("text"), texts


def near_records(df: DataFrame, id_col: str, key_col: str, fields: list[str], threshold: float = 0.85) -> DataFrame:
    """(id_a, id_b, field_name, overlap): rows with different keys near the same in one field.

    id_a < id_b, one row per pair and field. Keys compare without letter case and
    outer blanks; a row without key is no pair with another one without key.
    Fields without a value (null, empty, blank, stand-in) are near nothing.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(doc_key(key_col), F.lit("")).alias("key"), *fields)
    rows, texts = distinct_texts(base, "id", fields)
    close = near_texts(texts, threshold)
    same = rows.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("text_id").alias("text_a"), F.col("text_id").alias("text_b"), F.lit(1.0).alias("overlap"))
    links = close.unionByName(same)
    keyed = rows.drop("side").join(base.select("id", "key"), "id")
    a = keyed.toDF(*[f"{c}_a" for c in keyed.columns])
    b = keyed.toDF(*[f"{c}_b" for c in keyed.columns])
    full = links.join(a, F.col("text_a") == F.col("text_id_a")).join(b, (F.col("text_b") == F.col("text_id_b")) & (F.col("field_name_a") == F.col("field_name_b")))
    full = full.where("key_a <> key_b and (text_a <> text_b or id_a < id_b)")
    return full.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.col("field_name_a").alias("field_name"), "overlap")


def near_classes(df: DataFrame, id_col: str, key_col: str, fields: list[str], threshold: float = 0.85) -> DataFrame:
    """(id, class_id, class_size, n_links): every row of ``df`` with its class under the rule of ``near_records``.

    Two rows are in one class if a chain of pairs of ``near_records`` leads from one
    to the other; class_id is the least id of the class. n_links counts the pairs a
    row stands in, field by field. No pair of rows is made: rows hang on their
    texts, and a pair of texts is a link unless all rows of both have one key.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(doc_key(key_col), F.lit("")).alias("key"), *fields)
    rows, texts = distinct_texts(base, "id", fields)
    rows = materialize(rows.drop("side").join(base.select("id", "key"), "id").distinct(), "rows")
    units = materialize(rows.groupBy("field_name", "text_id", "key").agg(F.count(F.lit(1)).alias("n")), "units")
    whole = units.groupBy("field_name", "text_id").agg(F.sum("n").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    close = near_texts(texts, threshold).select("text_a", "text_b")
    end = lambda x: whole.select("field_name", F.col("text_id").alias(f"text_{x}"), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    links = close.join(end("a"), "text_a").join(end("b"), ["field_name", "text_b"])
    links = materialize(links.where("low_a <> high_a or low_b <> high_b or low_a <> low_b").select("field_name", "text_a", "text_b"), "links")
    node = lambda c: F.concat_ws(":", F.lit("t"), "field_name", c)
    live = links.select(node("text_a").alias("t")).unionByName(links.select(node("text_b").alias("t"))).unionByName(whole.where("low <> high").select(node("text_id").alias("t"))).distinct()
    member = rows.select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("a"), node("text_id").alias("t")).join(live, "t", "left_semi").select("a", F.col("t").alias("b"))
    comp = components(member.unionByName(links.select(node("text_a").alias("a"), node("text_b").alias("b"))), "a", "b")
    kind = dict(df.dtypes)[id_col]
    of = comp.where("node like 'r:%'").select(F.expr(f"cast(substr(node, 3) as {kind})").alias("id"), "component")
    first = of.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # Partners of a unit: rows of its own text and of its near texts, less those with its key.
    both = links.unionByName(links.select("field_name", F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b"))).unionByName(whole.where("low <> high").select("field_name", F.col("text_id").alias("text_a"), F.col("text_id").alias("text_b")))
    other = whole.select("field_name", F.col("text_id").alias("text_b"), F.col("n").alias("n_b"))
    same_key = units.select("field_name", F.col("text_id").alias("text_b"), "key", F.col("n").alias("n_k"))
    met = units.select("field_name", F.col("text_id").alias("text_a"), "key").join(both, ["field_name", "text_a"]).join(other, ["field_name", "text_b"]).join(same_key, ["field_name", "text_b", "key"], "left")
    partners = met.groupBy("field_name", F.col("text_a").alias("text_id"), "key").agg(F.sum(F.col("n_b") - F.coalesce("n_k", F.lit(0))).alias("n"))
    n = rows.join(partners, ["field_name", "text_id", "key"]).groupBy("id").agg(F.sum("n").alias("n_links"))
    got = of.join(first, "component").join(n, "id", "left")
    return base.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
