"""Sizes of texts in tokens of a public tokenizer (byte-level BPE, files of /opt/tokenizers)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The tokenizer used unless another path is given: byte-level BPE for many languages, 50,256 ids.
DEFAULT = os.environ.get("LOOMGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a ``.tiktoken`` rank file; its pre-token pattern is the public GPT-2 one."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_sizes(text: str, capacity: int, path: str) -> list[tuple[int, int, int]]:
    """(char_start, char_end, n_tokens) of ``text`` in runs of at most ``capacity`` tokens, never inside a character.

    A text within the capacity is one run; an empty text has none. Sizes are the
    tokens of the whole text that fall into each run.
    """
    enc = encoder(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))] if ids else []
    raw = [enc.decode_single_token_bytes(i) for i in ids]
    out, first, char = [], 0, 0
    while first < len(raw):
        last = min(first + capacity, len(raw))
        while last < len(raw) and last > first + 1 and raw[last][0] & 0xC0 == 0x80:
            last -= 1
        n = sum((c & 0xC0) != 0x80 for x in raw[first:last] for c in x)
        out.append((char, char + n, last - first))
        char, first = char + n, last
    return out


def sized(df: DataFrame, id_col: str, text_col: str, capacity: int, path: str = DEFAULT) -> DataFrame:
    """(id, piece_no, char_start, char_end, n_tokens) of every text; null and empty texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, *run) for i, t in b.itertuples(index=False) for k, run in enumerate(split_sizes(t, capacity, path), 1)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "char_start", "char_end", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    return df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, piece_no int, char_start int, char_end int, n_tokens int")
