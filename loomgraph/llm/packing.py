"""Containers of fixed capacity filled with items: variable-capacity best fit over a histogram.

Items of one size are alike, so only how many there are of each size matters: a
table of at most ``capacity`` rows, whatever the corpus. The plan is made on it by
best-fit decreasing; a pattern of sizes is laid out as often as the counts allow,
so the number of patterns is bounded by the capacity, too. Items then find their
container by their rank among the items of their size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from loomgraph.llm.tokens import DEFAULT, sized
from loomgraph.session import materialize, spread

#: Token-equivalents that opening a container costs besides its capacity.
OPENING = 16


def _pattern(counts: dict[int, int], order: list[int], first: int, capacity: int) -> list[tuple[int, int]]:
    """Sizes and copies of a container opened by ``first``: again and again the best fit, the largest size that leaves least room."""
    used: dict[int, int] = {first: 1}
    room = capacity - first
    at = bisect_right(order, room)
    while room > 0 and at > 0:
        size = order[at - 1]
        left = counts[size] - used.get(size, 0)
        if left <= 0:
            at -= 1
            continue
        copies = min(left, room // size)
        used[size] = used.get(size, 0) + copies
        room -= copies * size
        at = min(at - 1, bisect_right(order, room))
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacities: tuple[int, ...]) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(first container, containers, length, [(size, copies)]) for the whole histogram.

    Each step opens, of all permitted capacities that hold the largest size left,
    the one whose filled pattern costs least per token, and finally takes the
    shortest permitted length that holds the contents. Ties go to the larger one.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > max(capacities) for s in counts):
        raise ValueError("sizes must lie between 1 and the largest capacity")
    order = sorted(counts)
    out, bins = [], 0
    while order:
        first, best = order[-1], None
        for c in sorted(capacities, reverse=True):
            if c >= first:
                p = _pattern(counts, order, first, c)
                price = (c + OPENING) / sum(s * k for s, k in p)
                if best is None or price < best[0]:
                    best = (price, p)
        p = best[1]
        times = min(counts[s] // k for s, k in p)
        fill = sum(s * k for s, k in p)
        out.append((bins, times, min(c for c in capacities if c >= fill), p))
        bins += times
        for s, k in p:
            counts[s] -= times * k
            if not counts[s]:
                del counts[s]
                order.remove(s)
    return out


def _slots(made: list[tuple[int, int, int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per size: first rank, first container and copies of each stretch of ranks."""
    at: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for first, times, length, pattern in made:
        for size, copies in pattern:
            r = at.get(size, 0)
            out.setdefault(size, []).append((r, first, copies, length))
            at[size] = r + times * copies
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}


#: Items of one size that a task ranks.
RANKED = 50_000


def assign(items: DataFrame, capacities: tuple[int, ...] = (2048,), ranked: int = RANKED) -> DataFrame:
    """``items`` (id, piece_no, n_tokens, ...) with container_id and length.

    Ranks within a size are made in parts of about ``ranked`` items with offsets
    from their counts, so a size that a third of all items have is no single task
    at any scale. The same items always get the same containers. Items of null or
    no size are left out.
    """
    spark = items.sparkSession
    kept = items.where("n_tokens > 0")
    # Bounded by the largest capacity rows, whatever the number of items.
    sizes = [(int(r["n_tokens"]), -(-int(r["count"]) // ranked)) for r in kept.groupBy("n_tokens").count().collect()]
    parts = spark.createDataFrame(sizes or [(0, 1)], "n_tokens int, parts int")
    kept = kept.join(F.broadcast(parts), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.col("parts")).cast("int")).drop("parts")
    # Bounded by the largest capacity + items / ``ranked`` rows.
    counts = kept.groupBy("n_tokens", "salt").count().toPandas().sort_values(["n_tokens", "salt"])
    histogram = counts.groupby("n_tokens")["count"].sum().astype(int).to_dict()
    offsets = {(int(s), int(k)): int(o) for s, k, o in zip(counts["n_tokens"], counts["salt"], counts.groupby("n_tokens")["count"].cumsum() - counts["count"], strict=True)}
    shared = spark.sparkContext.broadcast((_slots(plan({int(s): n for s, n in histogram.items()}, capacities)), offsets))
    local = kept.withColumn("nth", F.row_number().over(W.partitionBy("n_tokens", "salt").orderBy("id", "piece_no")))
    names = local.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, offset = shared.value
        for b in batches:
            rank = b["nth"].to_numpy(np.int64) - 1 + np.array([offset[x] for x in zip(b["n_tokens"], b["salt"], strict=True)], dtype=np.int64)
            bins, lengths = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for size, rows in b.groupby("n_tokens").indices.items():
                starts, first, copies, length = slots[int(size)]
                k = np.searchsorted(starts, rank[rows], side="right") - 1
                bins[rows] = first[k] + (rank[rows] - starts[k]) // copies[k]
                lengths[rows] = length[k]
            yield b.assign(container_id=bins, length=lengths)

    schema = ", ".join(f"`{n}` {t}" for n, t in local.dtypes) + ", container_id bigint, length bigint"
    return local.select(names).mapInPandas(run, schema).drop("nth", "salt")


def containers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = (2048,), lengths: tuple[int, ...] | None = None, path: str = DEFAULT, with_text: bool = True) -> DataFrame:
    """(container_id, capacity, length, n_items, fill, room, items) with every text of ``docs`` once.

    An item is (doc_id, piece_no, char_start, char_end, n_tokens, text). Only a
    text larger than the largest capacity is split, into full runs and a rest.
    ``lengths`` are the permitted lengths to which a finished container is cut
    down (default: the capacities). Null and empty texts hold no token and are in
    no container. Repeated rows of one id and text are one document, other texts under
    the same id are documents of their own. A container holds at most
    capacity items, so gathering them is bounded.
    """
    top = max(capacities)
    named = spread(docs.select(id_col, text_col)).where(F.length(text_col) > 0).select(F.struct(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash")).alias("tag"), F.col(text_col).alias("whole"))
    items = materialize(sized(named, "tag", "whole", top, path).dropDuplicates(["id", "piece_no"]), "sizes")
    put = assign(items, capacities)
    if with_text:
        texts = named.dropDuplicates(["tag"]).withColumnRenamed("tag", "id")
        put = put.join(texts, "id").withColumn("text", F.col("whole").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("whole")
    fields = [F.col("id.doc").alias("doc_id"), "piece_no", "char_start", "char_end", "n_tokens", *(["text"] if with_text else [])]
    got = put.groupBy("container_id").agg(F.max("length").alias("planned"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("fill"), F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    capacity = F.col("planned")
    cut_down = F.coalesce(*(F.when(F.col("fill") <= c, c) for c in sorted(lengths or capacities)))
    return got.select("container_id", capacity.alias("capacity"), cut_down.cast("bigint").alias("length"), "n_items", "fill", (capacity - F.col("fill")).alias("room"), "items")
