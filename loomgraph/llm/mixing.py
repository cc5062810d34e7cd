"""Sources mixed to target weights by capped water-filling.

Every source may be repeated at most ``max_repeats`` times. Sources whose target
exceeds that are clamped, and the excess is spread over the others in proportion
to their weights until all fit. Whole repetitions take every text; the rest is a
seeded sample of texts up to the wanted size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomgraph.llm.tokens import DEFAULT, sized
from loomgraph.session import materialize

#: Sampling cells per source: the cell that holds the boundary is the only one that is ordered.
CELLS = 4096


def water_fill(have: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens to draw from each source.

    ``total`` None takes the largest size at which every source with tokens has
    exactly its share. A larger total clamps sources at ``have * repeats`` and
    redistributes; if all are clamped, everything is drawn. Sources without
    tokens, weight or target give nothing, and their weight goes to the others.
    """
    live = {s: w for s, w in weights.items() if w and w > 0 and have.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    cap = {s: float(have[s] * repeats[s]) for s in live}
    out = dict.fromkeys(weights, 0.0)
    if not live:
        return out
    if total is None:
        sum_w = sum(live.values())
        total = min(cap[s] * sum_w / w for s, w in live.items())
    open_, left = dict(live), float(total)
    while open_ and left > 0:
        sum_w = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / sum_w > cap[s] * (1 + 1e-12)]
        if not over:
            out |= {s: left * w / sum_w for s, w in open_.items()}
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return out


def mixture(docs: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: (doc_id, source, n_tokens, n_times), report: one row per target source.

    ``total`` is the wanted number of tokens, "all" for as many as the documents
    of the targets hold, or None for the most at which every share is exact.

    Reads id, text and source of ``docs``; source, target_share and max_repeats of
    ``targets`` (a small table of sources; a source named twice counts with its
    largest share and repeats). Documents of a null or unnamed source, and null or
    empty texts, are not drawn; a text that stands under several ids is used through
    the least of them only, and an id that stands on several texts with the one of
    least hash. The report says which sources were clamped at their repeats. The same seed draws the same sample. The boundary
    text is drawn if at least half of it fits, so a share is off by at most half
    its largest text.
    """
    spark = docs.sparkSession
    named = targets.where("source is not null").groupBy(F.col("source").alias("t_source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    goal = {x.t_source: (float(x.w or 0), int(x.r or 0)) for x in named.collect()}
    part = docs.select(F.col(id_col).alias("doc_id"), F.col("source").alias("doc_source"), F.col(text_col).alias("doc_text")).where(F.col("doc_source").isNotNull() & F.col("doc_text").isNotNull())
    kept = part.join(named, F.col("doc_source") == F.col("t_source"), "left_semi").withColumn("hash", F.sha2("doc_text", 256))
    # One id a text and one text an id, both settled on hashes; a text then goes to the tokenizer once.
    first = kept.groupBy("hash").agg(F.min(F.struct("doc_id", "doc_source")).alias("x")).select("hash", "x.*")
    one = first.groupBy("doc_id").agg(F.min(F.struct("hash", "doc_source")).alias("x")).select("doc_id", "x.*")
    kept = kept.dropDuplicates(["doc_id", "doc_source", "hash"]).join(one, ["doc_id", "doc_source", "hash"], "left_semi")
    sizes = sized(kept.withColumn("tag", F.struct("doc_id", "doc_source")), "tag", "doc_text", 2**31 - 1, path)
    s = sizes.select(F.col("id.doc_id").alias("doc_id"), F.col("id.doc_source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    s = materialize(s.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("cell", F.pmod("draw", F.lit(CELLS)).cast("int")), "sizes")
    # At most (target sources x CELLS) rows come to the driver.
    cells: dict[str, dict[int, int]] = {}
    for x in s.groupBy("source", "cell").agg(F.sum("n_tokens").alias("t")).collect():
        cells.setdefault(x.source, {})[x.cell] = x.t
    have = {k: sum(v.values()) for k, v in cells.items()}
    repeats = {k: r for k, (_, r) in goal.items()}
    drawn = water_fill(have, {k: w for k, (w, _) in goal.items()}, repeats, float(sum(have.values())) if total == "all" else total)
    rows = []
    for k, want in drawn.items():
        whole, rest = divmod(want, have[k]) if have.get(k) else (0, 0.0)
        before, edge = 0, CELLS
        for c in range(CELLS):
            t = cells.get(k, {}).get(c, 0)
            if before + t > rest:
                edge = c
                break
            before += t
        rows.append((k, int(whole), edge, float(rest - before)))
    frame = spark.createDataFrame(rows or [("", 0, 0, 0.0)], "source string, whole int, edge int, rest double")
    j = s.join(F.broadcast(frame), "source")  # one row per target source
    inner = j.where("cell <> edge").select("doc_id", "source", "n_tokens", (F.col("whole") + F.when(F.col("cell") < F.col("edge"), 1).otherwise(0)).alias("n_times"))
    running = F.sum("n_tokens").over(W.partitionBy("source").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    fits = running - F.col("n_tokens") / 2 <= F.col("rest")
    border = j.where("cell = edge").select("doc_id", "source", "n_tokens", "whole", "rest", "draw").withColumn("n_times", F.col("whole") + F.when(fits, 1).otherwise(0)).select("doc_id", "source", "n_tokens", "n_times")
    sample = inner.unionByName(border).where("n_times > 0")
    reached = sample.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_times")).alias("tokens_drawn"), F.count(F.lit(1)).alias("n_docs"), F.max("n_times").alias("most_repeats"))
    clamped = lambda k: total is not None and have.get(k, 0) > 0 and drawn[k] >= have[k] * repeats[k] * (1 - 1e-12)
    wanted = spark.createDataFrame([(k, w, r, int(have.get(k, 0)), float(drawn[k]), clamped(k)) for k, (w, r) in goal.items()] or [("", 0.0, 0, 0, 0.0, False)], "source string, target_share double, max_repeats int, tokens_there bigint, tokens_wanted double, clamped boolean").where("source <> ''")
    report = wanted.join(reached, "source", "left").fillna(0, ["tokens_drawn", "n_docs", "most_repeats"])
    everything = F.sum("tokens_drawn").over(W.partitionBy())  # over the few rows of the report
    return sample, report.withColumn("share_reached", F.when(everything > 0, F.col("tokens_drawn") / everything))
