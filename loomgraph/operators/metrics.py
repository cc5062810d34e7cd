"""Ranking metrics. run: (qid, doc_id, rank), qrel: (qid, doc_id), both distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def judged(run: DataFrame, qrel: DataFrame) -> DataFrame:
    """(qid, doc_id, rank, n_relevant) of every relevant pair; rank is null where it was not retrieved."""
    r = qrel.select("qid", "doc_id").distinct().join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return r.withColumn("n_relevant", F.count(F.lit(1)).over(W.partitionBy("qid")))


def per_query(run: DataFrame, qrel: DataFrame, ks: tuple[int, ...] = (10, 100), ndcg_k: int = 20) -> DataFrame:
    """Recall and success at each k, reciprocal rank capped at max(ks), binary nDCG; a query without run counts 0."""
    j = judged(run, qrel)
    n = F.max("n_relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    gain = F.sum(F.when(F.col("rank") <= ndcg_k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    cols = [F.sum(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)) / n for k in ks]
    hits = [F.max(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)) for k in ks]
    best = F.min(F.when(F.col("rank") <= max(ks), F.col("rank")))
    return j.groupBy("qid").agg(n.alias("n_relevant"), *(c.alias(f"recall_{k}") for c, k in zip(cols, ks)), *(c.alias(f"success_{k}") for c, k in zip(hits, ks)), F.coalesce(1.0 / best, F.lit(0.0)).alias("rr"), (gain / ideal).alias("ndcg"))


def macro(per_q: DataFrame) -> DataFrame:
    """Means over queries."""
    return per_q.agg(F.count(F.lit(1)).alias("n_queries"), *(F.avg(c).alias(c) for c in per_q.columns if c not in ("qid", "n_relevant")))


def micro_recall(run: DataFrame, qrel: DataFrame, k: int) -> DataFrame:
    """Share of all relevant pairs within k."""
    return judged(run, qrel).agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("micro_recall"))


def bpref(run: DataFrame, qrel: DataFrame) -> DataFrame:
    """Mean over relevant retrieved documents of 1 - min(non-relevant before, R) / R; those not retrieved give 0."""
    r = qrel.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_relevant"))
    x = run.join(qrel.select("qid", "doc_id", F.lit(1).alias("rel")).distinct(), ["qid", "doc_id"], "left").fillna(0, ["rel"])
    x = x.withColumn("before", F.sum(1 - F.col("rel")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    got = x.where("rel = 1").join(r, "qid").groupBy("qid").agg(F.sum(1 - F.least("before", "n_relevant") / F.col("n_relevant")).alias("s"))
    return r.join(got, "qid", "left").select("qid", (F.coalesce("s", F.lit(0.0)) / F.col("n_relevant")).alias("bpref"))


def effort(run: DataFrame, qrel: DataFrame, target: float = 0.5, cap: int = 500) -> DataFrame:
    """First rank at which recall reaches ``target``; cap + 1 and censored where it is not reached within ``cap``."""
    j = judged(run, qrel).withColumn("found", F.sum(F.when(F.col("rank") <= cap, 1).otherwise(0)).over(W.partitionBy("qid").orderBy(F.asc_nulls_last("rank")).rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.when((F.col("rank") <= cap) & (F.col("found") >= F.ceil(target * F.col("n_relevant") - 1e-9)), F.col("rank")))
    return j.groupBy("qid").agg(F.coalesce(first, F.lit(cap + 1)).cast("bigint").alias("effort"), first.isNull().alias("censored"))


def graded_ndcg(run: DataFrame, qrel: DataFrame, k: int = 20) -> DataFrame:
    """nDCG with gain 2^relevance - 1; qrel: (qid, doc_id, relevance)."""
    gain = lambda c: F.pow(F.lit(2.0), F.col(c)) - 1
    got = qrel.join(run, ["qid", "doc_id"]).where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain("relevance") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = qrel.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("relevance"), "doc_id"))).where(F.col("pos") <= k)
    ideal = best.groupBy("qid").agg(F.sum(gain("relevance") / F.log2(F.col("pos") + 1.0)).alias("idcg"))
    return ideal.join(got, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg_graded"))


def precision(run: DataFrame, qrel: DataFrame, k: int = 10) -> DataFrame:
    """(qid, precision_k, rr, list_gain): precision over min(k, length), reciprocal rank, and a gain that discounts a hit by its place among the hits."""
    x = run.join(qrel.select("qid", "doc_id", F.lit(1).alias("rel")).distinct(), ["qid", "doc_id"], "left").fillna(0, ["rel"])
    x = x.withColumn("pos", F.sum("rel").over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    hit = F.col("rel") == 1
    return x.groupBy("qid").agg(F.round(F.count_if(hit & (F.col("rank") <= k)) / F.least(F.lit(k), F.max("rank")), 9).alias(f"precision_{k}"), F.round(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 9).alias("rr"), F.round(F.coalesce(F.sum(F.when(hit, 1.0 / F.log2(F.col("pos") + 1.0))), F.lit(0.0)), 9).alias("list_gain"))
