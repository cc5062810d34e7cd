"""Samples that the same seed draws on any cluster: quotas a stratum, hard and easy negatives, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def draw(seed: int, *cols: str) -> Column:
    """A number that orders rows at random, the same wherever they lie."""
    return F.xxhash64(F.lit(seed), *cols)


def quota(df: DataFrame, strata: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each stratum, by hash of the id; Spark keeps ``n`` a task before the shuffle."""
    w = W.partitionBy(*strata).orderBy(draw(seed, id_col), id_col)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def negatives(queries: DataFrame, docs: DataFrame, cited: DataFrame, n: int, hard: bool, seed: int = 42, salts: int = 64) -> DataFrame:
    """(qid, doc_id): ``n`` documents never cited by a query: hard ones share its class and not its family, easy ones are of another section.

    ``queries``, ``docs``: (id, cls, section, family). Each class or section keeps
    only its first documents by hash: enough for the longest list of citations
    beside what is wanted, so no query meets a whole class.
    """
    most = (cited.groupBy("qid").count().agg(F.max("count")).first()[0] or 0) + n + 1
    key = "cls" if hard else "section"
    lots = quota(docs.withColumn("_s", F.pmod(draw(seed, "id"), F.lit(salts))), [key, "_s"], "id", most * 2, seed).drop("_s")  # in parts, so a hot class is no single task
    few = quota(lots, [key], "id", most * 2, seed).select(F.col("id").alias("doc_id"), F.col(key).alias("dk"), F.col("family").alias("df"))
    q = queries.select(F.col("id").alias("qid"), F.col(key).alias("qk"), F.col("family").alias("qf"))
    met = q.join(few, F.col("qk") == F.col("dk")) if hard else q.join(few, F.col("qk") != F.col("dk"))
    met = met.where("qid <> doc_id and (qf is null or df is null or qf <> df)").join(cited.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    w = W.partitionBy("qid").orderBy(draw(seed, "qid", "doc_id"), "doc_id")
    return met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("qid", "doc_id")


def facets(postings: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """(id, term, df, rank): the ``k`` most specific terms of each id among those in ``low`` to ``high`` documents; ``postings``: (id, term)."""
    p = postings.select("id", "term").distinct()
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(low, high))
    return p.join(df, "term").withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("df", F.desc(F.length("term")), "term")).cast("bigint")).where(F.col("rank") <= k)
