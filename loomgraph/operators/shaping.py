"""Aggregates, windows and set operations that reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def concat_distinct(c: str | Column, sep: str = "; ") -> Column:
    """GROUP_CONCAT DISTINCT in order of the values."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def distribution(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """(value, n, share, rank): how often each value stands, null as a value of its own; the ``top`` most frequent where given."""
    c = df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    r = c.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "value")).cast("bigint")).crossJoin(F.broadcast(total))  # one row; the window is over distinct values
    out = r.select("value", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), "rank")
    return out if top is None else out.where(F.col("rank") <= top)


def spread(value: str | Column) -> tuple[Column, Column]:
    """Mean and sample deviation; the deviation of one value is null."""
    return F.avg(value), F.stddev_samp(value)


def ratio_of_sums(num: str | Column, den: str | Column) -> Column:
    """Sum over sum; null where the denominator is 0."""
    return F.try_divide(F.sum(num), F.sum(den))


def smoothed(hits: Column, total: Column, classes: int = 4) -> Column:
    """Conditional probability with one hit added to each of ``classes`` and the rest."""
    return (hits + 1) / (total + 1 + classes)


def log_lift(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Natural logarithm of lift, weighted by how often both occur."""
    return F.log(both * n / (a * b)) * F.log(1 + both)


def composition(ids: DataFrame, splits: DataFrame, id_col: str) -> DataFrame:
    """(split, n) of ``ids``; those without a split count under ``_unknown``."""
    s = splits.groupBy(id_col).agg(F.min("split").alias("split"))
    return ids.join(s, id_col, "left").groupBy(F.coalesce("split", F.lit("_unknown")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def additive_delta(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """(key, status, n_added, n_lost) of arrays ``items`` by ``key``: unchanged, extended, changed, new or lost."""
    none = F.array().cast("array<string>")
    j = old.select(key, F.col(items).alias("o")).join(new.select(key, F.col(items).alias("n")), key, "full")
    added, lost = F.size(F.array_except(F.coalesce("n", none), F.coalesce("o", none))), F.size(F.array_except(F.coalesce("o", none), F.coalesce("n", none)))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "lost").when((added == 0) & (lost == 0), "unchanged").when(lost == 0, "extended").otherwise("changed")
    return j.select(key, status.alias("status"), added.cast("bigint").alias("n_added"), lost.cast("bigint").alias("n_lost"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pass_rate(results: DataFrame, by: str) -> DataFrame:
    """(by, n, passed, rate) of (by, ok)."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("n"), 9))


def cumulative_split(groups: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.6), ("dev", 0.8), ("test", 1.0))) -> DataFrame:
    """(group, at, n, split): whole groups (group, at, n) in order of ``at`` and id, cut where the running sum of n passes each share.

    The running sum is made of daily totals first, so the only window over
    everything is over dates; within a date each has its own.
    """
    days = groups.groupBy("at").agg(F.sum("n").alias("day"))
    before = days.withColumn("before", F.sum("day").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("day")).drop("day")  # one row a date
    total = groups.agg(F.sum("n").alias("total"))
    inside = F.sum("n").over(W.partitionBy("at").orderBy("group").rowsBetween(W.unboundedPreceding, W.currentRow))
    r = groups.withColumn("inside", inside).join(before, "at").crossJoin(F.broadcast(total)).withColumn("upto", F.col("before") + F.col("inside"))  # one row
    cut = reduce(lambda c, s: c.when(F.col("upto") <= F.col("total") * s[1], s[0]), shares[1:-1], F.when(F.col("upto") <= F.col("total") * shares[0][1], shares[0][0])).otherwise(shares[-1][0])
    return r.select("group", "at", "n", cut.alias("split"))


def checksum(split: DataFrame) -> DataFrame:
    """(split, n_groups, sum): a sum over hashes of ids, equal for equal splits in any order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("group").cast("string"), "split")), 1, 8), 16, 10).cast("bigint")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(h).alias("sum"))


def quartile_buckets(df: DataFrame, value: str) -> DataFrame:
    """``df`` with bucket Q1..Q4 by the exact quartiles of all rows (a value on a quartile belongs below it); null stays null."""
    q = df.agg(F.percentile(value, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75)))).alias("q"))
    v = F.col(value)
    b = F.when(v <= F.col("q")[0], "Q1").when(v <= F.col("q")[1], "Q2").when(v <= F.col("q")[2], "Q3").when(v.isNotNull(), "Q4")
    return df.crossJoin(F.broadcast(q)).withColumn("bucket", b).drop("q")  # one row


def precedence_merge(parts: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """(key, fields): each field from the first of ``parts`` that has a non-blank value for the key."""
    tagged = reduce(DataFrame.unionByName, [p.select(key, *(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in fields), F.lit(i).alias("g")) for i, p in enumerate(parts)])
    return tagged.groupBy(key).agg(*(F.min(F.when(F.col(f).isNotNull(), F.struct("g", f)))[f].alias(f) for f in fields))


def dedupe_slugs(df: DataFrame, slug: str, order: list[Column]) -> DataFrame:
    """One row a slug, the first by ``order``; the order must end in something unique."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(slug).orderBy(*order))).where("_n = 1").drop("_n")


def rank_drops(old: DataFrame, new: DataFrame, qrel: DataFrame, least: int = 20, k: int = 100) -> DataFrame:
    """(qid, doc_id, rank_old, rank_new, reason) of relevant documents that fell by ``least`` ranks or out of the first ``k``."""
    r = lambda d, n: d.select("qid", "doc_id", F.col("rank").alias(n))
    j = qrel.select("qid", "doc_id").distinct().join(r(old, "rank_old"), ["qid", "doc_id"]).join(r(new, "rank_new"), ["qid", "doc_id"], "left")
    lost = (F.col("rank_old") <= k) & (F.col("rank_new").isNull() | (F.col("rank_new") > k))
    fell = F.col("rank_new") - F.col("rank_old") >= least
    return j.select("qid", "doc_id", "rank_old", "rank_new", F.when(lost, "lost").when(fell, "fell").alias("reason")).where("reason is not null")


def with_tail(scored: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, score, rank) of every candidate of every stated query; those without a score follow with 0.

    The product is of stated queries and a candidate list, which the caller bounds.
    """
    every = queries.select("qid").distinct().crossJoin(candidates.select("doc_id").distinct())
    s = every.join(scored.select("qid", "doc_id", "score"), ["qid", "doc_id"], "left").fillna(0.0, ["score"])
    return s.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("bigint"))


def conjunctive(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, id) of ids that hold all of a query's keys: a count against the query's number of keys; ``postings``: (id, key), ``wanted``: (qid, key)."""
    w = wanted.select("qid", "key").distinct()
    n = w.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    hit = postings.select("id", "key").distinct().join(w, "key").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("got"))
    return hit.join(n, "qid").where("got = need").select("qid", "id")
