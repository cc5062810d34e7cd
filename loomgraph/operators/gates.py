"""Verdicts: suites of questions, non-inferiority, subgroups, leakage, acceptance. Columns and small tables only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def rows_verdict(rows: Column, least: Column, failed: Column | None = None) -> Column:
    """pass where a question gave at least its rows; an error fails."""
    ok = F.coalesce(rows >= least, F.lit(False))
    return F.when(ok if failed is None else ok & ~failed, "pass").otherwise("fail")


def subgroup_verdict(groups: DataFrame, limit: float = 0.05) -> DataFrame:
    """One row (max_drop, verdict) of (drop, reliable): pass below ``limit``; pass and undetermined where no group is large enough."""
    worst = groups.agg(F.max(F.when(F.col("reliable"), F.round("drop", 9))).alias("max_drop"))
    return worst.select("max_drop", F.when(F.col("max_drop").isNull(), "undetermined").when(F.col("max_drop") < limit, "pass").otherwise("fail").alias("verdict"))


def suite_verdict(old: DataFrame, new: DataFrame, waived: tuple[str, ...] = ()) -> DataFrame:
    """(suite, old_rate, new_rate, verdict) of pass rates; a suite that is gone counts as 0, a waived drop passes."""
    j = old.select("suite", F.col("rate").alias("old_rate")).join(new.select("suite", F.col("rate").alias("new_rate")), "suite", "left").fillna(0.0, ["new_rate"])
    fell = F.col("new_rate") < F.col("old_rate")
    return j.withColumn("verdict", F.when(~fell, "pass").when(F.col("suite").isin(*waived) if waived else F.lit(False), "waived").otherwise("fail"))


def accept(verdicts: DataFrame) -> DataFrame:
    """One row (accepted, n_failed): all gates together; anything but pass, waived or undetermined refuses."""
    ok = F.col("verdict").isin("pass", "waived", "undetermined")
    return verdicts.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("accepted"), F.count_if(~ok).alias("n_failed"))


def holm_frame(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(name, p, rank, rejected) by Holm's step-down: all stop at the first that fails. The table has one row a test."""
    w = W.orderBy("p", "name")  # over the tests
    m = df.agg(F.count(F.lit(1)).alias("m"))
    r = df.select("name", "p").crossJoin(F.broadcast(m)).withColumn("rank", F.row_number().over(w).cast("bigint"))
    ok = F.col("p") <= F.lit(alpha) / (F.col("m") - F.col("rank") + 1)
    return r.withColumn("rejected", F.min(ok).over(w.rowsBetween(W.unboundedPreceding, 0))).select("name", "p", "rank", "rejected")


def discordant(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n, only_a, only_b) of (qid, hit) of two systems: what McNemar's test looks at."""
    j = a.select("qid", F.col("hit").alias("x")).join(b.select("qid", F.col("hit").alias("y")), "qid")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))


#: Names of columns that must not feed a ranking, and the shape of document ids.
FORBIDDEN = ("relevance", "label", "qrel", "is_relevant", "cited_by_examiner")
ID_SHAPE = r"^(?:[a-z]{2}_[A-Z]*\d{6,}[A-Z]?\d?|patent:[a-z]{2}_\w+|[A-Z]{2}-[A-Z]-\d{6,})$"


def forbidden_columns(names: list[str]) -> list[str]:
    """Those of ``names`` that are forbidden or are made from a forbidden one."""
    return [n for n in names if any(f in n.lower().split(".")[-1] for f in FORBIDDEN)]


def leakage_report(checks: dict[str, DataFrame | None]) -> DataFrame:
    """(check_name, n, status) of tables of offenders; a check whose input is missing is UNMEASURABLE, not passed."""
    spark = next(d.sparkSession for d in checks.values() if d is not None)
    parts = []
    for name, df in checks.items():
        if df is None:
            parts.append(spark.createDataFrame([(name, None, "UNMEASURABLE")], "check_name string, n bigint, status string"))
        else:
            n = df.agg(F.count(F.lit(1)).alias("n"))
            parts.append(n.select(F.lit(name).alias("check_name"), "n", F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def classify_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two manifests (path, sha256): same, changed, added or removed."""
    j = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))


def vocabulary_coverage(used: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, used, asked) of predicates in data and in questions or shapes; one that is not asked is not covered."""
    u, a = used.select("term").distinct().withColumn("used", F.lit(True)), asked.select("term").distinct().withColumn("asked", F.lit(True))
    return u.join(a, "term", "full").fillna(False, ["used", "asked"])


class Sealed:
    """A split that opens only with leave and a reason, each opening noted in a ledger."""

    def __init__(self, df: DataFrame, name: str, ledger: str):
        self._df, self.name, self.ledger = df, name, ledger

    def open(self, allow: bool, reason: str) -> DataFrame:
        if not allow or not reason.strip():
            raise PermissionError(f"{self.name} is sealed: leave and a reason are needed")
        from loomgraph.sources.formats import append_ledger

        note = self._df.sparkSession.createDataFrame([(self.name, reason.strip())], "split string, reason string")
        append_ledger(note.withColumn("at", F.current_timestamp().cast("string")), self.ledger)
        return self._df
