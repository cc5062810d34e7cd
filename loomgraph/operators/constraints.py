"""Shapes over predicate relations: violations, target counts, gates.

A property shape says for the nodes of a target how many values a path has and of
what kind. Each check gives (focus, path, rule, value).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Property:
    path: DataFrame  # (s, o)
    name: str
    min_count: int | None = None
    max_count: int | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] | None = None
    at_least: float | None = None
    at_most: float | None = None
    has_value: str | None = None
    datatype: str | None = None  # a Spark type that the value must cast to
    cls: DataFrame | None = None  # (s) nodes of the class that values must belong to


@dataclass(frozen=True)
class Shape:
    name: str
    target: DataFrame  # (s)
    properties: list[Property] = field(default_factory=list)


def _out(df: DataFrame, p: Property, rule: str, value: Column | None = None) -> DataFrame:
    return df.select(F.col("s").alias("focus"), F.lit(p.name).alias("path"), F.lit(rule).alias("rule"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def check(shape: Shape) -> DataFrame:
    """All violations of a shape."""
    target = shape.target.select("s").distinct()
    parts = []
    for p in shape.properties:
        on = target.join(p.path, "s")
        if p.min_count is not None or p.max_count is not None:
            n = F.count("o")
            bad = reduce(lambda a, b: a | b, [c for c in ((n < p.min_count) if p.min_count is not None else None, (n > p.max_count) if p.max_count is not None else None) if c is not None])
            counted = target.join(p.path, "s", "left").groupBy("s").agg(n.alias("n"), bad.alias("bad")).where("bad")
            parts.append(_out(counted, p, "count", F.col("n")))
        tests: list[tuple[str, Column]] = []
        if p.pattern is not None:
            tests.append(("pattern", ~F.col("o").rlike(p.pattern)))
        if p.one_of is not None:
            tests.append(("in", ~F.col("o").isin(*p.one_of)))
        if p.at_least is not None:
            tests.append(("minInclusive", ~F.coalesce(F.col("o").try_cast("double") >= p.at_least, F.lit(False))))
        if p.at_most is not None:
            tests.append(("maxInclusive", ~F.coalesce(F.col("o").try_cast("double") <= p.at_most, F.lit(False))))
        if p.datatype is not None:
            tests.append(("datatype", F.col("o").try_cast(p.datatype).isNull()))
        for rule, bad in tests:
            parts.append(_out(on.where(bad), p, rule, F.col("o")))
        if p.has_value is not None:
            parts.append(_out(target.join(p.path.where(F.col("o") == p.has_value), "s", "left_anti"), p, "hasValue"))
        if p.cls is not None:
            parts.append(_out(on.join(p.cls.select(F.col("s").alias("o")), "o", "left_anti"), p, "class", F.col("o")))
    return reduce(DataFrame.unionByName, parts).withColumn("shape", F.lit(shape.name))


def less_or_equal(target: DataFrame, low: DataFrame, high: DataFrame, name: str) -> DataFrame:
    """(focus, path, rule, value) where a value of ``low`` exceeds one of ``high``."""
    j = target.select("s").distinct().join(low.toDF("s", "lo"), "s").join(high.toDF("s", "hi"), "s").where(F.col("lo") > F.col("hi"))
    return j.select(F.col("s").alias("focus"), F.lit(name).alias("path"), F.lit("lessThanOrEquals").alias("rule"), F.col("lo").alias("value"))


def any_of(target: DataFrame, *conforming: DataFrame) -> DataFrame:
    """sh:or: focus nodes that conform to none; each of ``conforming`` holds (s)."""
    ok = reduce(DataFrame.unionByName, [c.select("s") for c in conforming]).distinct()
    return target.select("s").distinct().join(ok, "s", "left_anti").select(F.col("s").alias("focus"))


def none_of(target: DataFrame, forbidden: DataFrame) -> DataFrame:
    """sh:not: focus nodes that conform to what is forbidden."""
    return target.select("s").distinct().join(forbidden.select("s"), "s", "left_semi").select(F.col("s").alias("focus"))


def target_counts(shapes: list[Shape]) -> DataFrame:
    """(shape, targets, status): a shape without targets is vacuous, not passed."""
    counted = reduce(DataFrame.unionByName, [s.target.select("s").distinct().agg(F.count(F.lit(1)).alias("targets")).withColumn("shape", F.lit(s.name)) for s in shapes])
    return counted.select("shape", "targets", F.when(F.col("targets") == 0, "vacuous").otherwise("checked").alias("status"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge end, side) of edges whose src or dst is no node."""
    ids = nodes.select(F.col("id")).distinct()
    side = lambda c: edges.select(F.col(c).alias("id")).where("id is not null").join(ids, "id", "left_anti").select("id", F.lit(c).alias("side"))
    return side("src").unionByName(side("dst")).distinct()


def family_crossing(splits: DataFrame) -> DataFrame:
    """(family_id, n_splits) of families that stand in more than one split."""
    return splits.where("family_id is not null").groupBy("family_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def delta_gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s) of nodes that only the new triples describe: the ones strict shapes hold for."""
    return new.select("s").distinct().join(old.select("s").distinct(), "s", "left_anti")
