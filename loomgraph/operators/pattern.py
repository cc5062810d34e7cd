"""Graph patterns over vertically partitioned triples, compiled to DataFrame plans.

A graph is a set of (s, p, o). Each predicate is its own relation (s, o), duplicates
gone, so a pattern with a constant predicate reads one relation and Catalyst prunes
the rest; only patterns with a variable predicate read a union. Terms that begin
with ``?`` are variables, all others constants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.session import materialize

#: Rows of the smaller side of ``product`` that are sent to every task, packed; more are joined the ordinary way.
FEW = 500_000

Triple = tuple[str, str, str]


class Graph:
    """Predicate relations by name, built when first used."""

    def __init__(self, spark: SparkSession, relations: dict[str, Callable[[], DataFrame] | None], part: Callable[[str], Callable[[], DataFrame] | None] | None = None):
        """``relations`` make the (s, o) of a predicate; ``part`` makes those of any name, parts of a predicate included, as sets."""
        self.spark, self._make, self._made, self._part = spark, dict(relations), {}, part

    @classmethod
    def of_triples(cls, triples: DataFrame) -> Graph:
        """A graph over a (s, p, o) table; predicates filter its ``p``, which prunes partitions where it is one."""
        g = cls(triples.sparkSession, {})
        g._triples = triples.dropDuplicates(["s", "p", "o"])
        return g

    def predicate(self, name: str) -> DataFrame:
        if name not in self._made:
            made = self._part(name) if self._part else None
            if made is not None:
                self._made[name] = made()
            elif name in self._make:
                self._made[name] = self._make[name]().where("s is not null and o is not null").select("s", "o").distinct()
            else:
                self._made[name] = self._triples.where(F.col("p") == name).select("s", "o")
        return self._made[name]

    def triples(self, names: Iterable[str] | None = None) -> DataFrame:
        if names is None and hasattr(self, "_triples"):
            return self._triples.select("s", "p", "o")
        return reduce(DataFrame.unionByName, [self.predicate(n).select("s", F.lit(n).alias("p"), "o") for n in (names or self._make)])

    def scan(self, t: Triple, predicates: Iterable[str] | None = None) -> DataFrame:
        """The bindings of one triple pattern."""
        s, p, o = t
        df = self.triples(predicates) if p.startswith("?") else self.predicate(p)
        keep: dict[str, Column] = {}
        for col, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                if term[1:] in keep:
                    df = df.where(keep[term[1:]] == F.col(col))
                else:
                    keep[term[1:]] = F.col(col)
            elif col != "p":
                df = df.where(F.col(col) == term)
        return df.select(*(c.alias(v) for v, c in keep.items())) if keep else df.select(F.lit(True).alias("_"))

    def match(self, *triples: Triple, values: DataFrame | None = None, predicates: Iterable[str] | None = None) -> DataFrame:
        """Basic graph pattern: natural joins on shared variables, in an order that never crosses needlessly."""
        parts = [self.scan(t, predicates) for t in triples]
        out = values if values is not None else parts.pop(0)
        while parts:
            k = next((i for i, p in enumerate(parts) if set(p.columns) & set(out.columns)), None)
            if k is None:
                raise ValueError(f"the patterns {triples} fall apart: join them by natural() if a product is meant")
            out = natural(out, parts.pop(k))
        return out


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared variables; a cross product where there is none is only made for an inner join of patterns."""
    on = [c for c in a.columns if c in b.columns]
    return a.join(b, on, how) if on else a.crossJoin(b)


def product(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """``natural(a, b)`` where the result is far larger than both and the shared keys may be very few.

    ``b`` is packed to one array of ``item``, which is never null, for all else
    that it holds, and unpacked in the tasks of ``a``: their number doesn't depend
    on the keys, and no row of ``a`` is moved for it.
    """
    b = materialize(b, "few")
    if b.count() > FEW:
        return natural(a, b)
    packed = b.groupBy(*(c for c in b.columns if c != item)).agg(F.collect_list(item).alias("_items"))
    return natural(a, F.broadcast(packed)).withColumn(item, F.explode("_items")).drop("_items")


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` in several parts a core, by ``key``, before a join on it whose parts take long: small parts aren't put together again."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def optional(a: DataFrame, b: DataFrame, on: Column | None = None) -> DataFrame:
    """OPTIONAL: ``b`` is the whole right side, joined beforehand; ``on`` is a filter inside it that may read variables of ``a``."""
    shared = [c for c in a.columns if c in b.columns]
    if on is None:
        return a.join(b, shared, "left")
    right = b.toDF(*(f"{c}__r" if c in shared else c for c in b.columns))
    cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{c}__r") for c in shared]) & on
    return a.join(right, cond, "left").drop(*(f"{c}__r" for c in shared))


def not_exists(a: DataFrame, b: DataFrame) -> DataFrame:
    """FILTER NOT EXISTS over the shared variables (several keys at once)."""
    return a.join(b, [c for c in a.columns if c in b.columns], "left_anti")


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns], "left_semi")


def union(*parts: DataFrame) -> DataFrame:
    """UNION as a bag; variables that a branch lacks are unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def zero_or_one(g: Graph, p: str, start: DataFrame, a: str, b: str) -> DataFrame:
    """Path ``a p? b``: the nodes of ``start`` themselves or one step on, each pair once."""
    step = g.scan((f"?{a}", p, f"?{b}"))
    nodes = start.select(a).distinct()
    return nodes.select(a, F.col(a).alias(b)).unionByName(nodes.join(step, a).select(a, b)).distinct()


def sequence(g: Graph, start: str, path: list[str], end: str) -> DataFrame:
    """Path ``start p1/p2/... end``; inner nodes are joined on and dropped, rows stay a bag."""
    out = g.scan((f"?{start}", path[0], "?_0"))
    for i, p in enumerate(path[1:]):
        out = out.join(g.scan((f"?_{i}", p, f"?_{i + 1}")), f"_{i}").drop(f"_{i}")
    return out.withColumnRenamed(f"_{len(path) - 1}", end)


def inverse(g: Graph, p: str, a: str, b: str) -> DataFrame:
    """Path ``a ^p b``."""
    return g.scan((f"?{b}", p, f"?{a}"))
