"""Connected components of a link table, one label a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.session import materialize


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component, for every node of a link.

    Alternates large-star and small-star steps: each neighbour of a node is linked
    to the least of its neighbourhood, so long chains shrink geometrically and no
    node gathers its component. Every round is one aggregate and one join, written
    to the shared folder. Self links count; null ends do not.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        j = both.join(least, "u")
        if large:
            return j.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        hub = j.select("v", "least").unionByName(least.select(F.col("u").alias("v"), "least"))
        return hub.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()

    stamp = None
    for _ in range(most_rounds):
        e = materialize(star(star(e, True), False), "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp:
            break
        stamp = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
