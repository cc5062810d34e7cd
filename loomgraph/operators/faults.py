"""Faults injected into triples (s, p, o), chosen by hash: the same seed hits the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _hit(rate: float, seed: int) -> Column:
    """True for about ``rate`` of the rows, independent of partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), "s", "p", "o"), F.lit(1_000_000)) < int(rate * 1_000_000)


def delete_edges(t: DataFrame, p: str, rate: float, seed: int = 0) -> DataFrame:
    return t.where(~((F.col("p") == p) & _hit(rate, seed)))


def rewire(t: DataFrame, p: str, to: str, rate: float, seed: int = 0) -> DataFrame:
    """Hit edges point to ``to`` (hub collapse)."""
    return t.withColumn("o", F.when((F.col("p") == p) & _hit(rate, seed), F.lit(to)).otherwise(F.col("o"))).distinct()


def flip(t: DataFrame, p: str, rate: float, seed: int = 0) -> DataFrame:
    bad = (F.col("p") == p) & _hit(rate, seed)
    return t.select(F.when(bad, F.col("o")).otherwise(F.col("s")).alias("s"), "p", F.when(bad, F.col("s")).otherwise(F.col("o")).alias("o"))


def shuffle_objects(t: DataFrame, p: str, seed: int = 0, salts: int = 64) -> DataFrame:
    """Objects of ``p`` exchanged among its edges: each edge takes the object of the next in hash order, salt by salt."""
    mine = t.where(F.col("p") == p).withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "s", "o"), F.lit(salts)))
    w = W.partitionBy("salt").orderBy(F.xxhash64(F.lit(seed + 1), "s", "o"), "s", "o")
    whole = W.partitionBy("salt").orderBy(F.xxhash64(F.lit(seed + 1), "s", "o"), "s", "o").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    moved = mine.withColumn("o2", F.coalesce(F.lead("o").over(w), F.first("o").over(whole))).select("s", "p", F.col("o2").alias("o"))
    return t.where(F.col("p") != p).unionByName(moved)


def merge_entities(t: DataFrame, mapping: DataFrame) -> DataFrame:
    """Identity rewrite: every old id (mapping: old, new) becomes the new one, as subject and as object; duplicates collapse."""
    m = mapping.select("old", "new").dropDuplicates(["old"])
    out = t.join(m.toDF("s", "ns"), "s", "left").withColumn("s", F.coalesce("ns", "s")).drop("ns")
    out = out.join(m.toDF("o", "no"), "o", "left").withColumn("o", F.coalesce("no", "o")).drop("no")
    return out.select("s", "p", "o").distinct()


def signatures(t: DataFrame) -> DataFrame:
    """(node, signature) over outgoing and incoming edges; nodes of one signature are duplicates.

    The edges are summed as hashes, so a hub's edges are never gathered.
    """
    out = t.select(F.col("s").alias("node"), F.xxhash64(F.lit(">"), "p", "o").alias("h"))
    into = t.select(F.col("o").alias("node"), F.xxhash64(F.lit("<"), "p", "s").alias("h"))
    both = out.unionByName(into).distinct()
    return both.groupBy("node").agg(F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("a"), F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n")).select("node", F.sha2(F.concat_ws("|", "a", "x", "n"), 256).alias("signature"))


def leak(t: DataFrame, p: str, into: str, rate: float, seed: int = 0) -> DataFrame:
    """Hit edges of ``p`` also stand under ``into``: an answer that leaks into what is asked from."""
    return t.unionByName(t.where((F.col("p") == p) & _hit(rate, seed)).withColumn("p", F.lit(into))).distinct()


def merge_synonyms(t: DataFrame, p: str, rate: float, seed: int = 0) -> DataFrame:
    """Hit nodes are taken for the least other node with which they share an object of ``p``."""
    e = t.where(F.col("p") == p).select("s", "o")
    first = e.groupBy("o").agg(F.min("s").alias("new"))  # one row an object, so a hub costs nothing
    m = e.where(F.pmod(F.xxhash64(F.lit(seed), "s"), F.lit(1_000_000)) < int(rate * 1_000_000)).join(first, "o").where("s <> new")
    return merge_entities(t, m.groupBy(F.col("s").alias("old")).agg(F.min("new").alias("new")))


def retype(t: DataFrame, old: str, new: str, rate: float, seed: int = 0) -> DataFrame:
    """Hit nodes of one type get another."""
    return t.withColumn("o", F.when((F.col("p") == "a") & (F.col("o") == old) & _hit(rate, seed), F.lit(new)).otherwise(F.col("o"))).distinct()


def dangle(t: DataFrame, p: str, rate: float, seed: int = 0) -> DataFrame:
    """Objects of hit edges are nodes that do not exist."""
    return t.withColumn("o", F.when((F.col("p") == p) & _hit(rate, seed), F.concat(F.lit("gone/"), "o")).otherwise(F.col("o")))


def repeat_nodes(t: DataFrame, p: str, rate: float, seed: int = 0) -> DataFrame:
    """Subjects of hit edges stand twice, the second time under another id with all their edges."""
    hit = t.where((F.col("p") == p) & _hit(rate, seed)).select("s").distinct()
    return t.unionByName(t.join(hit, "s", "left_semi").withColumn("s", F.concat("s", F.lit("#2"))))


def detection(runs: DataFrame) -> DataFrame:
    """(gate, faults, detected, false_alarms, normal, kills) of (gate, run, is_fault, flagged): a gate that flags any normal change is switched off."""
    f, g = F.col("is_fault"), F.col("flagged")
    d = runs.groupBy("gate").agg(F.count_if(f).alias("faults"), F.count_if(f & g).alias("detected"), F.count_if(~f & g).alias("false_alarms"), F.count_if(~f).alias("normal"))
    return d.withColumn("kills", F.col("false_alarms") > 0)
