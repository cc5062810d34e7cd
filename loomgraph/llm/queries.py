"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm import lookalike, mixing, neardup, overlap, packing, residue, segment, survivor
from loomgraph.session import materialize, table

FIELDS = ["title", "abstract", "claims", "filing_date", "ipc", "cpc", "applicants"]
BUNDLES = {"text": ["abstract", "title"], "claims": ["claims", "n_claims"], "classes": ["ipc", "cpc"], "origin": ["country", "kind"], "filing": ["filing_date"], "owners": ["applicants"]}
DEPENDENCIES = [("ipc", "filing_date"), ("abstract", "applicants")]
SAME_LOOK = [("citations", "citation_id", ["original", "raw"]), ("cited_enriched", "record_id", ["claims"])]
LIMIT, OVERLAP, CAPACITY = 3000, 200, 2048


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = survivor.survivors(table(spark, d, "cited_enriched"), table(spark, d, "source_trust"), {f: [f] for f in FIELDS})
    return s.select(F.col("group_key").alias("cited_doc_id"), F.col("bundle").alias("field_name"), "record_id")


def p1_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The surviving rows, bundles taken whole under functional dependencies."""
    r = table(spark, d, "cited_enriched")
    s = materialize(survivor.survivors(r, table(spark, d, "source_trust"), BUNDLES, DEPENDENCIES, functional=True), "chosen")
    return survivor.merged(r, s, BUNDLES).withColumnRenamed("group_key", "cited_doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([lookalike.pairs(table(spark, d, t), i, f) for t, i, f in SAME_LOOK])


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _union([lookalike.unify(table(spark, d, t), i, f) for t, i, f in SAME_LOOK])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neardup.near_records(table(spark, d, "cited_enriched"), "record_id", "cited_doc_id", ["abstract", "claims"])
    return near.select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b")).distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class under the rule of p3_found, and the number of pairs it stands in."""
    c = neardup.near_classes(table(spark, d, "cited_enriched"), "record_id", "cited_doc_id", ["abstract", "claims"])
    return c.withColumnRenamed("id", "record_id")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split(table(spark, d, "claim_texts"), table(spark, d, "splits"), ["claims_full", "first_independent"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("doc_id_a"), F.greatest("train_id", "eval_id").alias("doc_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.leak_counts(table(spark, d, "claim_texts"), table(spark, d, "splits"), ["claims_full", "first_independent"])


def _items(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "cited_enriched").select(F.lit("cited_enriched").alias("tbl"), F.col("record_id").cast("string").alias("item_id"), F.col("claims").alias("text"))
    return a.unionByName(table(spark, d, "claim_texts").select(F.lit("claim_texts").alias("tbl"), F.col("doc_id").alias("item_id"), F.col("claims_full").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return segment.pieces(_items(spark, d), LIMIT, OVERLAP, with_text=False).where("n_pieces > 1").select("tbl", "item_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return segment.pieces(_items(spark, d), LIMIT, OVERLAP)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), capacities=(CAPACITY,), lengths=(256, 512, 1024, CAPACITY))


def p8_variable(spark: SparkSession, d: str) -> DataFrame:
    """Several permitted lengths opened jointly; items by reference, without their texts."""
    return packing.containers(table(spark, d, "documents"), capacities=(512, 1024, CAPACITY), with_text=False)


def _mixture(spark: SparkSession, d: str, total: str | None) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"), total)


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    """The largest sample in which every source has exactly its share."""
    return _mixture(spark, d, None)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, None)[1]


def p9_clamped_sample(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as the documents hold: scarce sources are clamped at their repeats and the excess goes to the others."""
    return _mixture(spark, d, "all")[0]


def p9_clamped_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, "all")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_bundles, p2_found, p2_canonical, p3_found, p3_groups, p4_found, p4_report, p6_found, p6_pieces, p8_containers, p8_variable, p9_sample, p9_report, p9_clamped_sample, p9_clamped_report, p10_found, p10_reasons]
    return {f.__name__: f for f in found}
