"""Queries of the general data problems: orphan references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators.packed import unpack
from loomgraph.operators.references import orphans, orphans_by_period, patent_parents, patent_references
from loomgraph.session import table

PACKED = {"ipc": True, "cpc": True, "applicants": False}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = patent_references(table(spark, d, "prior_art_edges"), table(spark, d, "notice_sections"))
    return orphans(refs, patent_parents(table(spark, d, "cited_enriched")), "cited_enriched")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", F.col("key").alias("cited_doc_id"))


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(table(spark, d, "cited_enriched"), "record_id", PACKED, least=2).select("field_name", "record_id", "item_no", "item")


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value, single ones too, with the number of values and error flags of its field."""
    return unpack(table(spark, d, "cited_enriched"), "record_id", PACKED)


_KEY = "nullif(upper(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), '')"
_ORPHANS = f"""
WITH p AS (SELECT {_KEY.format('cited_doc_id')} AS k, min(fetched_at) AS seen FROM cited_enriched WHERE resolved AND fetched_at IS NOT NULL GROUP BY 1),
r AS (SELECT 'prior_art_edges' AS ref_table, edge_id AS row_id, {_KEY.format('cited_doc_id')} AS k, collected_at AS ref_at FROM prior_art_edges WHERE NOT coalesce(is_npl, false)
      UNION ALL SELECT DISTINCT 'notice_sections', section_id, {_KEY.format('x')}, issued_at FROM (SELECT section_id, issued_at, unnest(cited_ids) AS x FROM notice_sections)),
o AS (SELECT r.*, CASE WHEN p.seen IS NULL THEN 'missing' ELSE 'late' END AS status FROM r LEFT JOIN p ON r.k = p.k WHERE r.k IS NOT NULL AND (p.seen IS NULL OR p.seen > r.ref_at))"""

SQL = {
    "p5_found": _ORPHANS + " SELECT ref_table, row_id, k AS cited_doc_id FROM o",
    "p5_by_month": _ORPHANS + " SELECT ref_table, strftime(ref_at, '%Y-%m') AS period, status, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM o GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (p5_found, p5_by_month, p7_found, p7_values)}
