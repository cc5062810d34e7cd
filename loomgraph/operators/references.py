"""References to records that do not exist, found by one tagged union of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.keys import doc_key
from loomgraph.operators.skew import join_unique
from loomgraph.session import materialize

#: A key is hot if more than one in so many references name it.
SHARE = 1000


def parent_marks(refs: DataFrame, parents: DataFrame, parent_table: str = "parent") -> DataFrame:
    """(parent_table, key, seen_from, n_refs): since when each referenced key has a parent, and how often it is referred to.

    ``refs``: (ref_table, row_id, key, ref_at); ``parents``: (key, at). Parent and
    child keys are put under one another in long form, tagged, and grouped by
    parent table and key; ``seen_from`` is null where the group lacks a parent.
    Both sides are first reduced to one row a key on the map side, so that a key
    that a third of all rows refer to costs one row a task in the shuffle.
    """
    tagged = refs.select(F.lit(parent_table).alias("parent_table"), "key", F.lit(1).alias("child"), F.lit(None).cast("timestamp_ntz").alias("at")).unionByName(
        parents.select(F.lit(parent_table).alias("parent_table"), "key", F.lit(0).alias("child"), F.col("at").cast("timestamp_ntz").alias("at"))
    )
    return tagged.where("key is not null").groupBy("parent_table", "key").agg(F.sum("child").alias("n_refs"), F.min("at").alias("seen_from")).where("n_refs > 0")


def orphans(refs: DataFrame, parents: DataFrame, parent_table: str = "parent") -> DataFrame:
    """Rows of ``refs`` whose key has no parent at or before ``ref_at``, with ``status``.

    status is ``missing`` (no parent at all) or ``late`` (the first parent came
    after the reference). Null keys refer to nothing. A null ``ref_at`` cannot be
    after anything, so such a reference counts as resolved only if any parent is
    there. Parents whose time is null never resolve a reference. Repeated rows of
    (ref_table, row_id, key) come out once each as often as ``refs`` holds them.
    References to a hot key are joined where they are, against its one mark.
    """
    marks = materialize(parent_marks(refs, parents, parent_table), "marks")  # one row a key; its counts tell the hot keys
    total = marks.agg(F.coalesce(F.sum("n_refs"), F.lit(0))).first()[0]
    hot = [r.key for r in marks.where((F.col("n_refs") > 1000) & (F.col("n_refs") * SHARE > total)).select("key").collect()]  # fewer than SHARE
    joined = join_unique(refs.where("key is not null"), marks.select("key", "seen_from"), "key", "left", SHARE, hot)
    late = F.col("seen_from") > F.col("ref_at")
    return joined.where(F.col("seen_from").isNull() | late).select("ref_table", "row_id", "key", "ref_at", F.when(F.col("seen_from").isNull(), "missing").otherwise("late").alias("status"))


def patent_references(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """The references of prior_art_edges and notice_sections in long form.

    Edges that are non-patent literature and null or blank entries refer to
    nothing; a key named twice in one row is one reference.
    """
    e = edges.where(~F.coalesce(F.col("is_npl"), F.lit(False))).select(
        F.lit("prior_art_edges").alias("ref_table"), F.col("edge_id").alias("row_id"), doc_key("cited_doc_id").alias("key"), F.col("collected_at").cast("timestamp_ntz").alias("ref_at")
    )
    keys = F.array_distinct(F.transform("cited_ids", doc_key))
    s = sections.select(F.lit("notice_sections").alias("ref_table"), F.col("section_id").alias("row_id"), F.explode(keys).alias("key"), F.col("issued_at").cast("timestamp_ntz").alias("ref_at"))
    return e.unionByName(s).where("key is not null")


def patent_parents(records: DataFrame) -> DataFrame:
    """Resolved records of cited_enriched as (key, at)."""
    return records.where("resolved").select(doc_key("cited_doc_id").alias("key"), F.col("fetched_at").cast("timestamp_ntz").alias("at")).where("key is not null and at is not null")


def orphans_by_period(found: DataFrame, period: str = "month") -> DataFrame:
    """Counts of orphan references per table, period and status; a null time has its own row."""
    return found.groupBy("ref_table", F.date_format(F.date_trunc(period, "ref_at"), "yyyy-MM").alias("period"), "status").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_keys"))
