"""Same or near-same records across splits.

Records are canonicalised (letter case, punctuation and white space away) and
hashed; hashes of the evaluation splits meet those of the training split. What is
almost the same goes through the fingerprint tables of ``neardup``, training
texts in the tables, evaluation texts as probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.keys import has_value
from loomgraph.llm.neardup import distinct_texts, near_sketches, sketches
from loomgraph.session import materialize

#: The splits that count.
TRAIN, EVAL = "train", ("dev", "test", "test_b")


def canonical_hash(c: str) -> Column:
    """Hash of a text's letters and digits in lower case; null where none are left."""
    return F.sha2(F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit("")), 256)


def split_of(splits: DataFrame) -> DataFrame:
    """(doc_id, split) once each, read without letter case and outer blanks; unknown splits are left out.

    A doc_id in several splits keeps each of them.
    """
    s = F.lower(F.regexp_replace("split", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return splits.select("doc_id", s.alias("split")).where(F.col("split").isin(TRAIN, *EVAL) & F.col("doc_id").isNotNull()).distinct()


def _linked(docs: DataFrame, splits: DataFrame, fields: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (field_name, id, text_id, side) of documents with a known split, links (text_a, text_b, how, overlap) of training and evaluation texts."""
    s = split_of(splits)
    side = s.groupBy("doc_id").agg(F.bit_or(F.when(F.col("split") == TRAIN, 1).otherwise(2)).alias("side"))
    keyed = docs.select("doc_id", *fields).join(side, "doc_id")
    rows, texts = distinct_texts(keyed, "doc_id", fields, F.col("side"))
    # A text of the one side and its equal on the other are one text, so the hash join is over texts with their sides; the hash is told while the text is there.
    d, n, held, named = sketches(texts, threshold, canon=F.unhex(canonical_hash("text")))
    hashed = named[0]
    for x in named[1:]:
        hashed = hashed.unionByName(x)
    hashed = hashed.where("canon is not null")
    left = hashed.where("side & 1 > 0").select("canon", F.col("text_id").alias("text_a"))
    right = hashed.where("side & 2 > 0").select("canon", F.col("text_id").alias("text_b"))
    same = left.join(right, "canon").select("text_a", "text_b", F.lit("same").alias("how"), F.lit(1.0).alias("overlap"))
    near = near_sketches(d, n, held, named, between=True).select("text_a", "text_b", F.lit("near").alias("how"), "overlap")
    return rows.repartition("text_id").distinct(), same.unionByName(near).groupBy("text_a", "text_b").agg(F.max("how").alias("how"), F.min("overlap").alias("overlap"))


def cross_split(docs: DataFrame, splits: DataFrame, fields: list[str], threshold: float = 0.85) -> DataFrame:
    """(train_id, eval_id, field_name, how, overlap) of texts that stand on both sides.

    ``docs``: doc_id and ``fields``; repeated rows of a doc_id are further texts of
    it. how is ``same`` (equal canonical hashes) or ``near`` (overlap of words at
    least ``threshold``). Pairs come out as often as different texts of the two
    documents meet. Fields without a value and documents without a known split
    do not count; a document in both a training and an evaluation split is no
    pair with itself.
    """
    rows, links = _linked(docs, splits, fields, threshold)
    a = rows.where("side & 1 > 0").select(F.col("id").alias("train_id"), "field_name", F.col("text_id").alias("text_a"))
    b = rows.where("side & 2 > 0").select(F.col("id").alias("eval_id"), F.col("field_name").alias("field_b"), F.col("text_id").alias("text_b"))
    met = links.join(a, "text_a").join(b, "text_b").where("field_name = field_b and train_id <> eval_id")
    return met.select("train_id", "eval_id", "field_name", "how", "overlap")


def leak_counts(docs: DataFrame, splits: DataFrame, fields: list[str], threshold: float = 0.85) -> DataFrame:
    """(split, source, field_name, how, n_pairs, n_eval_docs, n_train_docs) without making a pair of documents.

    Documents are counted per text, split and source, and counts of linked texts
    are multiplied; a document on both sides is no pair with itself. n_pairs has a
    pair of documents once for each pair of texts by which they meet. A document's
    source is its least non-null one.
    """
    rows, links = _linked(docs, splits, fields, threshold)
    rows, links = materialize(rows, "rows"), materialize(links, "links")
    src = docs.groupBy(F.col("doc_id").alias("id")).agg(F.min("source").alias("source"))
    s = split_of(splits).where(F.col("split") != TRAIN).select(F.col("doc_id").alias("id"), "split")
    train = rows.where("side & 1 > 0").select("field_name", F.col("text_id").alias("text_a"), "id")
    held = train.groupBy("field_name", "text_a").agg(F.count(F.lit(1)).alias("n_train"))
    by = ["split", "source", "field_name", "how"]
    ev = rows.where("side & 2 > 0").select("field_name", F.col("text_id").alias("text_b"), "id").join(s, "id").join(src, "id", "left").join(links.select("text_a", "text_b", "how"), "text_b")
    ev = ev.join(held, ["field_name", "text_a"]).join(train.withColumn("own", F.lit(1)), ["field_name", "text_a", "id"], "left")
    ev = materialize(ev.select(*by, "text_a", "id", (F.col("n_train") - F.coalesce("own", F.lit(0))).alias("n")), "leaks")
    pairs = ev.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n_pairs"), F.countDistinct("id").alias("n_eval_docs"))
    seen = ev.groupBy(*by, "text_a").agg(F.countDistinct("id").alias("n_eval"))
    own = ev.select(*by, "text_a", "id").distinct().withColumn("own", F.lit(1))
    key = [F.col(f"t.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "text_a", "id")]  # a source may be null
    tr = train.join(seen, ["field_name", "text_a"]).alias("t").join(own.alias("o"), key, "left").where("n_eval > coalesce(own, 0)")
    n_train = tr.groupBy(*(F.col(f"t.{c}").alias(c) for c in by)).agg(F.countDistinct("t.id").alias("n_train_docs"))
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    return pairs.alias("p").join(n_train.alias("q"), on, "left").select(*(f"p.{c}" for c in by), "n_pairs", "n_eval_docs", F.coalesce("n_train_docs", F.lit(0)).alias("n_train_docs"))


def leak_report(found: DataFrame, docs: DataFrame, splits: DataFrame) -> DataFrame:
    """Per evaluation split, source, field and way: pairs found and evaluation documents hit.

    A document's source is its least non-null one; null where it has none.
    """
    src = docs.groupBy(F.col("doc_id").alias("eval_id")).agg(F.min("source").alias("source"))
    s = split_of(splits).where(F.col("split") != TRAIN).select(F.col("doc_id").alias("eval_id"), "split")
    pairs = found.select("train_id", "eval_id", "field_name", "how").distinct()
    return pairs.join(s, "eval_id").join(src, "eval_id", "left").groupBy("split", "source", "field_name", "how").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_docs"), F.countDistinct("train_id").alias("n_train_docs"))
