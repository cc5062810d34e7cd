"""Sparse and dense retrieval as joins of postings and blocked products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.session import spread


def terms(c: Column) -> Column:
    """Mixed tokens: ASCII words of two or more, Hangul words and their bigrams, all pairs of neighbours in runs of Kana and Han (a single one as it is)."""
    low = F.lower(c)
    ascii_ = F.regexp_extract_all(low, F.lit(r"[a-z0-9]{2,}"), 0)
    hangul = F.regexp_extract_all(low, F.lit(r"[가-힣]+"), 0)
    grams = F.flatten(F.transform(F.filter(hangul, lambda w: F.length(w) > 2), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))))
    runs = F.regexp_extract_all(low, F.lit(r"[぀-ヿ㐀-鿿]+"), 0)
    kana = F.flatten(F.transform(runs, lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2)))))
    return F.concat(ascii_, hangul, grams, kana)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf, dl) of every document with a term; counts are partial before the shuffle."""
    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("ts")).withColumn("dl", F.size("ts").cast("bigint"))
    return t.select("doc_id", "dl", F.explode("ts").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df, stats): (term, df) and one row (n_docs, avgdl) of all postings; both are partial before their shuffles."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = post.groupBy("doc_id").agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return df, stats


#: Queries scored in one pass over the documents, more are scored block by block; documents scored at once within a task.
BLOCK, _DOCS = 4096, 256


def _blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    """``queries`` in parts of at most about ``block`` different qids, told by hash: nothing is collected."""
    n = queries.select("qid").distinct().count()
    parts = max(1, -(-n // block))
    return [queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]


def bm25(queries: DataFrame, post: DataFrame, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(qid, doc_id, score); queries: (qid, term) distinct. idf = ln(1 + (N - df + 0.5) / (df + 0.5)), document lengths exact.

    Every document that shares a term with a query is scored; nothing is cut. A
    caller that wants the best k takes ``bm25_top_k``, which never makes this table.
    """
    df, stats = term_stats(post)
    used = post.join(queries.select("term").distinct(), "term", "left_semi")
    hit = used.join(df, "term").join(queries.select("qid", "term").distinct(), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return hit.groupBy("qid", "doc_id").agg(F.sum(idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("score")).where("qid <> doc_id")


def _top_k_by_matrix(weights: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """Best ``k`` of each query by the sum over shared terms of (doc_id, term, w) times (qid, term, wq); self excluded, ties by id.

    Queries are a stated set and are taken in blocks; a block's terms and weights
    are shared with every task. Documents are read where they lie: each batch of
    them is one sparse product with the block, and only k rows a query leave a
    task, so no pair of a query and a document is ever shuffled. ``weights``
    must hold all terms of a document in one row: (doc_id, terms, ws).
    """
    kind = dict(weights.dtypes)["doc_id"]
    out = None
    for part in _blocks(queries, block):
        rows = part.toPandas()  # the terms of at most ``block`` stated queries
        ids = np.array(sorted(rows["qid"].unique()))
        vocab = {t: i for i, t in enumerate(sorted(rows["term"].unique()))}
        at = np.searchsorted(ids, rows["qid"].to_numpy()) if len(rows) else np.zeros(0, np.int64)
        cols = rows["term"].map(vocab).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        order = np.argsort(cols, kind="stable")
        starts = np.searchsorted(cols[order], np.arange(len(vocab) + 1))
        shared = weights.sparkSession.sparkContext.broadcast((ids, vocab, starts, at[order], rows["wq"].to_numpy(float)[order] if len(rows) else np.zeros(0)))

        def run(batches: Iterator[pd.DataFrame], edge: np.ndarray, shared=shared) -> Iterator[tuple]:
            ids, vocab, starts, who, wq = shared.value
            for b in batches:
                for i in range(0, len(b) if len(ids) else 0, _DOCS):
                    part = b.iloc[i : i + _DOCS]
                    size = part["terms"].str.len().to_numpy()
                    code = np.fromiter((vocab.get(t, -1) for ts in part["terms"] for t in ts), np.int64, int(size.sum()))
                    doc, w = np.repeat(np.arange(len(part)), size)[code >= 0], np.concatenate(part["ws"].to_numpy())[code >= 0]
                    code = code[code >= 0]
                    n = starts[code + 1] - starts[code]  # each term of a document meets the queries that hold it
                    each = np.repeat(np.arange(len(code)), n)
                    at_ = starts[code][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    score = np.bincount(who[at_] * len(part) + doc[each], w[each] * wq[at_], len(ids) * len(part)).reshape(len(ids), len(part))
                    yield from _best(ids, part["doc_id"].to_numpy(), score, k, 0.0, edge)

        def best(batches: Iterator[pd.DataFrame], run=run, shared=shared) -> Iterator[pd.DataFrame]:
            ids = shared.value[0]
            edge = np.full(len(ids), -np.inf)
            return _keep_best(ids, run(batches, edge), k, edge)

        got = weights.select("doc_id", "terms", "ws").mapInPandas(best, f"qid {kind}, doc_id {kind}, score double")
        out = got if out is None else out.unionByName(got)
    return _ranked(out, k)


def _best(ids: np.ndarray, names: np.ndarray, score: np.ndarray, k: int, least: float, edge: np.ndarray) -> Iterator[tuple]:
    """(places of queries, doc_ids, scores) of each query's best ``k`` of a batch above ``least`` and not below ``edge``, ties at the edge all kept."""
    s = np.where(names[None, :] == ids[:, None], -np.inf, score)
    if k < s.shape[1] and not np.isfinite(edge).all():
        low = np.maximum(edge, np.partition(s, -k, axis=1)[:, -k])
    else:
        low = edge
    # Scores are settled to nine places before ties are broken, so the edge is kept with room for that.
    q, d = np.nonzero((s >= low[:, None] - 1e-8) & (s > least))
    yield q, names[d], s[q, d]


#: Rows of (qid, doc_id, score) that a task holds before it drops those beyond the best.
_HELD = 1_000_000


def _keep_best(ids: np.ndarray, parts: Iterator[tuple], k: int, edge: np.ndarray) -> Iterator[pd.DataFrame]:
    """(qid, doc_id, score) of the best ``k`` of each query over all of a task's ``parts``, ties at the edge kept, so no more leave it whatever it reads.

    ``edge`` holds the worst of the best k so far and rises as parts are pruned, so that later parts leave out at once what is below it.
    """

    def prune(rows: list[tuple]) -> tuple:
        q, d, s = (np.concatenate(x) for x in zip(*rows, strict=True))
        by = np.lexsort((-s, q))
        q, d, s = q[by], d[by], s[by]
        full = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
        edge[q[full]] = s[full]
        keep = s >= edge[q] - 1e-8
        return q[keep], d[keep], s[keep]

    held: list[tuple] = []
    n, most = 0, _HELD
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n > most:
            held = [prune(held)]
            n = len(held[0][0])
            most = max(_HELD, 2 * n)
    if held:
        q, d, s = prune(held)
        yield pd.DataFrame({"qid": ids[q], "doc_id": d, "score": s})


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    scored = scored.withColumn("score", F.round("score", 9))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("bigint")).where(F.col("rank") <= k)


def _spread(df: DataFrame) -> DataFrame:
    """Rows by doc_id over all cores: few bytes, much to compute, so small partitions must not be put together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "doc_id")


def _document_vectors(post: DataFrame, wanted: DataFrame, weight: Column) -> DataFrame:
    """(doc_id, terms, ws): the weights of those terms of a document that any query holds; a document's own terms bound the row."""
    used = post.join(wanted, "term").select("doc_id", "term", weight.alias("w"))
    return _spread(used).groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("doc_id", F.col("x.term").alias("terms"), F.col("x.w").alias("ws"))


def bm25_top_k(queries: DataFrame, post: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, block: int = BLOCK) -> DataFrame:
    """(qid, doc_id, score, rank) of the best ``k`` by ``bm25``, exact, scores to nine places, ties by id."""
    df, stats = term_stats(post)
    q = queries.select("qid", "term").distinct()
    wanted = q.select("term").distinct().join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vectors = _document_vectors(post, wanted, idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    return _top_k_by_matrix(vectors, q.withColumn("wq", F.lit(1.0)), k, block)


def tfidf_top_k(queries: DataFrame, post: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(qid, doc_id, score, rank) of the best ``k`` by ``tfidf``, exact, scores to nine places, ties by id."""
    n = post.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    idf = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row
    d = post.join(idf, "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    d = _spread(d).groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    d = d.select("doc_id", F.col("x.term").alias("terms"), F.transform("x.w", lambda w: w / F.col("norm")).alias("ws"))
    w = queries.select("qid", "term", "tf").join(idf, "term").select("qid", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    return _top_k_by_matrix(d, w.join(norm, "qid").select("qid", "term", (F.col("w") / F.col("qn")).alias("wq")), k, block)


def tfidf(queries: DataFrame, post: DataFrame) -> DataFrame:
    """Cosine of (1 + ln tf) (ln((N + 1) / (df + 1)) + 1) weights; queries: (qid, term, tf)."""
    n = post.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weigh = lambda x, who: x.join(df, "term").select(who, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    d, q = weigh(post, "doc_id"), weigh(queries, "qid").withColumnRenamed("w", "wq")
    dn = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qn"))
    dot = q.join(d, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"))
    return dot.join(dn, "doc_id").join(qn, "qid").select("qid", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score")).where("qid <> doc_id")


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact cosine top k of (qid, vector) against (doc_id, vector), self excluded, ties by id.

    The stated queries are taken in blocks of about ``block``, all of them against
    all documents: each Arrow batch of documents is one matrix product with a
    block; only k rows a query leave it.
    """
    d = docs.select("doc_id", "vector")

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    kind = dict(docs.dtypes)["doc_id"]
    out = None
    for part in _blocks(queries.select("qid", "vector"), block):
        rows = [(r.qid, r.vector) for r in part.collect()]  # about ``block`` stated queries
        shared = queries.sparkSession.sparkContext.broadcast((np.array([x for x, _ in rows]), unit(np.array([v for _, v in rows], dtype=np.float64)) if rows else np.zeros((0, 1))))

        def run(batches: Iterator[pd.DataFrame], edge: np.ndarray, shared=shared) -> Iterator[tuple]:
            ids, m = shared.value
            for b in batches:
                if len(ids) and len(b):
                    yield from _best(ids, b["doc_id"].to_numpy(), m @ unit(np.stack(b["vector"].to_numpy()).astype(np.float64)).T, k, -2.0, edge)

        def best(batches: Iterator[pd.DataFrame], run=run, shared=shared) -> Iterator[pd.DataFrame]:
            ids = shared.value[0]
            edge = np.full(len(ids), -np.inf)
            return _keep_best(ids, run(batches, edge), k, edge)

        got = d.mapInPandas(best, f"qid {kind}, doc_id {kind}, score double")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("bigint")).where(F.col("rank") <= k)


def shared_concepts(q: DataFrame, d: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """Concept overlap by an inverted index: (qid, doc_id, shared, score) from (qid, concept) and (doc_id, concept); df: (concept, idf)."""
    hit = q.distinct().join(d.distinct(), "concept").where("qid <> doc_id")
    hit = hit.withColumn("w", F.lit(1.0)) if df is None else hit.join(df, "concept").withColumn("w", F.col("idf"))
    return hit.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
