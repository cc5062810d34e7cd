"""Retrieval, evaluation, statistics, constraint, closure, window and stream queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomgraph.functions import text as T
from loomgraph.model import graph, with_relations
from loomgraph.operators import boolsearch, closure, constraints, faults, metrics, pools, ranking, retrieval, statistics
from loomgraph.session import materialize, release, scratch, spread, table
from loomgraph.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TERMS = """flatten([regexp_extract_all(t, '[a-z0-9]{2,}'), regexp_extract_all(t, '[가-힣]+'),
 flatten(list_transform(list_filter(regexp_extract_all(t, '[가-힣]+'), lambda w: length(w) > 2), lambda w: list_transform(range(1, length(w)), lambda i: substr(w, cast(i as int), 2)))), flatten(list_transform(regexp_extract_all(t, '[぀-ヿ㐀-鿿]+'), lambda w: CASE WHEN length(w) = 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, cast(i as int), 2)) END))])"""
_POST = f"""d AS (SELECT doc_id, {_TERMS} AS ts FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT doc_id AS qid, term, tf FROM p WHERE doc_id % 50 = 0)"""
_BM25 = f"""WITH {_POST}, st AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM p)), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf / (p.tf + 0.9 * (1 - 0.4 + 0.4 * dl / a))) AS score FROM q JOIN p USING (term) JOIN df USING (term), st WHERE qid <> p.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def _terms_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    post = materialize(retrieval.postings(table(spark, d, "documents"), "doc_id", "text"), "postings")
    return post.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "term", "tf"), post


@_q(_BM25)
def search_bm25(spark, d):
    """Every fiftieth document as a query against all documents."""
    q, post = _terms_of(spark, d)
    return retrieval.bm25_top_k(q, post, 10).withColumn("score", F.round("score", 6))


@_q(f"""WITH {_POST}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p), i AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM p, n GROUP BY term, n),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (term)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS m FROM w GROUP BY doc_id),
s AS (SELECT a.doc_id AS qid, b.doc_id, sum(a.w * b.w) / (ma.m * mb.m) AS score FROM w a JOIN w b USING (term) JOIN m ma ON ma.doc_id = a.doc_id JOIN m mb ON mb.doc_id = b.doc_id WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, ma.m, mb.m),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def search_tfidf(spark, d):
    q, post = _terms_of(spark, d)
    return retrieval.tfidf_top_k(q, post, 10).withColumn("score", F.round("score", 6))


_DENSE = """WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "vector")
    return retrieval.dense_top_k(q, e.withColumnRenamed("vec_id", "doc_id"), k)


@_q(_DENSE + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def search_dense(spark, d):
    return _dense(spark, d, 10).withColumn("score", F.round("score", 6))


_RUNS = "r AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 1000)"
_FUSED = f"""WITH {_POST}, st AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM p)), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf / (p.tf + 0.9 * (1 - 0.4 + 0.4 * dl / a))) AS score FROM q JOIN p USING (term) JOIN df USING (term), st WHERE qid <> p.doc_id GROUP BY ALL), {_RUNS},
e AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings), s2 AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), {_RUNS.replace('r AS', 'r2 AS').replace('FROM s)', 'FROM s2)')},
f AS (SELECT qid, doc_id, sum(1.0::double / (60 + rank)) AS score FROM (SELECT * FROM r UNION ALL SELECT * FROM r2) GROUP BY ALL)
SELECT * FROM (SELECT qid, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f) WHERE rank <= 1000"""


def _one_row(spark: SparkSession, d: str) -> bool:
    """Whether each document is one row with an id; else pools are made of joined postings."""
    n, ids = table(spark, d, "documents").agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    return n == ids


def _sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(qid, doc_id, score) with the best ``k`` of every fiftieth document, and few others."""
    if not _one_row(spark, d):
        return retrieval.bm25_top_k(*_terms_of(spark, d), k).select("qid", "doc_id", "score")
    tok = materialize(pools.tokens(spread(table(spark, d, "documents").select("doc_id", "text")), {}), "tokens")
    pool, _ = pools.pools(tok, "doc_id % 50 = 0", k, {})
    release(tok)
    return pool.withColumn("score", F.round("score", 9))


@_q(_FUSED)
def search_fused(spark, d):
    """Reciprocal rank fusion of a sparse and a dense run, whole runs of 1,000 each; vectors and documents share their ids. Both are ranked and fused where a query's rows lie."""
    runs = [_sparse(spark, d, 1000).withColumn("arm", F.lit(0)), _dense(spark, d, 1000).select("qid", "doc_id", (-F.col("rank")).cast("double").alias("score"), F.lit(1).alias("arm"))]
    rows = runs[0].unionByName(runs[1]).repartition("qid")
    run = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid", "arm").orderBy(F.desc("score"), "doc_id"))).where("rank <= 1000")
    both = ranking.rrf([run], limit=None).withColumn("score", F.round("score", 12))
    return ranking.top_k(both, 1000).withColumn("score", F.round("score", 9))


@_q("SELECT doc_id FROM documents WHERE (contains(lower(text), 'gas inlet') OR contains(lower(text), '가스유입구')) AND regexp_matches(lower(text), '(^|[^a-z0-9])(chlor|염소)') AND NOT contains(lower(text), '질화갈륨') UNION SELECT doc_id FROM documents WHERE contains(lower(text), '가스유입구') AND contains(lower(text), '염소') AND NOT contains(lower(text), '질화갈륨') UNION SELECT doc_id FROM documents WHERE contains(lower(text), 'gas inlet') AND contains(lower(text), '염소') AND NOT contains(lower(text), '질화갈륨')")
def search_boolean(spark, d):
    t = boolsearch.parse('("gas inlet" + 가스유입구) * (chlor + 염소) !질화갈륨')
    return table(spark, d, "documents").where(boolsearch.matches(t, [F.col("text")])).select("doc_id")


_QREL = "j AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, count(*) OVER (PARTITION BY a.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), t AS (SELECT * FROM r WHERE rank <= 100), k AS (SELECT j.*, t.rank FROM j LEFT JOIN t USING (qid, doc_id))"


@_q(_DENSE + f", {_QREL} SELECT qid, max(n) AS n_relevant, sum(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END)::double / max(n) AS recall_10, sum(CASE WHEN rank <= 100 THEN 1.0 ELSE 0 END)::double / max(n) AS recall_100, max(CASE WHEN rank <= 10 THEN 1.0::double ELSE 0 END) AS success_10, max(CASE WHEN rank <= 100 THEN 1.0::double ELSE 0 END) AS success_100, coalesce(1.0::double / min(CASE WHEN rank <= 100 THEN rank END), 0) AS rr, round(sum(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, cast(least(max(n), 20) AS bigint) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg FROM k GROUP BY qid")
def eval_per_query(spark, d):
    """Dense runs judged by equal labels."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    qrel = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").where("qid <> doc_id").select("qid", "doc_id")
    return metrics.per_query(_dense(spark, d, 100), qrel).withColumn("ndcg", F.round("ndcg", 9))


_RATE = "SELECT user_id AS item, event_type AS rater, round(value) AS v FROM events"


@_q("WITH c AS (SELECT user_id AS item, event_type AS label, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT item, sum(n) AS r, sum(n * (n - 1)) AS a FROM c GROUP BY item), s AS (SELECT label, sum(n) AS c FROM c GROUP BY label) SELECT count(*) AS items, round(avg(CASE WHEN r > 1 THEN a / (r * (r - 1)) END), 9) AS p_bar, round((SELECT sum(power(c / (SELECT sum(c) FROM s), 2)) FROM s), 9) AS p_e FROM p")
def agreement_fleiss(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return statistics.fleiss_kappa(c).select("items", F.round("p_bar", 9).alias("p_bar"), F.round("p_e", 9).alias("p_e"))


@_q("WITH u AS (SELECT user_id, count(value) AS m, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY user_id HAVING count(value) >= 2), a AS (SELECT sum(m) AS n, sum((2 * m * q - 2 * s * s) / (m - 1)) AS d, sum(s) AS s, sum(q) AS q FROM u) SELECT cast(n AS bigint) AS n, round(1 - (d / n) / ((2 * n * q - 2 * s * s) / (n * (n - 1))), 6) AS alpha FROM a")
def agreement_krippendorff(spark, d):
    return statistics.krippendorff_interval(table(spark, d, "events").select(F.col("user_id").alias("item"), "value")).select("n", F.round("alpha", 6).alias("alpha"))


@_q("WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'A' ELSE l_returnflag END AS l_returnflag, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END AS l_linestatus FROM lineitem) GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), o AS (SELECT sum(n) AS o FROM c WHERE x = y), e AS (SELECT sum(a.s * b.s) AS e FROM (SELECT x, sum(n) AS s FROM c GROUP BY x) a JOIN (SELECT y, sum(n) AS s FROM c GROUP BY y) b ON a.x = b.y) SELECT cast(t AS bigint) AS n, round(o / t, 9) AS observed, round(e / (t::double * t), 9) AS expected, round((o / t - e / (t::double * t)) / (1 - e / (t::double * t)), 9) AS kappa FROM t, o, e")
def agreement_cohen(spark, d):
    x = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "A").otherwise(F.col("l_returnflag")).alias("a"), F.when(F.col("l_linestatus") == "O", "N").otherwise("A").alias("b"))
    k = statistics.cohen_kappa(x, "a", "b")
    return k.select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


_TREE = "e AS (SELECT DISTINCT patent_id AS child, ipc_code AS parent FROM ipc_links UNION SELECT DISTINCT ipc_code, ipc_4digit FROM ipc_links UNION SELECT DISTINCT ipc_4digit, ipc_section FROM ipc_links), c AS (SELECT child AS node, child AS ancestor, 0 AS steps FROM e UNION SELECT parent, parent, 0 FROM e UNION SELECT c.node, e.parent, c.steps + 1 FROM c JOIN e ON e.child = c.ancestor), m AS (SELECT node, ancestor, min(steps) AS steps FROM c GROUP BY ALL)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "ipc_links")
    pairs = [("patent_id", "ipc_code"), ("ipc_code", "ipc_4digit"), ("ipc_4digit", "ipc_section")]
    out = None
    for a, b in pairs:
        x = i.select(F.col(a).alias("child"), F.col(b).alias("parent"))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


@_q("WITH RECURSIVE " + _TREE + " SELECT ancestor, steps, count(*) AS n FROM m WHERE steps > 0 GROUP BY ALL")
def closure_counts(spark, d):
    """How many nodes lie below each node, by least distance."""
    return closure.ancestors(_tree(spark, d)).where("steps > 0").groupBy("ancestor", "steps").agg(F.count(F.lit(1)).alias("n"))


@_q("WITH RECURSIVE " + _TREE + ", r AS (SELECT DISTINCT parent AS n FROM e WHERE parent NOT IN (SELECT child FROM e)), d AS (SELECT node, cast(min(steps) + 1 AS bigint) AS depth FROM m JOIN r ON r.n = ancestor GROUP BY node) SELECT depth, count(*) AS n_nodes FROM d GROUP BY depth")
def closure_depths(spark, d):
    e = materialize(_tree(spark, d), "edges")
    return closure.min_depth(e, closure.ancestors(e)).groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


@_q(with_relations("SELECT path, rule, count(*) AS n FROM (SELECT p.s, 'filingDate' AS path, 'count' AS rule FROM (SELECT s FROM r_a WHERE o = 'Patent') p LEFT JOIN r_filingDate d ON d.s = p.s GROUP BY p.s HAVING count(d.o) <> 1 UNION ALL SELECT p.s, 'realizesProcess', 'count' FROM (SELECT s FROM r_a WHERE o = 'Patent') p LEFT JOIN r_realizesProcess d ON d.s = p.s GROUP BY p.s HAVING count(d.o) < 1 OR count(d.o) > 4 UNION ALL SELECT s, 'claimCount', 'maxInclusive' FROM r_claimCount WHERE cast(o AS int) > 20 UNION ALL SELECT s, 'rejectedFor', 'in' FROM r_rejectedFor WHERE o NOT IN ('§29', '§36')) z GROUP BY ALL"))
def constraint_violations(spark, d):
    g = graph(spark, d)
    props = [constraints.Property(g.predicate("filingDate"), "filingDate", 1, 1), constraints.Property(g.predicate("realizesProcess"), "realizesProcess", 1, 4), constraints.Property(g.predicate("claimCount"), "claimCount", at_most=20), constraints.Property(g.predicate("rejectedFor"), "rejectedFor", one_of=("§29", "§36"))]
    v = constraints.check(constraints.Shape("PatentShape", g.match(("?s", "a:patent", "Patent")), props))
    return v.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


@_q("SELECT family_id, count(DISTINCT lower(trim(split))) AS n_splits FROM splits WHERE family_id IS NOT NULL GROUP BY family_id HAVING count(DISTINCT lower(trim(split))) > 1")
def leakage_families(spark, d):
    return constraints.family_crossing(table(spark, d, "splits").withColumn("split", F.lower(F.trim("split"))))


@_q("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS g, count(*) OVER (PARTITION BY o_custkey, o_totalprice) AS z FROM orders) SELECT o_custkey AS qid, o_orderkey AS doc_id, pos, g AS group_start, z AS group_size, greatest(0, least(z, 3 - g + 1))::double / z AS expected FROM r WHERE pos <= 3")
def rank_tie_bands(spark, d):
    """A top-k report: the three dearest orders of each customer with their chance to be among them under ties."""
    t = ranking.tie_groups(table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))).where("pos <= 3")
    return t.select("qid", "doc_id", "pos", "group_start", "group_size", ranking.tie_band(F.col("group_start"), F.col("group_size"), 3)[0].alias("expected"))


@_q("WITH r AS (SELECT l_suppkey AS qid, l_orderkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM r), f AS (SELECT qid, o_custkey AS family_id, min(rank) AS first, min_by(doc_id, rank) AS representative FROM k JOIN orders ON o_orderkey = doc_id GROUP BY ALL) SELECT qid, cast(family_id AS varchar) AS family_id, representative, row_number() OVER (PARTITION BY qid ORDER BY first, cast(family_id AS varchar)) AS rank FROM f")
def rank_fold_families(spark, d):
    run = ranking.ranked(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("score")))
    fam = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("family_id"))
    return ranking.fold(run, fam).select("qid", "family_id", "representative", "rank")


@_q("SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) AS q3, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_quartiles(spark, d):
    q = F.percentile("l_quantity", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select("l_returnflag", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"), "n")


@_q("WITH c AS (SELECT process_family AS f, coalesce(examination_status, '') AS s, count(*) AS n FROM patents_meta GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, s) AS k FROM c) SELECT f AS process_family, s AS mode_status, n FROM r WHERE k = 1")
def agg_mode(spark, d):
    """Mode with lexical tie-break."""
    c = table(spark, d, "patents_meta").groupBy("process_family", F.coalesce("examination_status", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("process_family").agg(F.min(F.struct((-F.col("n")).alias("k"), "s")).alias("m"))
    return m.select("process_family", F.col("m.s").alias("mode_status"), (-F.col("m.k")).alias("n"))


@_q("WITH x AS (SELECT patent_id, unnest(string_split(rejection_legal_bases, '|')) AS b FROM patents_meta WHERE rejection_legal_bases <> ''), n AS (SELECT count(DISTINCT patent_id)::double AS n FROM x), y AS (SELECT DISTINCT patent_id, substr(b, 1, 3) AS b FROM x), c AS (SELECT b, count(*) AS c FROM y GROUP BY b) SELECT p.b AS a, q.b AS b, count(*) AS n_both, round(count(*) * max(n) / (max(cp.c) * max(cq.c)), 9) AS lift FROM y p JOIN y q ON p.patent_id = q.patent_id AND p.b < q.b JOIN c cp ON cp.b = p.b JOIN c cq ON cq.b = q.b, n GROUP BY p.b, q.b")
def agg_cooccurrence_lift(spark, d):
    """Pairs of legal bases within a patent: the pairs of one patent are bounded by the statute."""
    y = table(spark, d, "patents_meta").where("rejection_legal_bases <> ''").select("patent_id", F.explode(F.array_distinct(F.transform(F.split("rejection_legal_bases", "[|]"), lambda x: F.substring(x, 1, 3)))).alias("b"))
    c = y.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    n = y.agg(F.countDistinct("patent_id").alias("n"))
    pairs = y.withColumnRenamed("b", "a").join(y, "patent_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    return pairs.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").crossJoin(F.broadcast(n)).select("a", "b", "n_both", F.round(F.col("n_both") * F.col("n") / (F.col("ca") * F.col("cb")), 9).alias("lift"))


@_q("WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS c, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS t FROM orders) SELECT o_orderkey, CASE WHEN c <= t * 0.6 THEN 'train' WHEN c <= t * 0.8 THEN 'dev' ELSE 'test' END AS split FROM x")
def window_cumulative_split(spark, d):
    """60/20/20 by running sum in order of date."""
    w = W.partitionBy("o_custkey")
    x = table(spark, d, "orders").withColumn("c", F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0))).withColumn("t", F.sum("o_totalprice").over(w))
    return x.select("o_orderkey", F.when(F.col("c") <= F.col("t") * 0.6, "train").when(F.col("c") <= F.col("t") * 0.8, "dev").otherwise("test").alias("split"))


@_q("SELECT record_id, CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN x END AS iso, coalesce(cast(replace(CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN x END, '-', '') AS int), 0) AS as_int FROM (SELECT record_id, regexp_replace(trim(filing_date), '^([0-9]{4})[.-]?([0-9]{2})[.-]?([0-9]{2})$', '\\1-\\2-\\3') AS x FROM cited_enriched)")
def text_dates(spark, d):
    return table(spark, d, "cited_enriched").select("record_id", T.iso_date("filing_date").alias("iso"), T.int_date("filing_date").alias("as_int"))


@_q("SELECT patent_id, ipc_code, substr(ipc_code, 1, 3) AS class3, split_part(ipc_code, '/', 1) AS main_group FROM ipc_links")
def text_ipc_levels(spark, d):
    lv = T.ipc_levels("ipc_code")
    return table(spark, d, "ipc_links").select("patent_id", "ipc_code", lv[1].alias("class3"), lv[3].alias("main_group"))


@_q("SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END AS script FROM documents")
def text_language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language("text").alias("script"))


@_q("SELECT patent_id, x AS paragraph FROM (SELECT DISTINCT patent_id, unnest(list_transform(regexp_extract_all(rejection_legal_bases, '§([0-9]+)', 1), lambda y: cast(y AS int))) AS x FROM patents_meta)")
def text_legal_paragraphs(spark, d):
    return table(spark, d, "patents_meta").select("patent_id", F.explode(T.legal_paragraphs("rejection_legal_bases")).alias("paragraph"))


_EACH = r"list_filter(list_transform(string_split(regexp_replace(claims_full, '(^|\n)\s*([0-9]{1,3}\s*[.．]\s)', chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0)"


@_q(f"SELECT doc_id, i - 1 AS claim_no, list_distinct_in_order(x) AS parents, length(x) AS n_chars FROM c".replace("list_distinct_in_order(x)", "list_transform(list_filter(list_zip(p, range(1, len(p) + 1)), lambda z: list_position(p, z[1]) = z[2]), lambda z: z[1])").replace(" FROM c", f" FROM (SELECT *, list_transform(regexp_extract_all(x, '제\\s?([0-9]+)\\s?항', 1) || regexp_extract_all(lower(x), 'claims?\\s+([0-9]+)', 1) || regexp_extract_all(x, '請求項\\s?([0-9]+)', 1), lambda y: cast(y AS int)) AS p FROM (SELECT doc_id, unnest({_EACH}) AS x, unnest(range(1, len({_EACH}) + 1)) AS i FROM (SELECT DISTINCT doc_id, claims_full FROM claim_texts)))"))
def text_claims(spark, d):
    """Claims of each text with their parents."""
    c = table(spark, d, "claim_texts").dropDuplicates(["doc_id", "claims_full"]).select("doc_id", F.posexplode(T.split_claims("claims_full")).alias("claim_no", "claim"))
    return c.select("doc_id", "claim_no", T.claim_parents("claim").alias("parents"), F.length("claim").alias("n_chars"))


@_q()
def text_citation_parts(spark, d):
    return table(spark, d, "citations").select("citation_id", T.citation_parts("raw").alias("p")).select("citation_id", "p.*")


_MERGED = ["realizesProcess", "concernsDevice", "assignedTo", "status"]


@_q(with_relations("SELECT b.p, b.n AS n_before, c.n AS n_after FROM (SELECT p, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT s, '{p}' AS p, o FROM r_{p}" for p in _MERGED) + ") t GROUP BY p) b LEFT JOIN (WITH t AS (" + " UNION ALL ".join(f"SELECT s, '{p}' AS p, o FROM r_{p}" for p in _MERGED) + "), e AS (SELECT s AS node, '>' || p || '|' || o AS x FROM t UNION SELECT o, '<' || p || '|' || s FROM t), g AS (SELECT node, string_agg(x, chr(1) ORDER BY x) AS sig FROM e GROUP BY node), m AS (SELECT node AS old, min(node) OVER (PARTITION BY sig) AS new, count(*) OVER (PARTITION BY sig) AS n FROM g), a AS (SELECT DISTINCT coalesce(x.new, s) AS s, p, coalesce(y.new, o) AS o FROM t LEFT JOIN m x ON x.old = s AND x.n > 1 LEFT JOIN m y ON y.old = o AND y.n > 1) SELECT p, count(*) AS n FROM a GROUP BY p) c USING (p)"))
def fault_merge_duplicates(spark, d):
    """Nodes of one signature merged into the least of them; triples before and after."""
    t = materialize(graph(spark, d).triples(_MERGED), "triples")
    s = faults.signatures(t)
    m = s.join(s.groupBy("signature").agg(F.min("node").alias("new"), F.count(F.lit(1)).alias("n")).where("n > 1"), "signature").select(F.col("node").alias("old"), "new")
    after = faults.merge_entities(t, m)
    return t.groupBy("p").agg(F.count(F.lit(1)).alias("n_before")).join(after.groupBy("p").agg(F.count(F.lit(1)).alias("n_after")), "p", "left")


@_q()
def fault_deleted_edges(spark, d):
    t = graph(spark, d).triples(["realizesProcess", "hasPriorArt"])
    return faults.delete_edges(t, "hasPriorArt", 0.1).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@_q("SELECT date_trunc('day', ts)::timestamp AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """A stream over the events table to its end: tumbling windows in complete mode, so every window is kept and the watermark drops nothing."""
    path = scratch(spark, "stream")
    events = table(spark, d, "events")
    s = windows.windowed_counts(windows.read_stream(spark, f"{d}/events.parquet*", events.schema), "ts", "event_type", late="3650 days")
    windows.run_batches_complete(s, path)
    return spark.read.parquet(f"{path}/out")


@_q("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, k")
def stream_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")
