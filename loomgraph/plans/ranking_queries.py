"""Queries of re-ranking, coverage and linking, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.operators import closure, linking, pools, ranking, rerank, retrieval
from loomgraph.plans.analysis import _POST, _RUNS, _one_row, _terms_of
from loomgraph.session import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """(id, concept, code) of documents by their patent."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "patent_id").where("patent_id is not null")
    return docs.join(table(spark, d, "ipc_links").select("patent_id", F.col("ipc_4digit").alias("concept"), F.col("ipc_code").alias("code")), "patent_id").drop("patent_id")


def _nodes(spark: SparkSession, d: str, concepts: DataFrame) -> DataFrame:
    i = table(spark, d, "ipc_links")
    tree = i.select(F.col("ipc_4digit").alias("child"), F.col("ipc_section").alias("parent")).unionByName(i.select(F.col("ipc_section").alias("child"), F.lit("*").alias("parent"))).distinct()
    up = closure.ancestors(tree)
    return rerank.concept_nodes(concepts, up, closure.min_depth(tree, up))


def _features(spark: SparkSession, d: str) -> DataFrame:
    c = materialize(_codes(spark, d), "codes")
    nodes = _nodes(spark, d, c.select("id", "concept"))
    prefixes = c.select("id", F.explode(rerank.code_prefixes(F.col("code"))).alias("p")).groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("prefixes"))
    return nodes.join(prefixes, "id")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    q, post = _terms_of(spark, d)
    pool = retrieval.bm25_top_k(q, post, 1000).select("qid", "doc_id", "rank")
    return materialize(rerank.components(pool, _features(spark, d)), "parts")


_PARTS = "qid bigint, doc_id bigint, text double, concept double, path double, code double"


def _looked(spark: SparkSession, d: str, look, schema: str = _PARTS, keep=lambda _: True, vectors: DataFrame | None = None) -> DataFrame:
    """What ``look`` gives of the pool of a thousand of every fiftieth document; documents of one patent have its sets, equal sets are one class."""
    docs, links = table(spark, d, "documents"), table(spark, d, "ipc_links").where("patent_id is not null")
    prefixes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(rerank.code_prefixes(F.col("ipc_code"))))))
    sets = materialize(links.groupBy("patent_id").agg(F.array_sort(F.collect_set("ipc_4digit")).alias("concepts"), prefixes.alias("prefixes")), "sets")
    cm, cc = rerank.set_classes(sets.select("patent_id", F.col("concepts").alias("items")), "patent_id")
    pm, pc = rerank.set_classes(sets.select("patent_id", F.col("prefixes").alias("items")), "patent_id")
    of = docs.select("patent_id").where("patent_id is not null").distinct().join(cm.withColumnRenamed("cid", "cs"), "patent_id", "left").join(pm.withColumnRenamed("cid", "ps"), "patent_id", "left")
    of = materialize(of.withColumn("pat", F.monotonically_increasing_id()), "patents")  # written once, so the numbers stay
    meta, extra = docs.select("doc_id", "patent_id").join(of, "patent_id", "left").drop("patent_id"), {"cs": "bigint", "ps": "bigint", "pat": "bigint"}
    if vectors is not None:
        meta, extra = meta.join(vectors.select(F.col("vec_id").alias("doc_id"), F.lit(1).cast("bigint").alias("has")).distinct(), "doc_id", "left").na.fill(0, ["has"]), extra | {"has": "bigint"}
    meta = meta.na.fill(-1, ["cs", "ps", "pat"])
    tok = materialize(pools.tokens(docs.select("doc_id", "text").join(meta, "doc_id"), extra), "tokens")
    pool, queries = pools.pools(tok, "doc_id % 50 = 0", 1000, extra)
    seen = cc.select(F.explode("items").alias("concept")).distinct().select(F.col("concept").alias("id"), "concept")
    nodes = materialize(_nodes(spark, d, seen).select(F.inline("concepts")), "nodes")
    return materialize(pools.by_query(pool, queries, 1000, pools.similar(nodes, cc, pc, keep), look, schema), "parts")


def _best(spark: SparkSession, d: str, weights: dict[str, float], alpha: float = 0.75) -> DataFrame:
    """What of ``_parts`` can be among the best hundred under ``weights``."""
    return _looked(spark, d, pools.best_of(weights, alpha, 100)) if _one_row(spark, d) else _parts(spark, d)


_PREFIX = "list_distinct(list_filter([substr(t, 1, 1), CASE WHEN length(t) >= 3 THEN substr(t, 1, 3) END, nullif(regexp_extract(t, '^(.{3}[A-Za-z]+)', 1), ''), split_part(t, '-', 1), t], lambda x: x IS NOT NULL AND x <> ''))"
_SETS = f"""cd AS (SELECT DISTINCT doc_id AS id, ipc_4digit AS c, ipc_section AS sec, replace(regexp_replace(trim(ipc_code), '\\s|\\(.*\\)', '', 'g'), '/', '-') AS t FROM documents JOIN ipc_links USING (patent_id)),
cs AS (SELECT id, list(DISTINCT c) AS cs FROM cd GROUP BY id), ps AS (SELECT id, list(DISTINCT p) AS ps FROM (SELECT id, unnest({_PREFIX}) AS p FROM cd) GROUP BY id)"""
_COMPONENTS = f"""WITH {_POST}, st AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM p)), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf / (p.tf + 0.9 * (1 - 0.4 + 0.4 * dl / a))) AS score FROM q JOIN p USING (term) JOIN df USING (term), st WHERE qid <> p.doc_id GROUP BY ALL), {_RUNS}, {_SETS},
m AS (SELECT qid, max(rank) AS m FROM r GROUP BY qid),
k AS (SELECT r.qid, r.doc_id, CASE WHEN m <= 1 THEN 1.0 ELSE 1.0::double - (rank - 1.0::double) / (m - 1) END AS text, coalesce(len(list_intersect(a.cs, b.cs))::double / len(list_distinct(a.cs || b.cs)), 0) AS concept,
 coalesce(len(list_intersect(x.ps, y.ps))::double / len(list_distinct(x.ps || y.ps)), 0) AS code,
 coalesce(list_sum(list_transform(a.cs, lambda u: list_max(list_transform(b.cs, lambda v: CASE WHEN u = v THEN 1.0::double WHEN u[1] = v[1] THEN 4.0::double / 6 ELSE 2.0::double / 6 END)))) / len(a.cs), 0) AS path
 FROM r JOIN m USING (qid) LEFT JOIN cs a ON a.id = r.qid LEFT JOIN cs b ON b.id = r.doc_id LEFT JOIN ps x ON x.id = r.qid LEFT JOIN ps y ON y.id = r.doc_id)"""
_SCORED = "SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round({}, 9) AS score FROM {})) WHERE rank <= 100"


@_q(_COMPONENTS + _SCORED.format("0.25 * text + 0.75 * (0.5 * concept + 0.5 * code)", "k"))
def rerank_p0(spark, d):
    """Text and ontology: the best hundred of a pool of a thousand a query (a top-k report)."""
    return rerank.rerank(_best(spark, d, {"concept": 0.5, "code": 0.5})).where("rank <= 100")


@_q(_COMPONENTS + _SCORED.format("0.25 * text + 0.75 * (0.25 * concept + 0.5 * path + 0.25 * code)", "k"))
def rerank_path(spark, d):
    weights = {"concept": 0.25, "path": 0.5, "code": 0.25}
    return rerank.rerank(_best(spark, d, weights), 0.75, weights).where("rank <= 100")


_FC = ", e AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings), f AS (SELECT k.*, CASE WHEN round(list_dot_product(a.v, b.v), 9) >= 0.2 THEN 1.0 ELSE 0 END AS feature FROM k LEFT JOIN e a ON a.vec_id = k.qid LEFT JOIN e b ON b.vec_id = k.doc_id) "


@_q(_COMPONENTS + _FC + _SCORED.format("0.25 * text + 0.75 * (0.25 * concept + 0.25 * code + 0.5 * feature)", "f"))
def rerank_p1(spark, d):
    """As rerank_p0, with the coverage of the query's features by the document's; a document's vector is its one feature."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    parts = _looked(spark, d, pools.best_of({"concept": 0.25, "code": 0.25}, 0.75, 100, 0.375), vectors=e) if _one_row(spark, d) else _parts(spark, d)
    q = parts.select("qid").distinct().join(e.withColumnRenamed("vec_id", "qid"), "qid").withColumn("fid", F.lit(0))
    fc = rerank.feature_coverage(parts, q, e.withColumnRenamed("vec_id", "doc_id"), 0.2)
    full = parts.join(fc.withColumnRenamed("coverage", "feature"), ["qid", "doc_id"], "left").fillna(0.0, ["feature"])
    return rerank.rerank(full, 0.75, {"concept": 0.25, "code": 0.25, "feature": 0.5}).where("rank <= 100")


_ABLATED = "(SELECT k.qid, k.doc_id, text, coalesce(len(list_intersect(x.cs, y.cs))::double / len(list_distinct(x.cs || y.cs)), 0) AS concept FROM k LEFT JOIN hs x ON x.id = k.qid LEFT JOIN hs y ON y.id = k.doc_id)"


@_q(_COMPONENTS + ", hs AS (SELECT id, list(DISTINCT c) AS cs FROM cd WHERE sec = 'H' GROUP BY id) " + _SCORED.format("0.25 * text + 0.75 * concept", _ABLATED))
def rerank_one_axis(spark, d):
    """Ablation: concepts of one axis only, no codes."""
    if _one_row(spark, d):
        parts = _looked(spark, d, pools.best_of({"concept": 1.0}, 0.75, 100), keep=lambda x: x.startswith("H"))
    else:
        q, post = _terms_of(spark, d)
        pool = retrieval.bm25_top_k(q, post, 1000).select("qid", "doc_id", "rank")
        parts = rerank.components(pool, _features(spark, d).withColumn("concepts", F.filter("concepts", lambda x: x["concept"].startswith("H"))))
    return rerank.rerank(parts, 0.75, {"concept": 1.0}).where("rank <= 100")


_GRID = "g AS (SELECT a.x AS alpha, b.x AS w_concept, c.x AS w_path, 1 - b.x - c.x AS w_code FROM (VALUES (0.25), (0.5), (0.75)) a(x), (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) b(x), (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) c(x) WHERE b.x + c.x <= 1)"
_SAME_PATENT = "qr AS (SELECT a.doc_id AS qid, b.doc_id FROM documents a JOIN documents b USING (patent_id) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id)"


@_q(_COMPONENTS + f", {_GRID}, {_SAME_PATENT}, n AS (SELECT qid, count(*) AS n FROM qr GROUP BY qid), o AS (SELECT g.*, k.qid, k.doc_id, row_number() OVER (PARTITION BY alpha, w_concept, w_path, w_code, qid ORDER BY round((1 - alpha::double) * text + alpha::double * (w_concept::double * concept + w_path::double * path + w_code::double * code), 9) DESC, doc_id) AS rank FROM k, g), h AS (SELECT alpha, w_concept, w_path, w_code, sum(1.0::double / n) AS s FROM o JOIN qr USING (qid, doc_id) JOIN n USING (qid) WHERE rank <= 100 GROUP BY ALL) SELECT g.alpha::double AS alpha, g.w_concept::double AS w_concept, g.w_path::double AS w_path, g.w_code::double AS w_code, round(coalesce(s, 0) / (SELECT count(*) FROM n), 9) AS recall FROM g LEFT JOIN h USING (alpha, w_concept, w_path, w_code)")
def grid_search(spark, d):
    """Every setting of alpha and weights with its recall at a hundred; relevant are documents of the same patent."""
    docs = table(spark, d, "documents").select("doc_id", "patent_id")
    qrel = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid").join(docs, "patent_id").where("qid <> doc_id").select("qid", "doc_id")
    names, alphas = ["concept", "path", "code"], [0.25, 0.5, 0.75]
    if not _one_row(spark, d):
        return rerank.grid_search(_parts(spark, d), qrel, names, alphas)
    grid, key = rerank.settings(spark, names, alphas)
    rows = [tuple(r) for r in grid.collect()]  # some dozens
    hits = _looked(spark, d, pools.hits_of(rows, names, 100), "setting bigint, qid bigint, h bigint")
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "setting bigint, " + ", ".join(f"{c} double" for c in key))
    return rerank.recalls(grid, key, hits.join(F.broadcast(numbered), "setting").drop("setting"), qrel)


_ARM = "nq AS (SELECT id, count(*) AS n FROM ks GROUP BY id), j AS (SELECT a.id AS qid, b.id AS doc_id, count(*) AS common, max(length(a.key)) AS longest FROM ks a JOIN ks b USING (key) WHERE a.id % 50 = 0 AND a.id <> b.id GROUP BY ALL), s AS (SELECT qid, doc_id, round(common::double / (x.n + y.n - common), 9) AS score FROM j JOIN nq x ON x.id = qid JOIN nq y ON y.id = doc_id WHERE longest >= {}) SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 100"


def _arm(spark: SparkSession, d: str, keys: Column, least: int, asked: str) -> DataFrame:
    """``keys`` of a link, an array: sets are made once a patent, documents take those of theirs; documents ``asked`` are the queries."""
    one = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    of = table(spark, d, "ipc_links").groupBy("patent_id").agg(one(keys).alias("items"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "patent_id")
    sets = materialize(docs.join(of, "patent_id").groupBy("id").agg(one(F.col("items")).alias("items")).where(F.size("items") > 0), "keys")
    return rerank.arm_of_sets(sets.where(asked).withColumnRenamed("id", "qid"), sets.withColumnRenamed("id", "doc_id"), 100, least)


@_q(f"WITH {_SETS}, ks AS (SELECT DISTINCT id, p AS key FROM (SELECT id, unnest({_PREFIX}) AS p FROM cd)), " + _ARM.format(4))
def run_b4(spark, d):
    """Codes alone: candidates share a prefix of a subclass or more."""
    return _arm(spark, d, rerank.code_prefixes(F.col("ipc_code")), 4, "id % 50 = 0")


@_q(f"WITH {_SETS}, ks AS (SELECT DISTINCT id, c AS key FROM cd), " + _ARM.format(0).replace("a.id % 50 = 0 AND ", ""))
def run_b5(spark, d):
    """Concepts alone, every document as a query."""
    return _arm(spark, d, F.array("ipc_4digit"), 0, "id is not null")


_PROFILES = "pr AS (SELECT DISTINCT patent_id AS qid, ipc_section AS profile, ipc_4digit AS concept FROM ipc_links JOIN patents_meta USING (patent_id) WHERE cast(application_number AS bigint) % 50 = 0), di AS (SELECT DISTINCT upper(trim(cited_doc_id)) AS doc_id, unnest(regexp_extract_all(ipc, '[A-H][0-9]{2}[A-Z]')) AS concept FROM cited_enriched WHERE trim(cited_doc_id) <> ''), pn AS (SELECT qid, profile, count(*) AS n FROM pr GROUP BY ALL), cv AS (SELECT qid, doc_id, max({'score': c::double / n, 'shared': c}) AS m FROM (SELECT qid, profile, doc_id, count(*) AS c FROM pr JOIN di USING (concept) GROUP BY ALL) JOIN pn USING (qid, profile) GROUP BY ALL)"


def _layer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of every patent whose number is divisible by 50, a section each, and the concepts of all cited documents."""
    p = table(spark, d, "ipc_links").join(table(spark, d, "patents_meta").where("cast(application_number as bigint) % 50 = 0").select("patent_id"), "patent_id").select(F.col("patent_id").alias("qid"), F.col("ipc_section").alias("profile"), F.col("ipc_4digit").alias("concept"))
    c = table(spark, d, "cited_enriched").where("trim(cited_doc_id) <> ''").select(F.upper(F.trim("cited_doc_id")).alias("doc_id"), F.explode(F.regexp_extract_all("ipc", F.lit("[A-H][0-9]{2}[A-Z]"), 0)).alias("concept"))
    return p, materialize(c.distinct(), "disclosed")


@_q(f"WITH {_PROFILES} SELECT * FROM (SELECT qid, doc_id, round(m.score, 9) AS score, m.shared AS shared, row_number() OVER (PARTITION BY qid ORDER BY round(m.score, 9) DESC, m.shared DESC, doc_id) AS rank FROM cv) WHERE rank <= 100")
def coverage_rank(spark, d):
    return rerank.coverage_top_k(*_layer(spark, d), 100)


@_q(f"WITH {_PROFILES} SELECT qid, count(*) AS n_exist, count(*) FILTER (m.score >= 1) AS n_all, count(*) FILTER (m.score >= 1) > 0 AND count(*) FILTER (m.score >= 1) <= 50 AS small FROM cv GROUP BY qid")
def reach_sizes(spark, d):
    """Sizes of both reaches of each query, and whether the conjunctive one is hit with at most fifty documents (SPR@50 is its mean)."""
    r = rerank.reach_counts(*_layer(spark, d))
    return r.withColumn("small", (F.col("n_all") > 0) & (F.col("n_all") <= 50))


@_q(f"WITH {_PROFILES}, es AS (SELECT DISTINCT qid, concept FROM pr), en AS (SELECT qid, count(*) AS n FROM es GROUP BY qid), ci AS (SELECT DISTINCT target_patent_id AS qid, upper(trim(cited_doc_id)) AS doc_id FROM prior_art_edges WHERE source_type = 'examiner' AND trim(cited_doc_id) <> ''), kn AS (SELECT ci.* FROM ci SEMI JOIN di USING (doc_id) SEMI JOIN es USING (qid)), he AS (SELECT kn.qid, kn.doc_id, list(DISTINCT di.concept) FILTER (es.concept IS NOT NULL) AS h FROM kn JOIN di USING (doc_id) LEFT JOIN es ON es.qid = kn.qid AND es.concept = di.concept GROUP BY ALL) SELECT a.qid, max(n) AS n, round(max(coalesce(len(a.h), 0)) / max(n)::double, 9) AS best_single, round(max(len(list_distinct(coalesce(a.h, []) || coalesce(b.h, [])))) / max(n)::double, 9) AS best_pair, round((max(len(list_distinct(coalesce(a.h, []) || coalesce(b.h, [])))) - max(coalesce(len(a.h), 0))) / max(n)::double, 9) AS delta FROM he a JOIN he b USING (qid) JOIN en USING (qid) GROUP BY a.qid")
def pair_gain(spark, d):
    p, c = _layer(spark, d)
    cited = table(spark, d, "prior_art_edges").where("source_type = 'examiner' and trim(cited_doc_id) <> ''").select(F.col("target_patent_id").alias("qid"), F.upper(F.trim("cited_doc_id")).alias("doc_id"))
    return rerank.pair_gain(p, cited, c)


@_q("WITH c AS (SELECT DISTINCT ipc_code AS code FROM ipc_links), p AS (SELECT DISTINCT ipc_section AS prefix FROM ipc_links UNION SELECT DISTINCT ipc_4digit FROM ipc_links WHERE ipc_section IN ('H', 'G')), j AS (SELECT code, prefix, row_number() OVER (PARTITION BY code ORDER BY length(prefix) DESC) AS n FROM c JOIN p ON starts_with(code, prefix)) SELECT code, prefix, 'c/' || prefix AS concept FROM j WHERE n = 1")
def link_longest_prefix(spark, d):
    i = table(spark, d, "ipc_links")
    p = i.select(F.col("ipc_section").alias("prefix")).unionByName(i.where("ipc_section in ('H', 'G')").select(F.col("ipc_4digit").alias("prefix"))).distinct()
    return linking.longest_prefix(i.select(F.col("ipc_code").alias("code")), p.withColumn("concept", F.concat(F.lit("c/"), "prefix")))


#: A small curated dictionary; ``al`` must not be found in ``metal``.
_SURFACES = [("gas inlet", "inlet"), ("가스유입구", "inlet"), ("chlorine", "cl"), ("염소", "cl"), ("塩素", "cl"), ("al", "aluminium"), ("bit line", "bitline"), ("비트라인", "bitline"), ("plug", "plug"), ("plug", "contact")]


@_q("WITH s AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SURFACES) + ") v(surface, concept)) SELECT DISTINCT doc_id AS id, concept, surface FROM documents, s WHERE CASE WHEN regexp_full_match(surface, '[ -~]+') THEN regexp_matches(lower(text), '(^|[^a-z0-9])' || surface || '([^a-z0-9]|$)') ELSE contains(lower(text), surface) END")
def link_dictionary(spark, d):
    s = spark.createDataFrame(_SURFACES, "surface string, concept string")
    return linking.dictionary_links(table(spark, d, "documents"), s).distinct()


@_q()
def link_fuzzy_labels(spark, d):
    """The three most similar other names of each applicant; DuckDB counts edits in bytes, so the tests compare with brute force."""
    o = table(spark, d, "patents_meta").select(F.explode(F.split("applicant_en", "[|]")).alias("label")).where("label <> ''").distinct()
    r = linking.fuzzy_labels(o, o, k=4).where("a <> b")
    return ranking.ranked(r.drop("rank"), by="a", score="ratio", doc="b").where("rank <= 3")


_LOOSE = "regexp_replace(regexp_replace(regexp_replace(upper(trim({})), '[^A-Z0-9]', '', 'g'), '([0-9])[A-Z][0-9]?$', '\\1'), '^([A-Z]{{2}})[A-Z]?0*', '\\1')"


@_q(f"WITH k AS (SELECT DISTINCT cited_raw AS key, {_LOOSE.format('cited_raw')} AS lk FROM prior_art_edges WHERE NOT coalesce(is_npl, false) AND trim(cited_raw) <> ''), r AS (SELECT DISTINCT upper(trim(cited_doc_id)) AS id, {_LOOSE.format('cited_doc_id')} AS lk FROM cited_enriched WHERE trim(cited_doc_id) <> ''), u AS (SELECT lk, min(id) AS id FROM r GROUP BY lk HAVING count(DISTINCT id) = 1) SELECT k.key, coalesce(e.id, u.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN u.id IS NOT NULL THEN 'loose' ELSE 'none' END AS how FROM k LEFT JOIN r e ON e.id = k.key LEFT JOIN u ON u.lk = k.lk")
def link_loose_keys(spark, d):
    """Raw citations to records: exactly, else by a loose key that names one record; ambiguous loose keys resolve nothing."""
    rows = table(spark, d, "prior_art_edges").where("not coalesce(is_npl, false) and trim(cited_raw) <> ''").select(F.col("cited_raw").alias("key"), linking.loose_key(F.col("cited_raw")).alias("loose_key"))
    recs = table(spark, d, "cited_enriched").where("trim(cited_doc_id) <> ''").select(F.upper(F.trim("cited_doc_id")).alias("id"), linking.loose_key(F.col("cited_doc_id")).alias("loose_key")).distinct()
    return linking.resolve(rows, recs.select(F.col("id").alias("key"), "id"), recs)


@_q("WITH p AS (SELECT DISTINCT process_family AS a, primary_ipc_4digit AS b FROM patents_meta WHERE process_family <> '' AND primary_ipc_4digit <> '') SELECT 'process_family' AS side, a AS value, count(*) AS n FROM p GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'primary_ipc_4digit', b, count(*) FROM p GROUP BY b HAVING count(*) > 1")
def link_broken_crosswalk(spark, d):
    return linking.broken_crosswalk(table(spark, d, "patents_meta").where("process_family <> '' and primary_ipc_4digit <> ''"), "process_family", "primary_ipc_4digit")


@_q("WITH RECURSIVE e AS (SELECT DISTINCT application_number AS a, unnest(list_transform(cited_ids, lambda x: upper(trim(x)))) AS b FROM notice_sections), f AS (SELECT a, b FROM e WHERE b <> '' UNION SELECT b, a FROM e WHERE b <> ''), s AS (SELECT DISTINCT application_number AS seed FROM notice_sections WHERE cast(application_number AS bigint) % 50 = 0), c AS (SELECT seed, seed AS node FROM s UNION SELECT c.seed, f.b FROM c JOIN f ON f.a = c.node) SELECT seed, count(*) AS n_nodes FROM c GROUP BY seed")
def closure_undirected(spark, d):
    """How many applications and documents hang together with each fiftieth application."""
    n = table(spark, d, "notice_sections")
    e = n.select(F.col("application_number").alias("a"), F.explode("cited_ids").alias("b")).select("a", F.upper(F.trim("b")).alias("b")).where("b <> ''").distinct()
    seeds = n.where("cast(application_number as bigint) % 50 = 0").select(F.col("application_number").alias("seed")).distinct()
    return closure.reachable_counts(e, seeds)
