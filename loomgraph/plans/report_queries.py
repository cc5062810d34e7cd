"""Queries of evaluation, statistics, gates, aggregates, windows and text functions, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomgraph.functions import text as T
from loomgraph.operators import constraints, gates, metrics, ranking, shaping, statistics
from loomgraph.plans.analysis import _DENSE, _dense
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


# --- runs: A by cosine, B by nearness of ids; relevant are vectors of the same label

_RUNS = _DENSE + """, a AS (SELECT qid, doc_id, rank FROM r WHERE rank <= 100), b AS (SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(a.vec_id - b.vec_id), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 100),
rel AS (SELECT x.vec_id AS qid, y.vec_id AS doc_id, x.label AS grp FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0), nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("grp"))
    rel = q.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("grp")), "grp").where("qid <> doc_id").select("qid", "doc_id", "grp")
    a = materialize(_dense(spark, d, 100).select("qid", "doc_id", "rank"), "run")
    near = q.crossJoin(spark.range(-100, 101).where("id <> 0").withColumnRenamed("id", "step"))  # two hundred steps from each stated query
    near = near.select("qid", (F.col("qid") + F.col("step")).alias("doc_id")).join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    b = near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.abs(F.col("qid") - F.col("doc_id")), "doc_id")).cast("bigint")).where("rank <= 100")
    return a, b.select("qid", "doc_id", "rank"), rel


@_q(_RUNS + ", x AS (SELECT a.*, rel.doc_id IS NOT NULL AS hit, sum(CASE WHEN rel.doc_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY a.qid ORDER BY rank) AS before FROM a LEFT JOIN rel USING (qid, doc_id)) SELECT nr.qid, round(coalesce(sum(CASE WHEN hit THEN 1 - least(before, n)::double / n END), 0) / max(n), 9) AS bpref FROM nr LEFT JOIN x USING (qid) GROUP BY nr.qid")
def eval_bpref(spark, d):
    a, _, rel = _runs(spark, d)
    return metrics.bpref(a, rel).withColumn("bpref", F.round("bpref", 9))


@_q(_RUNS + ", g AS (SELECT qid, doc_id, 1 + doc_id % 3 AS relevance FROM rel), got AS (SELECT qid, sum((power(2, relevance) - 1) / log2(rank + 1.0)) AS dcg FROM g JOIN a USING (qid, doc_id) WHERE rank <= 20 GROUP BY qid), best AS (SELECT qid, sum((power(2, relevance) - 1) / log2(pos + 1.0)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, doc_id) AS pos FROM g) WHERE pos <= 20 GROUP BY qid) SELECT qid, round(coalesce(dcg, 0) / idcg, 9) AS ndcg_graded FROM best LEFT JOIN got USING (qid)")
def eval_graded_ndcg(spark, d):
    """Grades 1 to 3 by id."""
    a, _, rel = _runs(spark, d)
    return metrics.graded_ndcg(a, rel.withColumn("relevance", 1 + F.col("doc_id") % 3)).withColumn("ndcg_graded", F.round("ndcg_graded", 9))


@_q(_RUNS + ", h AS (SELECT nr.qid, n, rank, row_number() OVER (PARTITION BY nr.qid ORDER BY rank) AS found FROM nr LEFT JOIN (SELECT qid, rank FROM a JOIN rel USING (qid, doc_id)) z USING (qid)), e AS (SELECT qid, min(rank) FILTER (found >= ceil(0.05 * n - 1e-9)) AS e FROM h GROUP BY qid) SELECT count(*) AS n_queries, count(*) FILTER (e IS NULL) AS n_censored, CASE WHEN count(*) FILTER (e IS NULL) * 2 < count(*) THEN quantile_cont(coalesce(e, 101), 0.5) END AS median_effort FROM e")
def eval_effort(spark, d):
    """Ranks until a twentieth of what is relevant is found, at most a hundred; a median only if fewer than half are censored."""
    a, _, rel = _runs(spark, d)
    e = metrics.effort(a, rel, 0.05, 100)
    c = F.count_if("censored")
    return e.agg(F.count(F.lit(1)).alias("n_queries"), c.alias("n_censored"), F.when(c * 2 < F.count(F.lit(1)), F.percentile("effort", F.lit(0.5))).alias("median_effort"))


@_q(_RUNS + ", h AS (SELECT rel.qid, grp, n, count(a.rank) FILTER (a.rank <= 50) AS h FROM rel JOIN nr USING (qid) LEFT JOIN a USING (qid, doc_id) GROUP BY ALL) SELECT grp, count(*) AS n_queries, round(sum(h) / sum(n)::double, 9) AS micro, round(avg(h / n::double), 9) AS macro FROM h GROUP BY grp")
def eval_micro_macro(spark, d):
    """Recall at fifty by bucket, over relevant pairs and over queries."""
    a, _, rel = _runs(spark, d)
    j = metrics.judged(a, rel).join(rel.select("qid", "grp").distinct(), "qid").groupBy("qid", "grp").agg(F.max("n_relevant").alias("n"), F.count_if(F.col("rank") <= 50).alias("h"))
    return j.groupBy("grp").agg(F.count(F.lit(1)).alias("n_queries"), F.round(shaping.ratio_of_sums("h", "n"), 9).alias("micro"), F.round(F.avg(F.col("h") / F.col("n")), 9).alias("macro"))


@_q(_RUNS + " SELECT a.qid, round(count(rel.doc_id) FILTER (rank <= 10) / least(10, max(rank))::double, 9) AS precision_10, round(coalesce(1.0::double / min(rank) FILTER (rel.doc_id IS NOT NULL), 0), 9) AS rr, round(coalesce(sum(1 / log2(pos + 1.0)), 0), 9) AS list_gain FROM a LEFT JOIN (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM a JOIN rel USING (qid, doc_id)) rel USING (qid, doc_id) GROUP BY a.qid")
def eval_precision(spark, d):
    """Precision at ten over min(10, length), reciprocal rank, and the gain discounted by place in the list of hits."""
    a, _, rel = _runs(spark, d)
    return metrics.precision(a, rel, 10)


@_q(_RUNS + " SELECT rel.qid, rel.doc_id, a.rank AS rank_old, b.rank AS rank_new, CASE WHEN b.rank IS NULL THEN 'lost' ELSE 'fell' END AS reason FROM rel JOIN a USING (qid, doc_id) LEFT JOIN b USING (qid, doc_id) WHERE b.rank IS NULL OR b.rank - a.rank >= 20")
def eval_rank_drops(spark, d):
    a, b, rel = _runs(spark, d)
    return shaping.rank_drops(a, b, rel)


_RECALLS = ", ra AS (SELECT nr.qid, count(z.doc_id) / max(n)::double AS v FROM nr LEFT JOIN (SELECT qid, doc_id FROM a JOIN rel USING (qid, doc_id)) z USING (qid) GROUP BY nr.qid), rb AS (SELECT nr.qid, count(z.doc_id) / max(n)::double AS v FROM nr LEFT JOIN (SELECT qid, doc_id FROM b JOIN rel USING (qid, doc_id)) z USING (qid) GROUP BY nr.qid), gr AS (SELECT DISTINCT qid, grp FROM rel)"


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    """(qid, grp, base, new)."""
    a, b, rel = _runs(spark, d)
    r = lambda run, n: metrics.per_query(run, rel, (100,)).select("qid", F.col("recall_100").alias(n))
    return materialize(r(a, "base").join(r(b, "new"), "qid").join(rel.select("qid", "grp").distinct(), "qid"), "recalls")


@_q(_RUNS + _RECALLS + " SELECT grp, count(*) AS n, round(avg(ra.v), 9) AS base, round(avg(rb.v), 9) AS new, round(avg(ra.v) - avg(rb.v), 9) AS drop, count(*) >= 3 AS reliable FROM ra JOIN rb USING (qid) JOIN gr USING (qid) GROUP BY grp")
def eval_subgroups(spark, d):
    s = statistics.subgroup_drop(_recalls(spark, d), "grp", "base", "new", 3)
    return s.select("grp", "n", *(F.round(c, 9).alias(c) for c in ("base", "new", "drop")), "reliable")


@_q(_RUNS + _RECALLS + ", sg AS (SELECT round(avg(ra.v) - avg(rb.v), 9) AS d, count(*) >= 3 AS ok FROM ra JOIN rb USING (qid) JOIN gr USING (qid) GROUP BY grp) SELECT max(d) FILTER (ok) AS max_drop, CASE WHEN max(d) FILTER (ok) IS NULL THEN 'undetermined' WHEN max(d) FILTER (ok) < 0.05 THEN 'pass' ELSE 'fail' END AS verdict FROM sg")
def gate_subgroups(spark, d):
    return gates.subgroup_verdict(statistics.subgroup_drop(_recalls(spark, d), "grp", "base", "new", 3))


@_q(_RUNS + _RECALLS + " SELECT count(*) AS n, count(*) FILTER (ra.v > 0 AND rb.v = 0) AS only_a, count(*) FILTER (ra.v = 0 AND rb.v > 0) AS only_b FROM ra JOIN rb USING (qid)")
def stat_discordant(spark, d):
    r = _recalls(spark, d)
    return gates.discordant(r.select("qid", (F.col("base") > 0).alias("hit")), r.select("qid", (F.col("new") > 0).alias("hit")))


@_q()
def stat_mcnemar(spark, d):
    """The discordant counts with both p values; SQL has the counts (stat_discordant), the tests the p values."""
    r = stat_discordant(spark, d).first()
    p = statistics.mcnemar(r.only_a, r.only_b), statistics.mcnemar_one_sided(r.only_a, r.only_b)
    return spark.createDataFrame([(r.only_a, r.only_b, *p)], "only_a bigint, only_b bigint, p double, p_one_sided double")


@_q()
def stat_bootstrap(spark, d):
    """Paired bootstrap of recall differences and of the ratio of sums, one number a stated query; the gate asks for a lower bound above -0.02."""
    v = _recalls(spark, d).orderBy("qid").select("base", "new").collect()
    b = statistics.paired_bootstrap([x.new - x.base for x in v])
    r = statistics.ratio_bootstrap([x.new for x in v], [x.base for x in v])
    row = (b["mean"], b["low"], b["high"], b["p"], b["win"], b["loss"], b["tie"], statistics.non_inferior(b["low"]), r["ratio"], r["dropped"])
    return spark.createDataFrame([row], "mean double, low double, high double, p double, win bigint, loss bigint, tie bigint, non_inferior boolean, ratio double, dropped bigint")


@_q("WITH t AS (SELECT source AS name, round(count(*) FILTER (resolved) / count(*)::double / 20, 9) AS p FROM cited_enriched WHERE source IS NOT NULL GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM t) SELECT name, p, rank, min(p <= 0.05 / (m - rank + 1)) OVER (ORDER BY p, name) AS rejected FROM r")
def stat_holm(spark, d):
    t = table(spark, d, "cited_enriched").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.round(F.count_if("resolved") / F.count(F.lit(1)) / 20, 9).alias("p"))
    return gates.holm_frame(t)


# --- ratings: three raters a part, 0 to 3

_RATED = "rt AS (SELECT p_partkey AS item, cast(least(3, floor(p_size / 13)) AS bigint) AS a, cast(least(3, floor(p_retailprice / 500)) AS bigint) AS b, cast(length(p_name) % 4 AS bigint) AS c FROM part), lg AS (SELECT item, 'a' AS rater, a AS v FROM rt UNION ALL SELECT item, 'b', b FROM rt UNION ALL SELECT item, 'c', c FROM rt)"


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    cap = lambda c: F.least(F.lit(3), F.floor(c)).cast("bigint")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), cap(F.col("p_size") / 13).alias("a"), cap(F.col("p_retailprice") / 500).alias("b"), (F.length("p_name") % 4).cast("bigint").alias("c"))


def _long(r: DataFrame) -> DataFrame:
    return r.select("item", F.explode(F.array(*(F.struct(F.lit(x).alias("rater"), F.col(x).alias("value")) for x in "abc"))).alias("z")).select("item", "z.*")


@_q(f"WITH {_RATED}, n AS (SELECT item, v, count(*) AS n FROM lg GROUP BY ALL), p AS (SELECT item, sum(n * (n - 1)) / 6.0::double AS a FROM n GROUP BY item), s AS (SELECT sum(power(c / (SELECT sum(n) FROM n)::double, 2)) AS e FROM (SELECT sum(n) AS c FROM n GROUP BY v)) SELECT (SELECT count(*) FROM p) AS items, round(((SELECT avg(a) FROM p) - e) / (1 - e), 9) AS kappa FROM s")
def agreement_fleiss_kappa(spark, d):
    n = _long(_ratings(spark, d)).groupBy("item", F.col("value").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return statistics.fleiss_kappa(n).select("items", F.round("kappa", 9).alias("kappa"))


_QK = "(SELECT 1 - sum(power({0} - {1}, 2)) / (SELECT sum(power(x.v - y.v, 2) * x.n * y.n) / (SELECT count(*) FROM rt)::double FROM (SELECT {0} AS v, count(*) AS n FROM rt GROUP BY 1) x, (SELECT {1} AS v, count(*) AS n FROM rt GROUP BY 1) y) FROM rt)"


@_q(f"WITH {_RATED} SELECT round(({_QK.format('a', 'b')} + {_QK.format('a', 'c')} + {_QK.format('b', 'c')}) / 3, 9) AS mean_kappa")
def agreement_weighted(spark, d):
    """Quadratic weighted kappa, mean over the pairs of raters."""
    r = materialize(_ratings(spark, d), "ratings")
    parts = [statistics.cohen_kappa(r, x, y, quadratic=True).select("kappa") for x, y in ("ab", "ac", "bc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.round(F.avg("kappa"), 9).alias("mean_kappa"))


@_q(f"WITH {_RATED}, g AS (SELECT avg(v) AS gm, count(DISTINCT item) AS n, 3 AS k FROM lg), ms AS (SELECT 3 * sum(power(m - gm, 2)) / (max(n) - 1) AS msr FROM (SELECT avg(v) AS m FROM lg GROUP BY item), g), mc AS (SELECT max(n) * sum(power(m - gm, 2)) / 2 AS msc FROM (SELECT avg(v) AS m FROM lg GROUP BY rater), g), t AS (SELECT sum(power(v - gm, 2)) AS sst FROM lg, g), z AS (SELECT n, msr, msc, (sst - msr * (n - 1) - msc * 2) / ((n - 1) * 2) AS mse FROM g, ms, mc, t) SELECT n, round((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / n), 6) AS icc_single, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc_mean FROM z")
def agreement_icc(spark, d):
    return statistics.icc(_long(_ratings(spark, d))).select("n", F.round("icc_single", 6).alias("icc_single"), F.round("icc_mean", 6).alias("icc_mean"))


@_q(f"WITH {_RATED} SELECT item, round((a + b + c) / 3.0::double, 9) AS grade, (a >= 2)::int + (b >= 2)::int + (c >= 2)::int >= 2 AS relevant, a = b AND b = c AS agreed, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS majority FROM rt")
def ratings_consensus(spark, d):
    """Graded mean, relevance by two of three, full agreement, and the value two raters share (null without one)."""
    r = _ratings(spark, d)
    a, b, c = (F.col(x) for x in "abc")
    votes = sum(((x >= 2).cast("int") for x in (a, b, c)), F.lit(0))
    return r.select("item", F.round((a + b + c) / 3, 9).alias("grade"), (votes >= 2).alias("relevant"), ((a == b) & (b == c)).alias("agreed"), F.when((a == b) | (a == c), a).when(b == c, b).alias("majority"))


@_q(f"WITH {_RATED} SELECT rater, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS deviation FROM lg GROUP BY rater")
def ratings_spread(spark, d):
    m, s = shaping.spread("value")
    return _long(_ratings(spark, d)).groupBy("rater").agg(F.round(m, 9).alias("mean"), F.round(s, 9).alias("deviation"))


# --- aggregates, windows, sets


@_q("SELECT upper(trim(cited_doc_id)) AS doc, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources, count(*) AS n FROM cited_enriched WHERE trim(cited_doc_id) <> '' GROUP BY 1")
def agg_group_concat(spark, d):
    return table(spark, d, "cited_enriched").where("trim(cited_doc_id) <> ''").groupBy(F.upper(F.trim("cited_doc_id")).alias("doc")).agg(shaping.concat_distinct("source").alias("sources"), F.count(F.lit(1)).alias("n")).withColumn("sources", F.nullif("sources", F.lit("")))


@_q("WITH c AS (SELECT process_family AS value, count(*) AS n FROM patents_meta GROUP BY 1) SELECT * FROM (SELECT value, n, round(n / sum(n) OVER ()::double, 9) AS share, row_number() OVER (ORDER BY n DESC, value NULLS FIRST) AS rank FROM c) WHERE rank <= 5")
def agg_distribution(spark, d):
    return shaping.distribution(table(spark, d, "patents_meta"), "process_family", 5)


@_q("WITH x AS (SELECT DISTINCT patent_id, unnest(string_split(rejection_legal_bases, '|')) AS b FROM patents_meta WHERE rejection_legal_bases <> ''), n AS (SELECT count(DISTINCT patent_id) AS n FROM x), c AS (SELECT b, count(*) AS c FROM x GROUP BY b) SELECT p.b AS a, q.b AS b, count(*) AS n_both, round(ln(count(*) * max(n)::double / (max(cp.c) * max(cq.c))) * ln(1 + count(*)), 9) AS score, round((count(*) + 1.0::double) / (max(cp.c) + 5), 9) AS p_b_given_a FROM x p JOIN x q ON p.patent_id = q.patent_id AND p.b < q.b JOIN c cp ON cp.b = p.b JOIN c cq ON cq.b = q.b, n GROUP BY p.b, q.b")
def agg_log_lift(spark, d):
    """Pairs of legal bases with log lift and smoothed conditional probability; the statute bounds the pairs of a patent."""
    x = table(spark, d, "patents_meta").where("rejection_legal_bases <> ''").select("patent_id", F.explode(F.array_distinct(F.split("rejection_legal_bases", "[|]"))).alias("b"))
    c, n = x.groupBy("b").agg(F.count(F.lit(1)).alias("c")), x.agg(F.countDistinct("patent_id").alias("n"))
    p = x.withColumnRenamed("b", "a").join(x, "patent_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    j = p.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").crossJoin(F.broadcast(n))  # one row
    return j.select("a", "b", "n_both", F.round(shaping.log_lift(F.col("n_both"), F.col("ca"), F.col("cb"), F.col("n")), 9).alias("score"), F.round(shaping.smoothed(F.col("n_both"), F.col("ca")), 9).alias("p_b_given_a"))


@_q("WITH s AS (SELECT doc_id, min(split) AS split FROM splits GROUP BY doc_id) SELECT coalesce(split, '_unknown') AS split, count(*) AS n FROM (SELECT DISTINCT doc_id FROM claim_texts) LEFT JOIN s USING (doc_id) GROUP BY 1")
def agg_split_composition(spark, d):
    return shaping.composition(table(spark, d, "claim_texts").select("doc_id").distinct(), table(spark, d, "splits"), "doc_id")


_DELTA = "SELECT target_patent_id AS k, list(DISTINCT upper(trim(cited_doc_id))) AS v FROM prior_art_edges WHERE trim(cited_doc_id) <> '' AND source_type {} GROUP BY 1"


@_q(f"WITH o AS ({_DELTA.format('= ' + chr(39) + 'all' + chr(39))}), n AS ({_DELTA.format('IN (' + chr(39) + 'examiner' + chr(39) + ')')}), j AS (SELECT coalesce(o.k, n.k) AS k, o.v AS ov, n.v AS nv, len(list_filter(coalesce(n.v, []), lambda x: NOT list_contains(coalesce(o.v, []), x))) AS a, len(list_filter(coalesce(o.v, []), lambda x: NOT list_contains(coalesce(n.v, []), x))) AS l FROM o FULL JOIN n ON o.k = n.k) SELECT k, CASE WHEN ov IS NULL THEN 'new' WHEN nv IS NULL THEN 'lost' WHEN a = 0 AND l = 0 THEN 'unchanged' WHEN l = 0 THEN 'extended' ELSE 'changed' END AS status, a AS n_added, l AS n_lost FROM j")
def agg_additive_delta(spark, d):
    e = table(spark, d, "prior_art_edges").where("trim(cited_doc_id) <> ''")
    of = lambda t: e.where(F.col("source_type") == t).groupBy(F.col("target_patent_id").alias("k")).agg(F.collect_set(F.upper(F.trim("cited_doc_id"))).alias("v"))
    return shaping.additive_delta(of("all"), of("examiner"), "k", "v")


@_q("SELECT record_id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'C' WHEN coalesce(resolved, false) AND length(claims) > 0 AND length(abstract) > 0 THEN 'A' ELSE 'B' END AS tier FROM cited_enriched")
def agg_quality_tier(spark, d):
    full = F.coalesce("resolved", F.lit(False)) & (F.length("claims") > 0) & (F.length("abstract") > 0)
    return table(spark, d, "cited_enriched").select("record_id", F.when(F.col("title").isNull() | (F.trim("title") == ""), "C").when(full, "A").otherwise("B").alias("tier"))


@_q("SELECT doc_id, split, count(*) AS n FROM splits GROUP BY ALL HAVING count(*) > 1")
def agg_repeated_keys(spark, d):
    return shaping.repeated_keys(table(spark, d, "splits"), "doc_id", "split")


@_q("SELECT source, count(*) AS n, count(*) FILTER (resolved) AS passed, round(count(*) FILTER (resolved) / count(*)::double, 9) AS rate FROM cited_enriched GROUP BY source")
def agg_pass_rate(spark, d):
    return shaping.pass_rate(table(spark, d, "cited_enriched").select("source", F.col("resolved").alias("ok")), "source")


_SPLIT = "g AS (SELECT o_custkey AS grp, min(cast(o_orderdate AS date)) AS day0, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY day0, grp ROWS UNBOUNDED PRECEDING) AS u, sum(n) OVER () AS t FROM g), sp AS (SELECT grp, n, CASE WHEN u <= t * 0.6 THEN 'train' WHEN u <= t * 0.8 THEN 'dev' ELSE 'test' END AS split FROM c)"


def _global_split(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.min(F.to_date("o_orderdate")).alias("at"), F.count(F.lit(1)).alias("n"))
    return shaping.cumulative_split(g)


@_q(f"WITH {_SPLIT} SELECT grp AS \"group\", split FROM sp")
def window_family_split(spark, d):
    """Whole families in order of their first date, cut once at 60 and 80 in a hundred of all rows."""
    return _global_split(spark, d).select("group", "split")


@_q(f"WITH {_SPLIT} SELECT split, count(*) AS n_groups, cast(sum(cast('0x' || substr(md5(cast(grp AS varchar) || '|' || split), 1, 8) AS bigint)) AS bigint) AS sum FROM sp GROUP BY split")
def window_split_checksum(spark, d):
    return shaping.checksum(_global_split(spark, d))


@_q("WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= q[1] THEN 'Q1' WHEN p_retailprice <= q[2] THEN 'Q2' WHEN p_retailprice <= q[3] THEN 'Q3' ELSE 'Q4' END AS bucket FROM part, q")
def window_quartile_bucket(spark, d):
    return shaping.quartile_buckets(table(spark, d, "part"), "p_retailprice").select("p_partkey", "bucket")


@_q("WITH t AS (SELECT upper(trim(cited_doc_id)) AS k, source, nullif(trim(title), '') AS title, nullif(trim(ipc), '') AS ipc, trust_rank AS g FROM cited_enriched JOIN source_trust USING (source) WHERE trim(cited_doc_id) <> '') SELECT k, (SELECT min(title) FROM t x WHERE x.k = t.k AND title IS NOT NULL AND g = (SELECT min(g) FROM t y WHERE y.k = t.k AND y.title IS NOT NULL)) AS title, (SELECT min(ipc) FROM t x WHERE x.k = t.k AND ipc IS NOT NULL AND g = (SELECT min(g) FROM t y WHERE y.k = t.k AND y.ipc IS NOT NULL)) AS ipc FROM t GROUP BY k")
def window_precedence_merge(spark, d):
    """Each field from the most trusted source that has it; the least of several values of that source."""
    r = table(spark, d, "cited_enriched").where("trim(cited_doc_id) <> ''").withColumn("k", F.upper(F.trim("cited_doc_id")))
    names = [x.source for x in table(spark, d, "source_trust").orderBy("trust_rank", "source").collect()]  # four sources
    return shaping.precedence_merge([r.where(F.col("source") == s) for s in names], "k", ["title", "ipc"])


@_q("SELECT lower(replace(title, ' ', '-')) AS slug, min(patent_id) AS patent_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(replace(title, ' ', '-')) ORDER BY has_claims_full DESC NULLS LAST, n_ipc_codes DESC NULLS LAST, publication_date DESC NULLS LAST, patent_id) AS n FROM patents_meta WHERE title <> '') WHERE n = 1 GROUP BY 1")
def window_slug_dedupe(spark, d):
    p = table(spark, d, "patents_meta").where("title <> ''").withColumn("slug", F.lower(F.replace("title", F.lit(" "), F.lit("-"))))
    return shaping.dedupe_slugs(p, "slug", [F.desc_nulls_last("has_claims_full"), F.desc_nulls_last("n_ipc_codes"), F.desc_nulls_last("publication_date"), F.col("patent_id")]).select("slug", "patent_id")


@_q("WITH q AS (SELECT DISTINCT ipc_section AS qid FROM ipc_links), c AS (SELECT DISTINCT process_family AS doc_id FROM patents_meta WHERE process_family <> ''), s AS (SELECT ipc_section AS qid, process_family AS doc_id, count(*)::double AS score FROM ipc_links JOIN patents_meta USING (patent_id) GROUP BY ALL) SELECT qid, doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, doc_id) AS rank FROM q CROSS JOIN c LEFT JOIN s USING (qid, doc_id)")
def rank_with_tail(spark, d):
    i, p = table(spark, d, "ipc_links"), table(spark, d, "patents_meta")
    s = i.join(p, "patent_id").groupBy(F.col("ipc_section").alias("qid"), F.col("process_family").alias("doc_id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return shaping.with_tail(s, i.select(F.col("ipc_section").alias("qid")), p.where("process_family <> ''").select(F.col("process_family").alias("doc_id")))


@_q("WITH m AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey AS qid, o_orderkey AS doc_id, CASE WHEN m <= 1 THEN 1.0::double ELSE round(1 - (r - 1)::double / (m - 1), 9) END AS norm FROM m")
def rank_normalised(spark, d):
    r = ranking.ranked(table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")))
    return r.select("qid", "doc_id", F.round(ranking.rank_norm(F.col("rank"), F.count(F.lit(1)).over(W.partitionBy("qid"))), 9).alias("norm"))


@_q("WITH p AS (SELECT l_orderkey AS qid, l_suppkey AS doc_id, max(l_quantity) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM p), k AS (SELECT r.* FROM r JOIN orders ON o_orderkey = qid JOIN supplier ON s_suppkey = doc_id JOIN customer ON c_custkey = o_custkey WHERE s_acctbal > 0 AND s_nationkey <> c_nationkey) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) AS rank FROM k")
def rank_masked_pool(spark, d):
    """Candidates that are allowed and of another family (nation) than the query, ranked anew."""
    pool = ranking.ranked(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("doc_id")).agg(F.max("l_quantity").alias("score")))
    who = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("qid"), F.col("c_nationkey").alias("q_family"))
    of = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_nationkey").alias("d_family"), (F.col("s_acctbal") > 0).alias("is_candidate"))
    j = pool.join(who, "qid").join(of, "doc_id").withColumns({"q_date": F.lit(0), "d_date": F.lit(0)}).withColumn("doc_key", F.col("doc_id"))
    kept = ranking.mask(j.withColumn("qid", -F.col("qid")))  # suppliers and orders share numbers, not identity
    return kept.select((-F.col("qid")).alias("qid"), "doc_id", "rank")


@_q("WITH w AS (SELECT DISTINCT target_patent_id AS qid, unnest(string_split(legal_bases, '|')) AS key FROM prior_art_edges WHERE source_type = 'evidence_v2' AND legal_bases <> ''), n AS (SELECT qid, count(*) AS n FROM w GROUP BY qid), p AS (SELECT DISTINCT section_id AS id, unnest(legal_bases) AS key FROM notice_sections) SELECT qid, id FROM w JOIN p USING (key) JOIN n USING (qid) WHERE cast(split_part(qid, '_', 2) AS bigint) % 50 = 0 GROUP BY qid, id, n HAVING count(*) = n")
def set_conjunctive(spark, d):
    """Sections that hold all grounds of each fiftieth patent's evidence."""
    w = table(spark, d, "prior_art_edges").where("source_type = 'evidence_v2' and legal_bases <> '' and cast(split_part(target_patent_id, '_', 2) as bigint) % 50 = 0").select(F.col("target_patent_id").alias("qid"), F.explode(F.split("legal_bases", "[|]")).alias("key"))
    return shaping.conjunctive(table(spark, d, "notice_sections").select(F.col("section_id").alias("id"), F.explode("legal_bases").alias("key")), w)


@_q("SELECT DISTINCT patent_id, ipc_code FROM ipc_links WHERE ipc_section = 'H' UNION SELECT patent_id, ipc_code FROM ipc_links WHERE ipc_4digit LIKE 'G0%' EXCEPT SELECT patent_id, ipc_code FROM ipc_links JOIN patents_meta USING (patent_id) WHERE process_family = 'etch'")
def set_union_except(spark, d):
    """Graph union as a set, less what another set holds."""
    i = table(spark, d, "ipc_links")
    both = i.where("ipc_section = 'H'").select("patent_id", "ipc_code").unionByName(i.where("ipc_4digit like 'G0%'").select("patent_id", "ipc_code")).distinct()
    gone = i.join(table(spark, d, "patents_meta").where("process_family = 'etch'").select("patent_id"), "patent_id", "left_semi").select("patent_id", "ipc_code")
    return both.join(gone.distinct(), ["patent_id", "ipc_code"], "left_anti")


@_q("SELECT split, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(trim(split)) AS split FROM splits) SEMI JOIN claim_texts USING (doc_id) GROUP BY split")
def join_semi(spark, d):
    s = table(spark, d, "splits").select("doc_id", F.lower(F.trim("split")).alias("split")).distinct()
    return s.join(table(spark, d, "claim_texts").select("doc_id"), "doc_id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- constraints and leakage


@_q("WITH f AS (SELECT family_id FROM splits WHERE family_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1), t AS (SELECT DISTINCT md5(claims_full) AS h FROM claim_texts JOIN splits USING (doc_id) WHERE lower(trim(split)) = 'train' AND claims_full <> ''), e AS (SELECT DISTINCT md5(claims_full) AS h FROM claim_texts JOIN splits USING (doc_id) WHERE lower(trim(split)) IN ('dev', 'test', 'test_b') AND claims_full <> '') SELECT 'K1_family_crossing' AS check_name, count(*) AS n, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM f UNION ALL SELECT 'K2_two_splits', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT doc_id FROM splits GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1) UNION ALL SELECT 'K3_unknown_split', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT DISTINCT doc_id FROM splits WHERE NOT coalesce(lower(trim(split)) IN ('train', 'dev', 'test', 'test_b'), false)) UNION ALL SELECT 'K4_same_text', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM t JOIN e USING (h) UNION ALL SELECT 'K5_late_citation', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM prior_art_edges WHERE loaded_at < collected_at UNION ALL SELECT 'K6_run_manifest', NULL, 'UNMEASURABLE'")
def leakage_report(spark, d):
    """Six checks; what has no data is unmeasurable, which is no pass."""
    s = table(spark, d, "splits").withColumn("split", F.lower(F.trim("split")))
    c = table(spark, d, "claim_texts").where("claims_full <> ''").join(s.select("doc_id", "split").distinct(), "doc_id")
    h = lambda x: c.where(x).select(F.md5("claims_full").alias("h")).distinct()
    known = F.coalesce(F.col("split").isin("train", "dev", "test", "test_b"), F.lit(False))
    return gates.leakage_report({
        "K1_family_crossing": constraints.family_crossing(s), "K2_two_splits": s.groupBy("doc_id").agg(F.countDistinct("split").alias("n")).where("n > 1"), "K3_unknown_split": s.where(~known).select("doc_id").distinct(),
        "K4_same_text": h("split = 'train'").join(h("split in ('dev', 'test', 'test_b')"), "h"), "K5_late_citation": table(spark, d, "prior_art_edges").where("loaded_at < collected_at"), "K6_run_manifest": None,
    })


@_q("WITH e AS (SELECT target_patent_id AS src, upper(trim(cited_doc_id)) AS dst FROM prior_art_edges WHERE trim(cited_doc_id) <> ''), n AS (SELECT patent_id AS id FROM patents_meta UNION SELECT upper(trim(cited_doc_id)) FROM cited_enriched) SELECT DISTINCT src AS id, 'src' AS side FROM e WHERE src NOT IN (SELECT id FROM n WHERE id IS NOT NULL) UNION SELECT DISTINCT dst, 'dst' FROM e WHERE dst NOT IN (SELECT id FROM n WHERE id IS NOT NULL)")
def constraint_dangling(spark, d):
    e = table(spark, d, "prior_art_edges").where("trim(cited_doc_id) <> ''").select(F.col("target_patent_id").alias("src"), F.upper(F.trim("cited_doc_id")).alias("dst"))
    n = table(spark, d, "patents_meta").select(F.col("patent_id").alias("id")).unionByName(table(spark, d, "cited_enriched").select(F.upper(F.trim("cited_doc_id")).alias("id")))
    return constraints.dangling(e, n)


@_q("SELECT patent_id AS focus, 'publication before register' AS path, 'lessThanOrEquals' AS rule, publication_date AS value FROM patents_meta WHERE publication_date > register_date")
def constraint_date_order(spark, d):
    p = table(spark, d, "patents_meta")
    pick = lambda c: p.select(F.col("patent_id").alias("s"), F.col(c).alias("o")).where("o is not null")
    return constraints.less_or_equal(p.select(F.col("patent_id").alias("s")), pick("publication_date"), pick("register_date"), "publication before register")


# --- text


@_q("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def text_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@_q("SELECT doc_id, count(*) AS n, min(lvl) AS least_level FROM (SELECT doc_id, length(x) AS lvl FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM documents)) GROUP BY doc_id")
def text_word_lengths(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("x"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("x")).cast("bigint").alias("least_level"))


@_q("SELECT patent_id, trim(regexp_replace(lower(title), '[/_.()\\s-]+', ' ', 'g')) AS surface FROM patents_meta")
def text_surface(spark, d):
    return table(spark, d, "patents_meta").select("patent_id", T.surface("title").alias("surface"))


@_q("WITH t AS (SELECT patent_id, lower(title) AS t FROM patents_meta), g AS (SELECT patent_id, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, cast(i AS int), 3))) AS g FROM t WHERE length(t) >= 3) SELECT patent_id, len(g) AS n_grams FROM g")
def text_char_ngrams(spark, d):
    return table(spark, d, "patents_meta").where("length(title) >= 3").select("patent_id", F.size(T.char_ngrams(F.lower("title"))).cast("bigint").alias("n_grams"))


@_q("SELECT patent_id, cast('0x' || substr(sha256(patent_id), 1, 15) AS bigint) % 10 AS bucket FROM patents_meta")
def text_hash_bucket(spark, d):
    return table(spark, d, "patents_meta").select("patent_id", T.hash_bucket("patent_id", 10).alias("bucket"))


@_q("SELECT edge_id, regexp_full_match(coalesce(cited_id, ''), '(?:[a-z]{2}_[A-Z]*[0-9]{6,}[A-Z]?[0-9]?|patent:[a-z]{2}_[A-Za-z0-9_]+|[A-Z]{2}-[A-Z]-[0-9]{6,})') AS is_id FROM prior_art_edges")
def text_identifier_shape(spark, d):
    return table(spark, d, "prior_art_edges").select("edge_id", F.coalesce(F.col("cited_id"), F.lit("")).rlike(gates.ID_SHAPE).alias("is_id"))


@_q("SELECT doc_id, string_agg(x, ' ' ORDER BY n, x) AS text FROM (SELECT doc_id, cast(regexp_extract(x, '^([0-9]+)', 1) AS int) AS n, trim(x) AS x FROM (SELECT DISTINCT doc_id, unnest(string_split(claims_full, chr(10))) AS x FROM claim_texts) WHERE regexp_matches(x, '^[0-9]+[.] ')) GROUP BY doc_id")
def text_rebuilt_claims(spark, d):
    """Claims put together again in the order of their numbers."""
    x = table(spark, d, "claim_texts").select("doc_id", F.explode(F.split("claims_full", "\n")).alias("x")).distinct().where(r"x rlike '^[0-9]+[.] '")
    parts = F.array_sort(F.collect_list(F.struct(F.regexp_extract("x", r"^([0-9]+)", 1).cast("int").alias("n"), F.trim("x").alias("x"))))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), " ").alias("text"))
