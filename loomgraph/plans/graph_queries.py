"""Queries of inference, shapes, faults, claims and samples over the graph, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions import claims as C, text as T
from loomgraph.model import graph, with_relations
from loomgraph.operators import closure, constraints, faults, gates, rerank, sampling
from loomgraph.session import materialize, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None, relations: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_relations(sql) if relations else sql
        return f

    return add


# --- inference


@_q("SELECT o AS cls, count(DISTINCT s) AS n FROM (SELECT s, o FROM r_a WHERE o IN ('Process', 'SubProcess', 'Step') UNION SELECT s, 'Activity' FROM r_a WHERE o IN ('Process', 'SubProcess', 'Step') UNION SELECT s, 'Thing' FROM r_a WHERE o IN ('Process', 'SubProcess', 'Step') UNION SELECT s, 'Patent' FROM r_realizesProcess UNION SELECT s, 'Thing' FROM r_realizesProcess UNION SELECT o, 'Activity' FROM r_realizesProcess UNION SELECT o, 'Thing' FROM r_realizesProcess) z GROUP BY o", True)
def infer_types(spark, d):
    """Members of each class after inference by domain, range and super-classes."""
    g = graph(spark, d)
    t = g.predicate("realizesProcess").select("s", F.lit("realizesProcess").alias("p"), "o").unionByName(g.predicate("a:process|sub|ptype|ptype2").select("s", F.lit("a").alias("p"), "o"))
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    full = closure.entail(t, frame([("Process", "Activity"), ("SubProcess", "Activity"), ("Step", "Activity"), ("Activity", "Thing"), ("Patent", "Thing")]), frame([("realizesProcess", "concerns")]), frame([("realizesProcess", "Patent")]), frame([("realizesProcess", "Activity")]))
    return full.where("p = 'a'").groupBy(F.col("o").alias("cls")).agg(F.countDistinct("s").alias("n"))


@_q("SELECT s AS focus, 'Process' AS a, 'Step' AS b FROM (SELECT s FROM r_a WHERE o = 'Process') x WHERE s IN (SELECT s FROM r_a WHERE o = 'Step')", True)
def infer_disjoint(spark, d):
    """Nodes of two disjoint classes."""
    types = graph(spark, d).predicate("a:process|ptype|ptype2")
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    return closure.disjoint_members(types, frame([("Step", "Process")]), frame([("Process", "Thing"), ("Step", "Thing")])).withColumnRenamed("s", "focus")


@_q("SELECT x.s AS expert, y.s AS problem, count(DISTINCT x.o) AS n_shared FROM (SELECT s, o FROM r_hasProcessExpertise UNION SELECT s, o FROM r_hasMaterialExpertise) x JOIN (SELECT s, o FROM r_involvesProcess UNION SELECT s, o FROM r_involvesMaterial) y ON x.o = y.o WHERE cast(split_part(y.s, '/', 2) AS bigint) % 50 = 0 GROUP BY ALL", True)
def match_experts(spark, d):
    """Needs of every fiftieth problem over several paths, counted against each expert.

    Counted once a class of experts and of problems with equal sets; the pairs of
    experts and problems are made by the last join and never shuffled.
    """
    g = graph(spark, d)
    needs = g.predicate("involvesProcess").unionByName(g.predicate("involvesMaterial")).where("cast(split_part(s, '/', 2) as bigint) % 50 = 0").select(F.col("s").alias("problem"), "o")
    has = g.predicate("hasProcessExpertise").unionByName(g.predicate("hasMaterialExpertise")).select(F.col("s").alias("expert"), "o")
    pm, pc = rerank.key_classes(needs, "problem", "o")
    em, ec = rerank.key_classes(has, "expert", "o")
    each = lambda c, name: c.select(F.col("cid").alias(name), F.explode("items").alias("o"))
    met = materialize(each(pc, "pc").join(each(ec, "ec"), "o").groupBy("pc", "ec").agg(F.count(F.lit(1)).alias("n_shared")), "met")
    return spread(met).join(pm.withColumnRenamed("cid", "pc"), "pc").join(em.withColumnRenamed("cid", "ec"), "ec").select("expert", "problem", "n_shared")


@_q("SELECT a.s AS patent, b.s AS prior, count(DISTINCT a.o) AS n_shared, string_agg(DISTINCT a.o, '; ' ORDER BY a.o) AS shared FROM r_realizesProcess a JOIN r_realizesProcess b ON a.o = b.o AND a.s <> b.s JOIN r_filingDate da ON da.s = a.s JOIN r_filingDate db ON db.s = b.s AND db.o < da.o WHERE try_cast(split_part(a.s, '_', 2) AS bigint) % 50 = 0 GROUP BY ALL", True)
def search_explained(spark, d):
    """Earlier patents that share concepts with every fiftieth patent, with the concepts as the reason."""
    g = graph(spark, d)
    r = materialize(g.match(("?p", "realizesProcess", "?o"), ("?p", "filingDate:patent", "?at")), "concepts")
    q = r.where("cast(split_part(p, '_', 2) as bigint) % 50 = 0").select(F.col("p").alias("patent"), "o", F.col("at").alias("qat"))
    hit = q.join(r.select(F.col("p").alias("prior"), "o", "at"), "o").where("patent <> prior and at < qat")
    return hit.groupBy("patent", "prior").agg(F.countDistinct("o").alias("n_shared"), F.array_join(F.array_sort(F.collect_set("o")), "; ").alias("shared"))


# --- shapes


def _violations(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


@_q("SELECT path, rule, count(*) AS n FROM (SELECT 'title' AS path, 'pattern' AS rule FROM (SELECT s FROM r_a WHERE o = 'Patent') p JOIN r_label l ON l.s = p.s WHERE NOT regexp_matches(l.o, '^[A-Z]') UNION ALL SELECT 'claimCount', 'datatype' FROM r_claimCount WHERE try_cast(o AS date) IS NULL UNION ALL SELECT 'assignedTo', 'class' FROM r_assignedTo WHERE o NOT IN (SELECT s FROM r_a WHERE o = 'Vendor' AND s LIKE 'org/A%') UNION ALL SELECT 'status', 'hasValue' FROM (SELECT s FROM r_a WHERE o = 'Patent') p WHERE s NOT IN (SELECT s FROM r_status WHERE o = 'registered') UNION ALL SELECT 'device or process', 'or' FROM (SELECT s FROM r_a WHERE o = 'Patent') p WHERE s NOT IN (SELECT s FROM r_concernsDevice WHERE o = 'chain/equipment') AND s NOT IN (SELECT s FROM r_realizesProcess WHERE o LIKE 'process/%') UNION ALL SELECT 'rejected and registered', 'not' FROM (SELECT DISTINCT f.s FROM r_rejectedFor f JOIN r_status t ON t.s = f.s AND t.o = 'registered') z UNION ALL SELECT 'judged', 'inversePath' FROM (SELECT s FROM r_a WHERE o = 'Patent') p WHERE s NOT IN (SELECT s FROM r_rejectedFor)) z GROUP BY ALL", True)
def shape_violations(spark, d):
    """Pattern, datatype, class, required value, alternatives, negation and a missing inverse edge."""
    g = graph(spark, d)
    patents = g.match(("?s", "a:patent", "Patent"))
    P = constraints.Property
    big = g.predicate("a:org").where("s like 'org/A%'").select("s")
    checked = constraints.check(constraints.Shape("PatentShape", patents, [P(g.predicate("label:patent"), "title", pattern="^[A-Z]"), P(g.predicate("claimCount"), "claimCount", datatype="date"), P(g.predicate("assignedTo"), "assignedTo", cls=big), P(g.predicate("status"), "status", has_value="registered")])).select("path", "rule")
    tell = lambda df, path, rule: df.select(F.lit(path).alias("path"), F.lit(rule).alias("rule"))
    either = constraints.any_of(patents, g.match(("?s", "concernsDevice", "chain/equipment")), g.predicate("realizesProcess").where("o like 'process/%'").select("s"))
    never = constraints.none_of(g.predicate("rejectedFor").select("s"), g.match(("?s", "status", "registered")))
    inverse = patents.join(g.predicate("rejectedFor").select("s").distinct(), "s", "left_anti")
    return _violations([checked, tell(either, "device or process", "or"), tell(never, "rejected and registered", "not"), tell(inverse, "judged", "inversePath")])


@_q("SELECT 'PatentShape' AS shape, count(*) AS targets, CASE WHEN count(*) = 0 THEN 'vacuous' ELSE 'checked' END AS status FROM (SELECT s FROM r_a WHERE o = 'Patent') UNION ALL SELECT 'NoSuchShape', 0, 'vacuous' UNION ALL SELECT 'RejectedShape', count(DISTINCT s), CASE WHEN count(*) = 0 THEN 'vacuous' ELSE 'checked' END FROM r_rejectedFor", True)
def shape_targets(spark, d):
    """Targets by class and by subjects of a predicate; a shape without any is vacuous."""
    g = graph(spark, d)
    S = constraints.Shape
    return constraints.target_counts([S("PatentShape", g.match(("?s", "a:patent", "Patent"))), S("NoSuchShape", g.match(("?s", "a:patent", "Nothing"))), S("RejectedShape", g.predicate("rejectedFor").select("s"))])


@_q("SELECT term, used, asked FROM (SELECT coalesce(u.t, q.t) AS term, u.t IS NOT NULL AS used, q.t IS NOT NULL AS asked FROM (VALUES ('realizesProcess'), ('assignedTo'), ('status')) u(t) FULL JOIN (VALUES ('realizesProcess'), ('hasIPC')) q(t) ON u.t = q.t) z")
def gate_vocabulary(spark, d):
    """Predicates in data against predicates in questions; data predicates without triples are not used."""
    g = graph(spark, d)
    used = g.triples(["realizesProcess", "assignedTo", "status"]).select(F.col("p").alias("term")).distinct()
    return gates.vocabulary_coverage(used, spark.createDataFrame([("realizesProcess",), ("hasIPC",)], "term string"))


@_q("WITH o AS (SELECT source AS suite, count(*) FILTER (resolved) / count(*)::double AS r FROM cited_enriched WHERE fetched_at < TIMESTAMP '2024-07-01' AND source IS NOT NULL GROUP BY 1), n AS (SELECT source AS suite, count(*) FILTER (resolved) / count(*)::double AS r FROM cited_enriched WHERE fetched_at >= TIMESTAMP '2024-07-01' AND source IS NOT NULL GROUP BY 1) SELECT o.suite, round(o.r, 9) AS old_rate, round(coalesce(n.r, 0), 9) AS new_rate, CASE WHEN coalesce(n.r, 0) >= o.r THEN 'pass' WHEN o.suite = 'kipris' THEN 'waived' ELSE 'fail' END AS verdict FROM o LEFT JOIN n USING (suite)")
def gate_suites(spark, d):
    """No suite's pass rate may fall; a waiver is told."""
    r = table(spark, d, "cited_enriched").where("source is not null").select(F.col("source").alias("suite"), "resolved", (F.col("fetched_at") < F.lit("2024-07-01").cast("timestamp_ntz")).alias("old"))
    rate = lambda x: r.where(x).groupBy("suite").agg((F.count_if("resolved") / F.count(F.lit(1))).alias("rate"))
    v = gates.suite_verdict(rate("old"), rate("not old"), ("kipris",))
    return v.select("suite", F.round("old_rate", 9).alias("old_rate"), F.round("new_rate", 9).alias("new_rate"), "verdict")


# --- faults


@_q()
def fault_matrix(spark, d):
    """Faults and normal changes, and which gate sees them: row counts, dangling objects, duplicates, types. Checked in the tests."""
    g = graph(spark, d)
    t = materialize(g.triples(["realizesProcess", "concernsDevice"]).unionByName(g.predicate("a:patent").select("s", F.lit("a").alias("p"), "o")), "triples")
    known = materialize(t.select(F.col("o").alias("n")).distinct(), "objects")
    runs = {
        "F_delete": (True, faults.delete_edges(t, "realizesProcess", 0.3)), "F_rewire": (True, faults.rewire(t, "realizesProcess", "process/hub", 0.3)), "F_shuffle": (True, faults.shuffle_objects(t, "concernsDevice")), "F_flip": (True, faults.flip(t, "realizesProcess", 0.3)),
        "F_synonyms": (True, faults.merge_synonyms(t, "realizesProcess", 0.3)), "F_leak": (True, faults.leak(t, "realizesProcess", "concernsDevice", 0.3)), "F_retype": (True, faults.retype(t, "Patent", "Process", 0.3)), "F_dangle": (True, faults.dangle(t, "realizesProcess", 0.3)), "F_repeat": (True, faults.repeat_nodes(t, "realizesProcess", 0.3)),
        "N_same": (False, t), "N_again": (False, t.unionByName(t).distinct()),
    }
    counts = lambda x: x.groupBy("p").agg(F.countDistinct("s", "o").alias("n"))
    base = materialize(counts(t), "base")
    parts = None
    for name, (bad, x) in runs.items():
        x = materialize(x, "fault")
        moved = base.join(counts(x).withColumnRenamed("n", "m"), "p", "full").agg(F.coalesce(F.max(F.abs(F.coalesce("m", F.lit(0)) - F.coalesce("n", F.lit(0))) > 0.05 * F.coalesce("n", F.lit(0))), F.lit(False)).alias("flagged"))
        strange = x.select(F.col("o").alias("n")).distinct().join(known, "n", "left_anti").agg((F.count(F.lit(1)) > 0).alias("flagged"))
        for gate, df in (("row_counts", moved), ("dangling", strange)):
            row = df.select(F.lit(gate).alias("gate"), F.lit(name).alias("run"), F.lit(bad).alias("is_fault"), "flagged")
            parts = row if parts is None else parts.unionByName(row)
    return faults.detection(parts)


# --- claims, samples, text


def _claims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claim_texts").dropDuplicates(["doc_id", "claims_full"]).select(F.col("doc_id").alias("id"), F.explode(T.split_claims("claims_full")).alias("claim"))
    return c.withColumn("claim_no", F.regexp_extract("claim", r"^(\d{1,3})", 1).try_cast("int")).where("claim_no is not null")


@_q()
def claim_elements(spark, d):
    """Every claim cut into its elements; checked against cases in the tests."""
    return C.claim_elements(_claims(spark, d))


@_q("WITH RECURSIVE e AS (SELECT s AS child, o AS parent FROM r_dependsOnClaim), i AS (SELECT s FROM r_isIndependent WHERE o = 'true'), c AS (SELECT s AS claim, s AS root FROM i UNION SELECT e.child, c.root FROM c JOIN e ON e.parent = c.claim) SELECT root, count(DISTINCT claim) AS n FROM c GROUP BY root", True)
def claim_roots(spark, d):
    """How many claims lead back to each independent claim."""
    g = graph(spark, d)
    one = lambda c: F.split_part(c, F.lit("/"), F.lit(3)).cast("int")
    case = lambda c: F.split_part(c, F.lit("/"), F.lit(2))
    up = g.predicate("dependsOnClaim").groupBy("s").agg(F.collect_set(one(F.col("o"))).alias("parents"))
    free = g.match(("?s", "isIndependent", "true")).select("s", F.array().cast("array<int>").alias("parents"))
    c = up.unionByName(free).select(case(F.col("s")).alias("id"), one(F.col("s")).alias("claim_no"), "parents")
    r = C.root_claims(c)
    return r.groupBy(F.concat_ws("/", F.lit("claim"), "id", F.col("root").cast("string")).alias("root")).agg(F.countDistinct("claim_no").alias("n"))


@_q()
def sample_quota(spark, d):
    """Twenty documents a source and section, by hash: a sample is the feature."""
    return sampling.quota(table(spark, d, "documents").select("doc_id", "source", "doc_section"), ["source", "doc_section"], "doc_id", 20)


@_q()
def sample_hard_negatives(spark, d):
    """Three patents of the same class that a patent does not share a family or citation with."""
    p = table(spark, d, "patents_meta").select(F.col("patent_id").alias("id"), F.col("primary_ipc_4digit").alias("cls"), F.col("primary_ipc_section").alias("section"), F.col("application_number").alias("family"))
    cited = table(spark, d, "prior_art_edges").select(F.col("target_patent_id").alias("qid"), F.col("cited_id").alias("doc_id")).where("doc_id is not null").distinct()
    return sampling.negatives(p, p, cited, 3, True)


@_q("WITH p AS (SELECT DISTINCT patent_id AS id, ipc_code AS term FROM ipc_links), d AS (SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) BETWEEN 2 AND 50) SELECT * FROM (SELECT id, term, df, row_number() OVER (PARTITION BY id ORDER BY df, length(term) DESC, term) AS rank FROM p JOIN d USING (term)) WHERE rank <= 2")
def pick_facets(spark, d):
    return sampling.facets(table(spark, d, "ipc_links").select(F.col("patent_id").alias("id"), F.col("ipc_code").alias("term")), 2, 50, 2)


@_q("SELECT edge_id, t AS first_key, CASE WHEN regexp_matches(b, '^KR[12]0[0-9]{7,}$') THEN 'KR' || substr(b, 5) ELSE b END AS last_key FROM (SELECT *, regexp_replace(t, '([0-9])[A-Z][0-9]?$', '\\1') AS b FROM (SELECT edge_id, upper(regexp_replace(cited_raw, '[^A-Za-z0-9]', '', 'g')) AS t FROM prior_art_edges WHERE NOT coalesce(is_npl, false) AND regexp_matches(cited_raw, '^[A-Z]{2}')))")
def text_publication_keys(spark, d):
    e = table(spark, d, "prior_art_edges").where("not coalesce(is_npl, false) and cited_raw rlike '^[A-Z]{2}'").select("edge_id", C.publication_keys(F.col("cited_raw")).alias("k"))
    return e.select("edge_id", F.col("k")[0].alias("first_key"), F.element_at("k", -1).alias("last_key"))


@_q("SELECT count(*) AS n, round(avg((length(trim(claim1)) > 0 AND contains(regexp_replace(c.claims_full, '\\s+', ' ', 'g'), trim(regexp_replace(claim1, '\\s+', ' ', 'g'))))::int), 9) AS grounded FROM patents_meta p JOIN (SELECT doc_id, min(claims_full) AS claims_full FROM claim_texts GROUP BY 1) c ON c.doc_id = regexp_replace(p.patent_id, '^patent:', '') WHERE claim1 IS NOT NULL AND claims_full IS NOT NULL")
def text_grounded_quotes(spark, d):
    """How often a patent's first claim stands, white space aside, in its full claims."""
    c = table(spark, d, "claim_texts").groupBy("doc_id").agg(F.min("claims_full").alias("claims_full"))
    p = table(spark, d, "patents_meta").where("claim1 is not null").select(F.regexp_replace("patent_id", "^patent:", "").alias("doc_id"), "claim1")
    j = p.join(c.where("claims_full is not null"), "doc_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C.grounded(F.col("claim1"), F.col("claims_full")).cast("int")), 9).alias("grounded"))
