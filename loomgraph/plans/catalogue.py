"""The competency questions as graph patterns, each with the SQL it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.model import graph, with_relations
from loomgraph.operators.pattern import Graph, by_key, exists, natural, not_exists, optional, product, sequence, union, zero_or_one

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    """Register a function of a graph as a query under its own name."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(graph(spark, d))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_relations(sql)
        return f

    return add


def _n(c: str = "*", name: str = "n"):
    return F.count(c if c != "*" else F.lit(1)).alias(name)


_STEPS = "(SELECT s AS step, CASE o WHEN 'Process' THEN 'process' ELSE 'subprocess' END AS level FROM r_a WHERE o IN ('Process', 'SubProcess'))"
_PAT = "(SELECT s AS p FROM r_a WHERE o = 'Patent')"
_AXES = "(SELECT s AS concept, CASE o WHEN 'Process' THEN 'process' WHEN 'SubProcess' THEN 'subprocess' ELSE 'device' END AS axis FROM r_a WHERE o IN ('Process', 'SubProcess', 'Device'))"
_LINKS = "(SELECT s, o, 'process' AS axis FROM r_realizesProcess UNION ALL SELECT s, o, 'subprocess' FROM r_realizesProcess UNION ALL SELECT s, o, 'device' FROM r_concernsDevice )"


def _typed(g: Graph, var: str, names: dict[str, str], as_: str) -> DataFrame:
    """VALUES over types: nodes of each type with its name."""
    v = g.spark.createDataFrame(list(names.items()), f"type string, {as_} string")
    return g.scan((f"?{var}", "a:process|sub|chain|ptype|ptype2", "?type")).join(F.broadcast(v), "type").drop("type")  # one row per type named


_LEVELS = {"Process": "process", "SubProcess": "subprocess"}
_AXIS = _LEVELS | {"Device": "device"}


def _axis_links(g: Graph) -> DataFrame:
    """VALUES with a variable predicate: (axis, patent, concept)."""
    v = g.spark.createDataFrame([("process", "realizesProcess"), ("subprocess", "realizesProcess"), ("device", "concernsDevice")], "axis string, link string")
    return g.match(("?patent", "?link", "?concept"), predicates=["realizesProcess", "concernsDevice"]).join(F.broadcast(v), "link").drop("link")  # three rows


@_q(f"SELECT level, l.o AS step_label, count(*) AS n FROM {_STEPS} t JOIN r_label l ON l.s = step JOIN r_realizesProcess r ON r.o = step JOIN {_PAT} p ON p.p = r.s GROUP BY ALL")
def cq01(g):
    return natural(_typed(g, "step", _LEVELS, "level"), g.match(("?step", "label:process|sub|ptype", "?step_label"), ("?patent", "realizesProcess", "?step"), ("?patent", "a:patent", "Patent"))).groupBy("level", "step_label").agg(_n())


@_q(f"SELECT p AS patent, d.o AS date, l.o AS step_label FROM {_PAT} p JOIN r_filingDate d ON d.s = p JOIN r_realizesProcess r ON r.s = p JOIN r_label l ON l.s = r.o WHERE d.o >= '2021-01-01'")
def cq02(g):
    return g.match(("?patent", "filingDate", "?date"), ("?patent", "a:patent", "Patent"), ("?patent", "realizesProcess", "?step"), ("?step", "label:process|sub|ptype", "?step_label")).where("date >= '2021-01-01'").select("patent", "date", "step_label")


@_q(f"SELECT level, step, l.o AS step_label FROM {_STEPS} t JOIN r_label l ON l.s = step WHERE NOT EXISTS (SELECT 1 FROM r_realizesProcess r JOIN {_PAT} p ON p.p = r.s WHERE r.o = step)")
def cq03(g):
    """Steps that no patent realises."""
    steps = natural(_typed(g, "step", _LEVELS, "level"), g.match(("?step", "label:process|sub|ptype", "?step_label")))
    return not_exists(steps, g.match(("?p", "realizesProcess", "?step"), ("?p", "a:patent", "Patent")).select("step")).select("level", "step", "step_label")


@_q(f"SELECT c.axis, l.o AS concept_label, substr(d.o, 1, 4) AS year, count(*) AS n FROM {_AXES} c JOIN r_label l ON l.s = c.concept JOIN {_LINKS} k ON k.o = c.concept AND k.axis = c.axis JOIN {_PAT} p ON p.p = k.s JOIN r_filingDate d ON d.s = k.s GROUP BY ALL")
def cq04(g):
    c = natural(_typed(g, "concept", _AXIS, "axis"), _axis_links(g))
    return natural(c, g.match(("?concept", "label:process|sub|chain|ptype", "?concept_label"))).join(g.match(("?patent", "a:patent", "Patent"), ("?patent", "filingDate", "?date")), "patent").groupBy("axis", "concept_label", F.substring("date", 1, 4).alias("year")).agg(_n())


@_q(f"SELECT t.o AS ipc, substr(d.o, 1, 4) AS year, count(*) AS n FROM {_PAT} p JOIN r_hasIPC i ON i.s = p JOIN r_notation t ON t.s = i.o JOIN r_filingDate d ON d.s = p GROUP BY ALL")
def cq05(g):
    return g.match(("?patent", "hasIPC", "?symbol"), ("?patent", "a:patent", "Patent"), ("?symbol", "notation", "?ipc"), ("?patent", "filingDate", "?date")).groupBy("ipc", F.substring("date", 1, 4).alias("year")).agg(_n())


@_q(f"SELECT c.axis, l.o AS concept_label FROM {_AXES} c JOIN r_label l ON l.s = c.concept WHERE NOT EXISTS (SELECT 1 FROM {_LINKS} k JOIN r_filingDate d ON d.s = k.s WHERE k.o = c.concept AND k.axis = c.axis AND d.o >= '2023-06-01')")
def cq06(g):
    c = natural(_typed(g, "concept", _AXIS, "axis"), g.match(("?concept", "label:process|sub|chain|ptype", "?concept_label")))
    late = natural(_axis_links(g), g.match(("?patent", "filingDate", "?date")).where("date >= '2023-06-01'"))
    return not_exists(c, late.select("concept", "axis")).select("axis", "concept_label")


@_q("SELECT l.o AS device_label, m.o AS process_label, count(*) AS n FROM r_concernsDevice d JOIN r_realizesProcess r ON r.s = d.s JOIN r_label l ON l.s = d.o JOIN r_label m ON m.s = r.o GROUP BY ALL")
def cq07(g):
    return g.match(("?patent", "concernsDevice", "?device"), ("?patent", "realizesProcess", "?process"), ("?device", "label:chain", "?device_label"), ("?process", "label:process|sub", "?process_label")).groupBy("device_label", "process_label").agg(_n())


@_q("SELECT l.o AS applicant, count(DISTINCT r.o) AS steps, count(*) AS n FROM r_assignedTo a JOIN r_realizesProcess r ON r.s = a.s JOIN r_label l ON l.s = a.o GROUP BY ALL")
def cq08(g):
    return g.match(("?patent", "assignedTo", "?org"), ("?patent", "realizesProcess", "?process"), ("?org", "label:org", "?applicant")).groupBy("applicant").agg(F.countDistinct("process").alias("steps"), _n("patent"))


@_q("SELECT f.s AS patent, l.o AS title, f.o AS rejection_type, a.n_cited, b.n_examiner FROM r_rejectedFor f JOIN r_label l ON l.s = f.s JOIN (SELECT s, count(DISTINCT o) AS n_cited FROM r_hasPriorArt GROUP BY s) a ON a.s = f.s JOIN (SELECT s, count(DISTINCT o) AS n_examiner FROM r_hasPriorArtExaminer GROUP BY s) b ON b.s = f.s")
def cq09(g):
    """Two distinct counts over the product of two stars: counted star by star, so the product is never made."""
    base = g.match(("?patent", "rejectedFor", "?rejection_type"), ("?patent", "label:patent", "?title"))
    cited = g.match(("?patent", "hasPriorArt", "?c")).groupBy("patent").agg(F.countDistinct("c").alias("n_cited"))
    by = g.match(("?patent", "hasPriorArtExaminer", "?c")).groupBy("patent").agg(F.countDistinct("c").alias("n_examiner"))
    return base.join(cited, "patent").join(by, "patent")


@_q("SELECT r.s AS prior, d.o AS filed FROM r_realizesProcess r JOIN r_filingDate d ON d.s = r.s WHERE r.o = 'sub/H01L' AND d.o < '2015-01-01'")
def cq10(g):
    return g.match(("?prior", "realizesProcess", "sub/H01L"), ("?prior", "filingDate", "?filed")).where("filed < '2015-01-01'")


@_q("SELECT a.o AS step_label, b.o AS skill_label, c.o AS expert_label FROM r_requiresSkill r JOIN r_hasSkill h ON h.o = r.o JOIN r_label a ON a.s = r.s JOIN r_label b ON b.s = r.o JOIN r_label c ON c.s = h.s")
def cq11(g):
    return g.match(("?step", "requiresSkill", "?skill"), ("?step", "label:ptype", "?step_label"), ("?skill", "label:brand", "?skill_label"), ("?expert", "hasSkill", "?skill"), ("?expert", "label:expert", "?expert_label")).select("step_label", "skill_label", "expert_label")


@_q("SELECT pl.o AS problem_label, l.o AS process_label, el.o AS equipment_label, x.o AS expert_label FROM (SELECT s FROM r_a WHERE o = 'Problem') t JOIN r_label pl ON pl.s = t.s JOIN r_involvesProcess p ON p.s = t.s JOIN r_involvesEquipment e ON e.s = p.s JOIN r_label l ON l.s = p.o JOIN r_label el ON el.s = e.o JOIN r_suppliesProcess h ON h.o = p.o JOIN r_a ht ON ht.s = h.s AND ht.o = 'Expert' JOIN r_label x ON x.s = h.s")
def cq12(g):
    """An expert has the expertise of all that it ever supplied. The experts of a process get their labels first, then are unpacked in the tasks of the problems: the product is never shuffled, nor bound to a task a process."""
    problems = by_key(g.match(("?problem", "a:problem", "Problem"), ("?problem", "label:problem", "?problem_label")), "problem")
    equipment = by_key(g.match(("?problem", "involvesEquipment", "?equipment"), ("?equipment", "label:part", "?equipment_label")), "problem")
    where = natural(natural(problems, by_key(g.match(("?problem", "involvesProcess", "?process")), "problem")), equipment)
    experts = g.match(("?expert", "a:expert", "Expert"), ("?expert", "suppliesProcess", "?process"), ("?expert", "label:expert", "?expert_label"), ("?process", "label:ptype", "?process_label"))
    return product(where, experts.drop("expert"), "expert_label").select("problem_label", "process_label", "equipment_label", "expert_label")


@_q("SELECT h.s AS step, a.o AS supplier, count(DISTINCT a.s) AS n_patents FROM (SELECT s AS pat, o AS c FROM r_realizesProcess UNION ALL SELECT i.s, 'sub/' || n.o FROM r_hasIPC i JOIN r_notation n ON n.s = i.o) u JOIN r_hasSubprocess h ON h.o = u.c JOIN r_assignedTo a ON a.s = u.pat GROUP BY ALL")
def cq13(g):
    direct = g.match(("?patent", "realizesProcess", "?cls"))
    by_code = g.match(("?patent", "hasIPC", "?code"), ("?code", "notation", "?n4")).select("patent", F.concat(F.lit("sub/"), "n4").alias("cls"))
    return natural(natural(union(direct, by_code), g.match(("?step", "hasSubprocess", "?cls"))), g.match(("?patent", "assignedTo", "?supplier"))).groupBy("step", "supplier").agg(F.countDistinct("patent").alias("n_patents"))


@_q("SELECT c.o AS company_type, count(DISTINCT c.s) AS n_firms, count(DISTINCT h.s) AS n_firms_with_skills FROM r_companyType c LEFT JOIN (SELECT * FROM r_hasSkill) h ON h.s = c.s GROUP BY ALL")
def cq14(g):
    owner = g.match(("?company", "hasSkill", "?skill")).select("company", F.col("company").alias("owner")).distinct()
    return optional(g.match(("?company", "companyType", "?company_type")), owner).groupBy("company_type").agg(F.countDistinct("company").alias("n_firms"), F.countDistinct("owner").alias("n_firms_with_skills"))


@_q("SELECT pl.o AS problem_label, fl.o AS failure_label, sl.o AS step_label, cl.o AS cause_label, ml.o AS mitigation_label, kl.o AS skill_label FROM (SELECT s FROM r_a WHERE o = 'Patent') p JOIN r_label pl ON pl.s = p.s JOIN r_exhibitsFailureMode f ON f.s = p.s JOIN r_label fl ON fl.s = f.o JOIN r_occursAtProcessStep t ON t.s = f.o JOIN r_label sl ON sl.s = t.o JOIN r_isDueTo c ON c.s = f.o JOIN r_label cl ON cl.s = c.o JOIN r_mitigatedBy m ON m.s = c.o JOIN r_label ml ON ml.s = m.o JOIN r_mitigationProvidesSkill k ON k.s = m.o JOIN r_label kl ON kl.s = k.o")
def cq15(g):
    """A chain of eight hops; what follows from a failure is joined first, once a failure, then met by the problems."""
    cause = g.match(("?failure", "a:failure", "FailureMode"), ("?failure", "label:failure", "?failure_label"), ("?failure", "occursAtProcessStep", "?step"), ("?step", "label:process", "?step_label"), ("?failure", "isDueTo", "?cause"))
    cure = g.match(("?cause", "a:cause", "RootCause"), ("?cause", "label:cause", "?cause_label"), ("?cause", "mitigatedBy", "?mitigation"), ("?mitigation", "a:mit", "Mitigation"), ("?mitigation", "label:mit", "?mitigation_label"), ("?mitigation", "mitigationProvidesSkill", "?skill"), ("?skill", "a:skill", "Skill"), ("?skill", "label:skill", "?skill_label"))
    problems = g.match(("?problem", "exhibitsFailureMode", "?failure"), ("?problem", "a:patent", "Patent"), ("?problem", "label:patent", "?problem_label"))
    return natural(problems, natural(cause, cure)).select("problem_label", "failure_label", "step_label", "cause_label", "mitigation_label", "skill_label")


@_q("SELECT l.o AS step_label, m.o AS material_label, u.o AS forbidden FROM r_hasSubprocess s JOIN (SELECT * FROM r_subjectToControl UNION ALL SELECT h.s, j.o FROM r_subjectToControl h JOIN r_hasJurisdiction j ON j.s = h.o) u ON u.s = s.o JOIN r_label l ON l.s = s.s JOIN r_label m ON m.s = s.o")
def cq16(g):
    barred = union(g.match(("?material", "subjectToControl", "?forbidden")), g.match(("?material", "subjectToControl", "?c"), ("?c", "hasJurisdiction", "?forbidden")).drop("c"))
    return natural(g.match(("?step", "hasSubprocess", "?material"), ("?step", "label:group", "?step_label"), ("?material", "label:sub", "?material_label")), barred).select("step_label", "material_label", "forbidden")


@_q("SELECT pl.o AS problem_label, l.o AS material_label, x.o AS expert_label FROM (SELECT s FROM r_a WHERE o = 'Problem') t JOIN r_label pl ON pl.s = t.s JOIN r_involvesMaterial p ON p.s = t.s JOIN r_label l ON l.s = p.o JOIN r_hasMaterialExpertise h ON h.o = p.o JOIN r_a ht ON ht.s = h.s AND ht.o = 'Expert' JOIN r_label x ON x.s = h.s")
def cq17(g):
    """As in cq12, the product is the last join."""
    experts = g.match(("?expert", "a:expert", "Expert"), ("?expert", "hasMaterialExpertise", "?material"), ("?expert", "label:expert", "?expert_label"), ("?material", "label:mat", "?material_label"))
    return natural(g.match(("?problem", "a:problem", "Problem"), ("?problem", "label:problem", "?problem_label"), ("?problem", "involvesMaterial", "?material")), experts).select("problem_label", "material_label", "expert_label")


@_q("SELECT l.o AS skill_label, count(DISTINCT c.s) AS n_patents, min(t.o) AS example FROM r_concernsDevice c JOIN r_label t ON t.s = c.s JOIN r_label l ON l.s = c.o GROUP BY ALL")
def cq18(g):
    """SAMPLE is the least title."""
    return g.match(("?patent", "concernsDevice", "?skill"), ("?patent", "label:patent", "?title"), ("?skill", "label:chain", "?skill_label")).groupBy("skill_label").agg(F.countDistinct("patent").alias("n_patents"), F.min("title").alias("example"))


@_q("SELECT l.o AS step_label, k.o AS knob_label FROM (SELECT s, o FROM r_realizesProcess UNION ALL SELECT s, o FROM r_concernsDevice ) u JOIN r_label l ON l.s = u.s JOIN r_label k ON k.s = u.o JOIN r_a t ON t.s = u.o WHERE t.o IN ('Process', 'Device')")
def cq19(g):
    either = union(g.match(("?step", "realizesProcess", "?knob")), g.match(("?step", "concernsDevice", "?knob")))
    kinds = union(g.match(("?knob", "a:process|ptype2", "Process")), g.match(("?knob", "a:chain", "Device")))
    return natural(natural(natural(either, g.match(("?step", "label:patent", "?step_label"))), g.match(("?knob", "label:process|sub|chain", "?knob_label"))), kinds).select("step_label", "knob_label")


@_q("SELECT l.o AS equipment_label, x.o AS expert_label FROM r_hasProcessExpertise h JOIN r_a t ON t.s = h.o AND t.o IN ('Step', 'Process') JOIN r_label l ON l.s = h.o JOIN r_label x ON x.s = h.s")
def cq20(g):
    kinds = union(g.match(("?equipment", "a:ptype|ptype2", "Step")), g.match(("?equipment", "a:process|ptype2", "Process")))
    return natural(g.match(("?expert", "hasProcessExpertise", "?equipment"), ("?equipment", "label:ptype", "?equipment_label"), ("?expert", "label:expert", "?expert_label")), kinds).select("equipment_label", "expert_label")


@_q("SELECT a.o AS group_label, b.o AS step_label, count(DISTINCT r.s) AS n_patents FROM r_hasSubprocess h JOIN r_label a ON a.s = h.s JOIN r_label b ON b.s = h.o LEFT JOIN (SELECT r.* FROM r_realizesProcess r JOIN r_filingDate d ON d.s = r.s AND d.o >= '2022-01-01') r ON r.o = h.o GROUP BY ALL")
def cq21(g):
    """Groups without patents keep a zero."""
    right = g.match(("?patent", "realizesProcess", "?step"), ("?patent", "filingDate", "?date")).where("date >= '2022-01-01'").select("patent", "step")
    return optional(g.match(("?group", "hasSubprocess", "?step"), ("?group", "label:group", "?group_label"), ("?step", "label:sub", "?step_label")), right).groupBy("group_label", "step_label").agg(F.countDistinct("patent").alias("n_patents"))


@_q("SELECT t.o AS title, l.o AS target_label FROM (SELECT s, o FROM r_realizesProcess UNION ALL SELECT s, o FROM r_concernsDevice UNION ALL SELECT s, o FROM r_assignedTo ) u JOIN r_label t ON t.s = u.s JOIN r_label l ON l.s = u.o JOIN r_a k ON k.s = u.o AND k.o IN ('SubProcess', 'Device', 'Vendor')")
def cq22(g):
    links = union(*(g.match(("?patent", p, "?target")) for p in ("realizesProcess", "concernsDevice", "assignedTo")))
    kinds = union(*(g.match(("?target", f"a:{c}", k)) for c, k in (("sub", "SubProcess"), ("chain", "Device"), ("org", "Vendor"))))
    return natural(natural(natural(links, g.match(("?patent", "label:patent", "?title"))), g.match(("?target", "label:process|sub|chain|org", "?target_label"))), kinds).select("title", "target_label")


@_q("SELECT c.s AS concept, cl.o AS control_label, v.o AS level, j.o AS jurisdiction FROM r_subjectToControl c JOIN r_controlLevel v ON v.s = c.o LEFT JOIN r_label cl ON cl.s = c.o LEFT JOIN (SELECT h.s, n.o FROM r_hasJurisdiction h JOIN r_jurisdictionNotation n ON n.s = h.o) j ON j.s = c.o")
def cq23(g):
    """Two OPTIONALs, the second of two patterns."""
    base = optional(g.match(("?concept", "subjectToControl", "?control"), ("?control", "controlLevel", "?level")), g.match(("?control", "label:control", "?control_label")))
    return optional(base, g.match(("?control", "hasJurisdiction", "?jur"), ("?jur", "jurisdictionNotation", "?jurisdiction")).drop("jur")).select("concept", "control_label", "level", "jurisdiction")


@_q("SELECT c.s AS concept, l.o AS concept_label, j.o AS nct FROM r_subjectToControl c JOIN r_hasJurisdiction j ON j.s = c.o LEFT JOIN r_label l ON l.s = c.s")
def cq24(g):
    return optional(g.match(("?concept", "subjectToControl", "?control"), ("?control", "hasJurisdiction", "?nct")), g.match(("?concept", "label:process|sub|chain|ptype", "?concept_label"))).select("concept", "concept_label", "nct")


@_q("SELECT c.s AS concept, l.o AS concept_label FROM r_subjectToControl c JOIN r_controlLevel v ON v.s = c.o AND v.o = 'CRITICAL' LEFT JOIN r_label l ON l.s = c.s")
def cq25(g):
    return optional(g.match(("?concept", "subjectToControl", "?control"), ("?control", "controlLevel", "CRITICAL")), g.match(("?concept", "label:process|sub|chain|ptype", "?concept_label"))).select("concept", "concept_label")


@_q("SELECT u.s AS patent, v.o AS level, j.o AS jurisdiction FROM (SELECT s, o FROM r_realizesProcess UNION ALL SELECT s, o FROM r_concernsDevice ) u JOIN r_subjectToControl c ON c.s = u.o JOIN r_controlLevel v ON v.s = c.o LEFT JOIN r_hasJurisdiction j ON j.s = c.o")
def cq26(g):
    either = union(g.match(("?patent", "realizesProcess", "?concept")), g.match(("?patent", "concernsDevice", "?concept")))
    return optional(natural(either, g.match(("?concept", "subjectToControl", "?control"), ("?control", "controlLevel", "?level"))), g.match(("?control", "hasJurisdiction", "?jurisdiction"))).select("patent", "level", "jurisdiction")


@_q("SELECT l.o AS org_label, count(DISTINCT a.s) AS n_ready FROM r_claimText t JOIN r_claimCount c ON c.s = t.s JOIN r_assignedTo a ON a.s = t.s JOIN r_label l ON l.s = a.o GROUP BY ALL")
def cq27(g):
    return g.match(("?patent", "claimText", "?claim"), ("?patent", "claimCount", "?n"), ("?patent", "assignedTo", "?org"), ("?org", "label:org", "?org_label")).groupBy("org_label").agg(F.countDistinct("patent").alias("n_ready"))


@_q("SELECT f.o AS ground, l.o AS pat_label, n.s AS judgment FROM r_rejectedFor f JOIN r_label l ON l.s = f.s JOIN (SELECT s, substr(o, 1, 3) AS o FROM r_onGround ) n ON n.o = f.o JOIN r_aboutApplication b ON b.s = n.s AND f.s = 'patent:kr_' || b.o")
def cq28(g):
    cases = g.match(("?judgment", "onGround", "?full"), ("?judgment", "aboutApplication", "?app")).select("judgment", F.substring("full", 1, 3).alias("ground"), F.concat(F.lit("patent:kr_"), "app").alias("pat"))
    return natural(g.match(("?pat", "rejectedFor", "?ground"), ("?pat", "label:patent", "?pat_label")), cases).select("ground", "pat_label", "judgment")


@_q("SELECT c.o AS claim, d.o AS prior_art, o.o AS ground, count(DISTINCT c.s) AS n_judgment FROM r_judgesClaim c JOIN r_supportedBy b ON b.s = c.s JOIN r_includesDocument d ON d.s = b.o JOIN r_onGround o ON o.s = c.s GROUP BY ALL")
def cq29(g):
    return g.match(("?j", "judgesClaim", "?claim"), ("?j", "supportedBy", "?set"), ("?set", "includesDocument", "?prior_art"), ("?j", "onGround", "?ground")).groupBy("claim", "prior_art", "ground").agg(F.countDistinct("j").alias("n_judgment"))


@_q("SELECT c.s AS claim, count(DISTINCT f.o) AS n_feature FROM (SELECT s FROM r_a WHERE o = 'Claim') c JOIN r_isIndependent i ON i.s = c.s AND i.o = 'true' JOIN r_hasFeature f ON f.s = c.s JOIN r_featureText t ON t.s = f.o WHERE starts_with(c.s, 'claim/rej_') GROUP BY ALL")
def cq30(g):
    """Features of the independent claims of rejected patents; the prefix goes to every pattern of the claim."""
    of = lambda df: df.where(F.col("claim").startswith("claim/rej_"))
    base = natural(of(g.match(("?claim", "a:claim", "Claim"))), natural(of(g.match(("?claim", "isIndependent", "true"))), of(g.match(("?claim", "hasFeature", "?feature")))))
    return natural(base, g.match(("?feature", "featureText", "?text"))).groupBy("claim").agg(F.countDistinct("feature").alias("n_feature"))


@_q("SELECT d.o AS parent, count(DISTINCT d.s) AS n_dependent FROM (SELECT s FROM r_a WHERE o = 'Claim') c JOIN r_dependsOnClaim d ON d.s = c.s WHERE starts_with(d.s, 'claim/rej_') GROUP BY ALL")
def cq31(g):
    return g.match(("?child", "dependsOnClaim", "?parent"), ("?child", "a:claim", "Claim")).where(F.col("child").startswith("claim/rej_")).groupBy("parent").agg(F.countDistinct("child").alias("n_dependent"))


_NEEDS = "(SELECT needs, count(*) AS n_profiles FROM (SELECT s, string_agg(DISTINCT o, ',' ORDER BY o) AS needs FROM r_rejectedFor GROUP BY s) GROUP BY needs)"
_HOLDS = "(SELECT holds, count(*) AS n_disclosures FROM (SELECT s, string_agg(DISTINCT o, ',' ORDER BY o) AS holds FROM r_onGround GROUP BY s) GROUP BY holds)"
_COVER = "(SELECT o AS c, o AS found FROM r_rejectedFor UNION SELECT s, o FROM r_coveredBy)"


@_q(f"SELECT needs, holds, count(*) AS n_uncovered, max(n_profiles) AS n_profiles, max(n_disclosures) AS n_disclosures FROM (SELECT a.*, h.*, unnest(string_split(needs, ',')) AS c FROM {_NEEDS} a, {_HOLDS} h) x WHERE NOT EXISTS (SELECT 1 FROM {_COVER} k WHERE k.c = x.c AND list_contains(string_split(x.holds, ','), k.found)) GROUP BY needs, holds")
def cq32(g):
    """Needed concepts that a disclosure lacks, covered within one step at most, between classes of equal sets.

    Profiles with the same needs, and disclosures with the same holdings, are one
    class with its size; what is multiplied are sets of legal bases, which the
    statute bounds, never documents.
    """
    sets = lambda df, of, name, n: df.groupBy(of).agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias(name)).groupBy(name).agg(_n(name=n))
    needs = sets(g.match(("?profile", "rejectedFor", "?c")), "profile", "needs", "n_profiles")
    holds = sets(g.match(("?disclosure", "onGround", "?c")), "disclosure", "holds", "n_disclosures")
    start = g.match(("?profile", "rejectedFor", "?c")).select("c")
    found = holds.select("holds", F.explode(F.split("holds", ",")).alias("found"))
    covered = natural(zero_or_one(g, "coveredBy", start, "c", "found"), found).select("c", "holds").distinct()
    wanted = natural(needs, holds).withColumn("c", F.explode(F.split("needs", ",")))  # classes of sets
    return not_exists(wanted, covered).groupBy("needs", "holds").agg(_n(name="n_uncovered"), F.max("n_profiles").alias("n_profiles"), F.max("n_disclosures").alias("n_disclosures"))


@_q("SELECT t.s AS disclosure, d.o AS filed FROM (SELECT s FROM r_country WHERE o = 'EP') t LEFT JOIN r_filingDate d ON d.s = t.s WHERE d.o IS NULL OR d.o < '2005-01-01'")
def cq33(g):
    return optional(g.match(("?disclosure", "country", "EP")), g.match(("?disclosure", "filingDate", "?filed"))).where("filed is null or filed < '2005-01-01'")


_SETDOC = "r_supportedBy b JOIN r_includesDocument d ON d.s = b.o"


@_q(f"SELECT b.s AS j, b.o AS set, count(DISTINCT d.o) AS docs FROM {_SETDOC} GROUP BY ALL HAVING count(DISTINCT d.o) >= 2")
def cqa01(g):
    return g.match(("?j", "supportedBy", "?set"), ("?set", "includesDocument", "?doc")).groupBy("j", "set").agg(F.countDistinct("doc").alias("docs")).where("docs >= 2")


@_q("SELECT r.s AS j, r.o AS premise FROM r_refersToJudgment r JOIN r_onGround a ON a.s = r.s AND a.o = '§29②' JOIN r_onGround b ON b.s = r.o AND b.o = '§29①'")
def cqa02(g):
    return g.match(("?j", "refersToJudgment", "?premise"), ("?j", "onGround", "§29②"), ("?premise", "onGround", "§29①"))


@_q("SELECT c.s AS j, c.o AS claim FROM r_judgesClaim c JOIN r_scope s ON s.s = c.s AND s.o = '1|2'")
def cqa03(g):
    return g.match(("?j", "judgesClaim", "?claim"), ("?j", "scope", "1|2"))


@_q("SELECT b.s AS j, count(DISTINCT b.o) AS alternatives FROM r_supportedBy b JOIN r_a t ON t.s = b.s AND t.o = 'ExaminerJudgment' GROUP BY ALL HAVING count(DISTINCT b.o) >= 2")
def cqa04(g):
    return g.match(("?j", "a:judgment", "ExaminerJudgment"), ("?j", "supportedBy", "?set")).groupBy("j").agg(F.countDistinct("set").alias("alternatives")).where("alternatives >= 2")


@_q("SELECT b.s AS j, b.o AS set FROM r_supportedBy b JOIN r_reliesOnCommonKnowledge k ON k.s = b.o AND k.o = 'true' WHERE NOT EXISTS (SELECT 1 FROM r_includesDocument d WHERE d.s = b.o)")
def cqa05(g):
    return not_exists(g.match(("?j", "supportedBy", "?set"), ("?set", "reliesOnCommonKnowledge", "true")), g.match(("?set", "includesDocument", "?any")).select("set")).select("j", "set")


@_q("SELECT d.o AS doc, t.o AS type, v.o AS value, c.o AS claim_term FROM (SELECT s FROM r_a WHERE o = 'EvidenceLink') l JOIN r_inDocument d ON d.s = l.s JOIN r_locatorType t ON t.s = l.s AND t.o IN ('LocParagraph', 'LocFigure') JOIN r_locatorValue v ON v.s = l.s LEFT JOIN r_claimTerm c ON c.s = l.s")
def cqa06(g):
    kinds = g.spark.createDataFrame([("LocParagraph",), ("LocFigure",)], "type string")
    base = natural(g.match(("?link", "a:link", "EvidenceLink"), ("?link", "inDocument", "?doc"), ("?link", "locatorType", "?type"), ("?link", "locatorValue", "?value")), F.broadcast(kinds))  # two rows
    return optional(base, g.match(("?link", "claimTerm", "?claim_term"))).select("doc", "type", "value", "claim_term")


@_q("SELECT p.o AS j, count(DISTINCT d.o) AS docs, count(DISTINCT l.s) AS links FROM (SELECT s FROM r_a WHERE o = 'EvidenceLink') l JOIN r_partOfJudgment p ON p.s = l.s JOIN r_inDocument d ON d.s = l.s GROUP BY ALL HAVING count(DISTINCT d.o) >= 2")
def cqa07(g):
    return g.match(("?link", "a:link", "EvidenceLink"), ("?link", "partOfJudgment", "?j"), ("?link", "inDocument", "?doc")).groupBy("j").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("link").alias("links")).where("docs >= 2")


_BOUNDS = "SELECT s, split_part(o, '|', 1) AS unit, try_cast(split_part(o, '|', 2) AS double) AS lo, try_cast(split_part(o, '|', 3) AS double) AS hi FROM "
_PAIRS = f"r_ofPatent p JOIN ({_BOUNDS} r_claimedInterval) c ON c.s = p.o JOIN r_inDocument i ON i.s = p.s JOIN ({_BOUNDS} r_disclosedInterval) d ON d.s = i.o AND d.unit = c.unit"


def _intervals(g: Graph) -> DataFrame:
    """(link, unit, cl, ch, dl, dh): claimed and disclosed intervals of a link in one unit; the units are the join key, the bounds its rest."""
    part = lambda i: F.split_part("o", F.lit("|"), F.lit(i))
    bounds = lambda p, s, lo, hi: g.predicate(p).select(F.col("s").alias(s), part(1).alias("unit"), part(2).try_cast("double").alias(lo), part(3).try_cast("double").alias(hi))
    links = g.match(("?link", "ofPatent", "?patent"), ("?link", "inDocument", "?doc"))
    return links.join(bounds("claimedInterval", "patent", "cl", "ch"), "patent").join(bounds("disclosedInterval", "doc", "dl", "dh"), ["doc", "unit"])


@_q(f"SELECT p.s AS link, c.unit, c.lo AS cl, c.hi AS ch, d.lo AS dl, d.hi AS dh FROM {_PAIRS} WHERE c.lo <= d.hi AND d.lo <= c.hi")
def cqa09(g):
    """Numeric ranges that overlap, ends included, in the same unit."""
    return _intervals(g).where("cl <= dh and dl <= ch").select("link", "unit", "cl", "ch", "dl", "dh")


@_q(f"SELECT p.s AS link, c.unit, c.lo AS claim_bound, d.lo AS disclosed_bound FROM {_PAIRS} WHERE c.hi IS NULL AND d.lo >= c.lo UNION ALL SELECT p.s, c.unit, c.hi, d.hi FROM {_PAIRS} WHERE c.lo IS NULL AND d.hi <= c.hi")
def cqa10(g):
    """Thresholds: claims bounded on one side, met by a disclosed bound."""
    i = _intervals(g)
    return union(i.where("ch is null and dl >= cl").select("link", "unit", F.col("cl").alias("claim_bound"), F.col("dl").alias("disclosed_bound")), i.where("cl is null and dh <= ch").select("link", "unit", F.col("ch").alias("claim_bound"), F.col("dh").alias("disclosed_bound")))


@_q("SELECT DISTINCT n.o AS claim_term, i.o AS document_term, r.o AS doc FROM r_hasIPC i JOIN r_notation n ON n.s = i.o LEFT JOIN r_hasPriorArtExaminer r ON r.s = i.s WHERE n.o <> i.o")
def cqa08(g):
    right = g.match(("?x", "hasPriorArtExaminer", "?doc"))
    return optional(g.match(("?x", "hasIPC", "?document_term"), ("?document_term", "notation", "?claim_term")), right).where("claim_term <> document_term").select("claim_term", "document_term", "doc").distinct()


@_q("SELECT DISTINCT g.s AS j, g.o AS claim FROM r_judgesClaim g JOIN r_supportedBy b ON b.s = g.s JOIN r_citeForm f ON f.s = b.o AND f.o = 'label'")
def cqa11(g):
    return g.match(("?j", "supportedBy", "?set"), ("?j", "judgesClaim", "?claim"), ("?set", "citeForm", "label")).select("j", "claim").distinct()


@_q("SELECT DISTINCT g.s AS j, g.o AS ground FROM r_onGround g JOIN r_supportedBy b ON b.s = g.s JOIN r_citeForm f ON f.s = b.o AND f.o = 'colon'")
def cqa12(g):
    return g.match(("?j", "supportedBy", "?set"), ("?j", "onGround", "?ground"), ("?set", "citeForm", "colon")).select("j", "ground").distinct()


_BASE = "(SELECT s, min(o) AS base FROM r_includesDocument GROUP BY s)"


def _base_doc(g: Graph) -> DataFrame:
    """The base document of a set is its least one."""
    return g.match(("?set", "includesDocument", "?doc")).groupBy("set").agg(F.min("doc").alias("base"))


@_q(f"SELECT DISTINCT b.s AS j, k.base, d.o AS other FROM r_supportedBy b JOIN r_hasRationale r ON r.s = b.o AND r.o = 'CombinationMotivation' JOIN {_BASE} k ON k.s = b.o JOIN r_includesDocument d ON d.s = b.o WHERE d.o <> k.base")
def cqa13(g):
    return natural(g.match(("?j", "supportedBy", "?set"), ("?set", "hasRationale", "CombinationMotivation"), ("?set", "includesDocument", "?other")), _base_doc(g)).where("other <> base").select("j", "base", "other").distinct()


@_q("SELECT DISTINCT b.s AS j, b.o AS set FROM r_supportedBy b JOIN r_citeForm f ON f.s = b.o AND f.o = 'unlabeled'")
def cqa14(g):
    return g.match(("?j", "supportedBy", "?set"), ("?set", "citeForm", "unlabeled")).distinct()


@_q(f"SELECT DISTINCT b.s AS j, k.base, d.o AS donor FROM r_supportedBy b JOIN r_hasRationale r ON r.s = b.o AND r.o = 'Substitution' JOIN {_BASE} k ON k.s = b.o LEFT JOIN r_includesDocument d ON d.s = b.o AND d.o <> k.base")
def cqa15(g):
    left = natural(g.match(("?j", "supportedBy", "?set"), ("?set", "hasRationale", "Substitution")), _base_doc(g))
    return optional(left, g.match(("?set", "includesDocument", "?donor")), F.col("donor") != F.col("base")).select("j", "base", "donor").distinct()


_FIRED = "(SELECT DISTINCT j.s AS j, c.o AS claim, d.o AS doc FROM r_onGround j JOIN r_judgesClaim c ON c.s = j.s JOIN r_supportedBy b ON b.s = j.s JOIN r_includesDocument d ON d.s = b.o WHERE j.o = '{}')"
_RA = f"SELECT DISTINCT a.j, a.claim FROM {_FIRED.format('§29①')} a WHERE NOT EXISTS (SELECT 1 FROM {_FIRED.format('§29②')} b WHERE b.claim = a.claim AND b.doc = a.doc) AND NOT EXISTS (SELECT 1 FROM r_refersToJudgment r JOIN r_onGround o ON o.s = r.s AND o.o = '§29②' JOIN r_judgesClaim k ON k.s = r.s WHERE r.o = a.j AND k.o = a.claim)"


def _judged(g: Graph, ground: str) -> DataFrame:
    return g.match(("?j", "onGround", ground), ("?j", "judgesClaim", "?claim"), ("?j", "supportedBy", "?set"), ("?set", "includesDocument", "?doc")).select("j", "claim", "doc").distinct()


def rule_a(g: Graph) -> DataFrame:
    """Novelty implies inventiveness: (inf, j, claim) where no judgment says so for the claim yet."""
    open_ = not_exists(_judged(g, "§29①"), _judged(g, "§29②").select("claim", "doc"))
    cross = g.match(("?j2", "refersToJudgment", "?j"), ("?j2", "onGround", "§29②"), ("?j2", "judgesClaim", "?claim")).select("j", "claim")
    out = not_exists(open_, cross).select("j", "claim").distinct()
    return out.select(F.concat(F.lit("inferred/RA_"), F.translate(F.concat_ws("__", "j", "claim"), "/", "_")).alias("inf"), "j", "claim")


@_q(f"SELECT 'inferred/RA_' || replace(j || '__' || claim, '/', '_') AS inf, j, claim FROM ({_RA}) z")
def rule_novelty_implies_inventiveness(g):
    return rule_a(g)


_RE = "SELECT DISTINCT r.s AS judgment, r.o AS premise, b.o AS set FROM r_refersToJudgment r JOIN r_supportedBy b ON b.s = r.o WHERE r.s <> r.o"


def rule_e(g: Graph) -> DataFrame:
    """Evidence inheritance, one hop: (judgment, premise, set)."""
    return g.match(("?judgment", "refersToJudgment", "?premise"), ("?premise", "supportedBy", "?set")).where("judgment <> premise").distinct()


@_q(f"SELECT 'inferred/RE_' || replace(judgment || '__' || premise, '/', '_') AS inf, judgment, premise, set FROM ({_RE}) z")
def rule_evidence_inheritance(g):
    return rule_e(g).select(F.concat(F.lit("inferred/RE_"), F.translate(F.concat_ws("__", "judgment", "premise"), "/", "_")).alias("inf"), "judgment", "premise", "set")


_LEGAL = "r_legalGround l JOIN r_aboutClaim c ON c.s = l.s JOIN r_overPriorArt d ON d.s = l.s"
_RA_JUDGED = f"SELECT DISTINCT l.s AS j, c.o AS claim, d.o AS doc FROM {_LEGAL} WHERE l.o = '§29①' AND NOT EXISTS (SELECT 1 FROM (SELECT c.o AS claim, d.o AS doc FROM {_LEGAL} WHERE l.o = '§29②') x WHERE x.claim = c.o AND x.doc = d.o)"


def _legal(g: Graph, ground: str) -> DataFrame:
    return g.match(("?j", "legalGround", ground), ("?j", "aboutClaim", "?claim"), ("?j", "overPriorArt", "?doc"))


@_q(f"SELECT DISTINCT 'inferred/RJ_' || replace(j || '__' || claim, '/', '_') AS inf, j, claim, doc FROM ({_RA_JUDGED}) z")
def rule_judgment_layer(g):
    """Novelty implies inventiveness in the judgment layer: for each claim and document not judged so yet."""
    open_ = not_exists(_legal(g, "§29①"), _legal(g, "§29②").select("claim", "doc"))
    return open_.select(F.concat(F.lit("inferred/RJ_"), F.translate(F.concat_ws("__", "j", "claim"), "/", "_")).alias("inf"), "j", "claim", "doc").distinct()


@_q(f"SELECT DISTINCT claim, doc, source FROM (SELECT c.o AS claim, d.o AS doc, 'examiner' AS source FROM {_LEGAL} WHERE l.o = '§29②' UNION ALL SELECT claim, doc, 'examiner' FROM {_FIRED.format('§29②')} x UNION ALL SELECT z.claim, d.o, 'rule' FROM ({_RA}) z JOIN r_supportedBy b ON b.s = z.j JOIN r_includesDocument d ON d.s = b.o UNION ALL SELECT claim, doc, 'rule' FROM ({_RA_JUDGED}) w) y")
def cqr01(g):
    """Three branches, sources tagged; the evidence of an inferred judgment is reached by a sequence path or stands beside it."""
    docs = sequence(g, "j", ["supportedBy", "includesDocument"], "doc")
    told = lambda df, source: df.select("claim", "doc", F.lit(source).alias("source"))
    open_ = not_exists(_legal(g, "§29①"), _legal(g, "§29②").select("claim", "doc"))
    return union(told(_legal(g, "§29②"), "examiner"), told(_judged(g, "§29②"), "examiner"), told(rule_a(g).join(docs, "j"), "rule"), told(open_, "rule")).distinct()


@_q(f"SELECT s AS judgment, o AS set, 'direct' AS how FROM r_supportedBy UNION SELECT judgment, set, 'inherited' FROM ({_RE}) z")
def cqr02(g):
    direct = g.match(("?judgment", "supportedBy", "?set")).withColumn("how", F.lit("direct"))
    return union(direct, rule_e(g).select("judgment", "set", F.lit("inherited").alias("how"))).distinct()


@_q("SELECT a.s AS j, a.o AS start_ground, z.o AS ground FROM r_onGround a JOIN (SELECT s, s AS e FROM r_onGround UNION SELECT s, o FROM r_refersToJudgment ) p ON p.s = a.s JOIN r_onGround z ON z.s = p.e WHERE a.o = '§36'")
def path_zero_or_one(g):
    start = g.match(("?j", "onGround", "?start_ground")).where("start_ground = '§36'")
    return natural(start, zero_or_one(g, "refersToJudgment", start, "j", "e")).join(g.match(("?e", "onGround", "?ground")), "e").select("j", "start_ground", "ground")


@_q("SELECT r.s AS patent, l.o AS title, f.o AS basis, d.o AS date FROM r_rejectedFor f JOIN r_realizesProcess r ON r.s = f.s JOIN r_subjectToControl c ON c.s = r.o AND c.o = 'control/C' JOIN r_label l ON l.s = f.s LEFT JOIN r_filingDate d ON d.s = f.s")
def example_regulatory_risk(g):
    base = g.match(("?patent", "realizesProcess", "?cls"), ("?cls", "subjectToControl", "control/C"), ("?patent", "rejectedFor", "?basis"), ("?patent", "label:patent", "?title"))
    return optional(base, g.match(("?patent", "filingDate", "?date"))).select("patent", "title", "basis", "date")


@_q("SELECT f.s AS patent, f.o AS failure, p.o AS step, s.o AS status, d.o AS date FROM r_rejectedFor f JOIN r_realizesProcess p ON p.s = f.s AND p.o LIKE 'process/%' LEFT JOIN r_status s ON s.s = f.s LEFT JOIN r_filingDate d ON d.s = f.s")
def example_path(g):
    base = g.match(("?patent", "rejectedFor", "?failure"), ("?patent", "realizesProcess", "?step")).where("step like 'process/%'")
    return optional(optional(base, g.match(("?patent", "status", "?status"))), g.match(("?patent", "filingDate", "?date"))).select("patent", "failure", "step", "status", "date")


@_q("SELECT t.s AS step, count(DISTINCT k.o) AS skills, count(DISTINCT h.s) AS experts FROM (SELECT s FROM r_a WHERE o = 'Step') t LEFT JOIN r_requiresSkill k ON k.s = t.s LEFT JOIN r_hasProcessExpertise h ON h.o = t.s GROUP BY ALL HAVING count(DISTINCT k.o) < 25 OR count(DISTINCT h.s) < 70")
def example_gap(g):
    skills = g.match(("?step", "requiresSkill", "?k")).groupBy("step").agg(F.countDistinct("k").alias("skills"))
    experts = g.match(("?e", "hasProcessExpertise", "?step")).groupBy("step").agg(F.countDistinct("e").alias("experts"))
    return optional(optional(g.match(("?step", "a:ptype", "Step")), skills), experts).fillna(0, ["skills", "experts"]).where("skills < 25 or experts < 70").select("step", "skills", "experts")
