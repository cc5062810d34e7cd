"""The patent tables as a graph: one relation (s, o) a predicate.

Each relation is given as (table, subject, object, split, condition) so that the
Spark relation and its SQL come from one place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.pattern import Graph


@dataclass(frozen=True)
class Rel:
    """``subject`` and ``obj`` are SQL expressions; ``split`` names a column (or array) whose parts are ``x``.

    ``cls`` names the class of the subjects, where a predicate has several with
    subjects of their own; ``unique`` says that no pair repeats. Expressions are
    Spark SQL; ``DIALECT`` holds what DuckDB writes in another way.
    """

    source: str
    subject: str
    obj: str
    split: str | None = None
    array: bool = False
    where: str = "true"
    cls: str = ""
    unique: bool = False

    def spark(self) -> str:
        if not self.split:
            return f"SELECT {self.subject} AS s, {self.obj} AS o FROM {self.source} WHERE {self.where}"
        parts = self.split if self.array else f"split({self.split}, '[|]')"
        return f"SELECT {self.subject} AS s, {self.obj} AS o FROM (SELECT *, explode({parts}) AS x FROM {self.source}) WHERE {self.where}"

    def duck(self) -> str:
        full = f"({self.where}) AND {self.subject} IS NOT NULL AND {self.obj} IS NOT NULL"
        parts = self.split if self.array or not self.split else f"string_split({self.split}, '|')"
        source = f"(SELECT *, unnest({parts}) AS x FROM {self.source})" if self.split else self.source
        out = f"SELECT DISTINCT {self.subject} AS s, {self.obj} AS o FROM {source} WHERE {full}"
        for a, b in DIALECT.items():
            out = out.replace(a, b)
        return out


_DOC = "'doc/' || upper(trim({}))"
_CITED = "NOT coalesce(is_npl, false) AND trim(cited_doc_id) <> ''"
_J, _SET = "'judgment/' || cast(section_id AS string)", "'set/' || cast(section_id AS string)"
_CLAIM = "'claim/' || application_number || '/' || cast(x AS string)"
#: Claims of a text numbered at line starts, each with its number; features are parted by semicolons.
_CLAIMS = "split(regexp_replace(claims_full, '(^|\\\\n) *([0-9]{1,3})[.．] ', concat(chr(1), '$2. ')), chr(1))"
_NO = "regexp_extract(c, '^([0-9]{1,3})[.]', 1)"
_EACH_CLAIM = f"(SELECT doc_id, source, explode({_CLAIMS}) AS c FROM claim_texts) z"
_CLAIM_ID = "'claim/' || CASE source WHEN 'g0_rej' THEN 'rej' ELSE source END || '_' || doc_id || '/' || {}"
_PARENT = "coalesce(nullif(regexp_extract(c, '제 ?([0-9]+) ?항', 1), ''), nullif(regexp_extract(c, '[Cc]laims? ([0-9]+)', 1), ''), nullif(regexp_extract(c, '請求項 ?([0-9]+)', 1), ''))"
_FEATURE = "'feature/' || md5(trim(x))"
#: Numbers with their unit in a text, as an interval a unit; a unit met once is bounded on one side.
_UNITS = "nm|μm|mm|Å|kHz|rpm|sccm|kPa|mTorr|°C|%"
_NUMBER = f"regexp_extract_all({{}}, '[0-9]+(?:[.][0-9]+)? (?:{_UNITS})', 0)"
_BY_UNIT = "(SELECT {id} AS id, unit, CASE WHEN count(*) > 1 OR unit NOT IN ('%', '°C') THEN min(v) END AS lo, CASE WHEN count(*) > 1 OR unit IN ('%', '°C') THEN max(v) END AS hi FROM (SELECT {id}, split(x, ' ')[1] AS unit, cast(split(x, ' ')[0] AS double) AS v FROM (SELECT {id}, explode({numbers}) AS x FROM {table})) GROUP BY {id}, unit) z"
_CLAIMED = _BY_UNIT.format(id="patent_id", numbers=_NUMBER.format("claim1"), table="patents_meta")
_DISCLOSED = _BY_UNIT.format(id="cited_doc_id", numbers=_NUMBER.format("abstract"), table="(SELECT DISTINCT upper(trim(cited_doc_id)) AS cited_doc_id, abstract FROM cited_enriched WHERE trim(cited_doc_id) <> '')")
_LINK, _EVIDENCE = "'link/' || cast(edge_id AS string)", _CITED + " AND source_type LIKE 'evidence%'"
_FORM = "'set/' || cast(section_id AS string) || '/' || x.value"
_NO_DOCS = "coalesce(array_size(cited_ids), 0) = 0"
_FAILURE = "'fm/' || process_family || '/' || substr(x, 1, 3)"
#: What each supplier supplies most, by quantity: its expertise.
_MOST = "(SELECT l_suppkey, what FROM (SELECT l_suppkey, {what} AS what, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, {what}) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, {what}) WHERE n = 1) z"
#: Spark SQL -> DuckDB.
DIALECT = {" AS string)": " AS varchar)", _CLAIMS: "string_split(regexp_replace(claims_full, '(^|\\n) *([0-9]{1,3})[.．] ', concat(chr(1), '\\2. '), 'g'), chr(1))", "explode(": "unnest(", "array_size(": "len(", "split(x, ' ')[1]": "split_part(x, ' ', 2)", "split(x, ' ')[0]": "split_part(x, ' ', 1)", "split(c, ';')": "string_split(c, ';')"}
_DATE = "CASE WHEN filing_date LIKE '____-__-__' THEN filing_date END"
_SECTION_JOIN = "(SELECT a.section_id AS later, b.section_id AS earlier FROM notice_sections a JOIN notice_sections b ON a.application_number = b.application_number AND a.section = b.section + 1)"
_LINKS = "(SELECT l_orderkey, l_suppkey, l_partkey, p_brand, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"

#: Predicate name -> relation. ``a`` is the type. Within ``a`` and ``label`` the subjects of different classes never meet.
RELATIONS: dict[str, list[Rel]] = {
    "a": [
        Rel("patents_meta", "patent_id", "'Patent'", cls="patent", unique=True),
        Rel("patents_meta", "'process/' || process_family", "'Process'", where="process_family <> ''", cls="process"),
        Rel("ipc_links", "'sub/' || ipc_4digit", "'SubProcess'", cls="sub"),
        Rel("patents_meta", "'chain/' || x", "'Device'", split="value_chain", where="x <> ''", cls="chain"),
        Rel("patents_meta", "'org/' || x", "'Vendor'", split="applicant_en", where="x <> ''", cls="org"),
        Rel("notice_sections", _J, "'ExaminerJudgment'", cls="judgment"),
        Rel("cited_enriched", _DOC.format("cited_doc_id"), "'Disclosure'", cls="doc"),
        Rel("supplier", "'expert/' || cast(s_suppkey AS string)", "'Expert'", cls="expert", unique=True),
        Rel("part", "'ptype/' || p_type", "'Step'", cls="ptype"),
        Rel("part", "'ptype/' || p_type", "'Process'", cls="ptype2"),
        Rel("orders", "'problem/' || cast(o_orderkey AS string)", "'Problem'", cls="problem", unique=True),
        Rel(_EACH_CLAIM, _CLAIM_ID.format(_NO), "'Claim'", where=f"{_NO} <> ''", cls="claim"),
        Rel("prior_art_edges", _LINK, "'EvidenceLink'", where=_EVIDENCE, cls="link", unique=True),
        Rel("patents_meta", _FAILURE, "'FailureMode'", split="rejection_legal_bases", where="x <> '' AND process_family <> ''", cls="failure"),
        Rel("patents_meta", "'cause/' || substr(x, 1, 3)", "'RootCause'", split="rejection_legal_bases", where="x <> ''", cls="cause"),
        Rel("patents_meta", "'mit/' || x", "'Mitigation'", split="rejection_legal_bases", where="x <> ''", cls="mit"),
        Rel("patents_meta", "'skill/' || primary_ipc_section", "'Skill'", where="primary_ipc_section <> ''", cls="skill"),
    ],
    "label": [
        Rel("patents_meta", "patent_id", "title", where="title <> ''", cls="patent", unique=True),
        Rel("patents_meta", "'process/' || process_family", "process_family", where="process_family <> ''", cls="process"),
        Rel("ipc_links", "'sub/' || ipc_4digit", "ipc_4digit", cls="sub"),
        Rel("ipc_links", "'group/' || ipc_section", "ipc_section", cls="group"),
        Rel("patents_meta", "'chain/' || x", "x", split="value_chain", where="x <> ''", cls="chain"),
        Rel("patents_meta", "'org/' || x", "x", split="applicant_en", where="x <> ''", cls="org"),
        Rel("supplier", "'expert/' || cast(s_suppkey AS string)", "s_name", cls="expert", unique=True),
        Rel("part", "'ptype/' || p_type", "p_type", cls="ptype"),
        Rel("part", "'brand/' || p_brand", "p_brand", cls="brand"),
        Rel("part", "'part/' || cast(p_partkey AS string)", "p_name", cls="part", unique=True),
        Rel("part", "'mat/' || cast(p_size AS string)", "'size ' || cast(p_size AS string)", cls="mat"),
        Rel("nation", "'nation/' || cast(n_nationkey AS string)", "n_name", cls="nation", unique=True),
        Rel("orders", "'problem/' || cast(o_orderkey AS string)", "'order ' || cast(o_orderkey AS string)", cls="problem", unique=True),
        Rel("ipc_links", "'control/' || ipc_section", "'control of ' || ipc_section", where="ipc_section IN ('B', 'C', 'H')", cls="control"),
        Rel("patents_meta", _FAILURE, "process_family || ' ' || substr(x, 1, 3)", split="rejection_legal_bases", where="x <> '' AND process_family <> ''", cls="failure"),
        Rel("patents_meta", "'cause/' || substr(x, 1, 3)", "substr(x, 1, 3)", split="rejection_legal_bases", where="x <> ''", cls="cause"),
        Rel("patents_meta", "'mit/' || x", "x", split="rejection_legal_bases", where="x <> ''", cls="mit"),
        Rel("patents_meta", "'skill/' || primary_ipc_section", "primary_ipc_section", where="primary_ipc_section <> ''", cls="skill"),
    ],
    "filingDate": [Rel("patents_meta", "patent_id", _DATE, cls="patent", unique=True), Rel("cited_enriched", _DOC.format("cited_doc_id"), _DATE, where="resolved", cls="doc")],
    "realizesProcess": [Rel("patents_meta", "patent_id", "'process/' || process_family", where="process_family <> ''", unique=True), Rel("ipc_links", "patent_id", "'sub/' || ipc_4digit")],
    "concernsDevice": [Rel("patents_meta", "patent_id", "'chain/' || x", split="value_chain", where="x <> ''")],
    "assignedTo": [Rel("patents_meta", "patent_id", "'org/' || x", split="applicant_en", where="x <> ''")],
    "hasIPC": [Rel("ipc_links", "patent_id", "ipc_code")],
    "notation": [Rel("ipc_links", "ipc_code", "ipc_4digit")],
    "hasSubprocess": [Rel("ipc_links", "'group/' || ipc_section", "'sub/' || ipc_4digit")],
    "rejectedFor": [Rel("patents_meta", "patent_id", "substr(x, 1, 3)", split="rejection_legal_bases", where="x <> ''")],
    "hasPriorArt": [Rel("prior_art_edges", "target_patent_id", _DOC.format("cited_doc_id"), where=_CITED)],
    "hasPriorArtExaminer": [Rel("prior_art_edges", "target_patent_id", _DOC.format("cited_doc_id"), where=_CITED + " AND source_type = 'examiner'")],
    "claimText": [Rel("patents_meta", "patent_id", "claim1", where="claim1 <> ''", unique=True)],
    "claimCount": [Rel("patents_meta", "patent_id", "cast(n_claims_full AS string)", unique=True)],
    "status": [Rel("patents_meta", "patent_id", "examination_status", where="examination_status <> ''", unique=True)],
    "country": [Rel("cited_enriched", _DOC.format("cited_doc_id"), "country")],
    "exhibitsFailureMode": [Rel("patents_meta", "patent_id", _FAILURE, split="rejection_legal_bases", where="x <> '' AND process_family <> ''")],
    "occursAtProcessStep": [Rel("patents_meta", _FAILURE, "'process/' || process_family", split="rejection_legal_bases", where="x <> '' AND process_family <> ''")],
    "isDueTo": [Rel("patents_meta", _FAILURE, "'cause/' || substr(x, 1, 3)", split="rejection_legal_bases", where="x <> '' AND process_family <> ''")],
    "mitigatedBy": [Rel("patents_meta", "'cause/' || substr(x, 1, 3)", "'mit/' || x", split="rejection_legal_bases", where="x <> ''")],
    "mitigationProvidesSkill": [Rel("patents_meta", "'mit/' || x", "'skill/' || primary_ipc_section", split="rejection_legal_bases", where="x <> '' AND primary_ipc_section <> ''")],
    "aboutApplication": [Rel("notice_sections", _J, "application_number")],
    "onGround": [Rel("notice_sections", _J, "x", split="legal_bases", array=True)],
    "judgesClaim": [Rel("notice_sections", _J, _CLAIM, split="target_claims", array=True)],
    "scope": [Rel("notice_sections", _J, "subclause", where="subclause <> ''")],
    # A judgment rests on one set a form of citation, or on common knowledge where it cites nothing.
    "supportedBy": [Rel("notice_sections", _J, _FORM, split="map_entries(cite_forms)", array=True), Rel("notice_sections", _J, _SET + " || '/none'", where=_NO_DOCS)],
    "reliesOnCommonKnowledge": [Rel("notice_sections", _SET + " || '/none'", "'true'", where=_NO_DOCS), Rel("notice_sections", _FORM, "'false'", split="map_entries(cite_forms)", array=True)],
    "includesDocument": [Rel("notice_sections", _FORM, _DOC.format("x.key"), split="map_entries(cite_forms)", array=True, where="trim(x.key) <> ''")],
    "citeForm": [Rel("notice_sections", _FORM, "x.value", split="map_entries(cite_forms)", array=True)],
    "hasRationale": [Rel("notice_sections", _FORM, "CASE x.value WHEN 'label' THEN 'CombinationMotivation' WHEN 'colon' THEN 'Substitution' ELSE 'DesignChange' END", split="map_entries(cite_forms)", array=True)],
    "refersToJudgment": [Rel(_SECTION_JOIN + " z", "'judgment/' || cast(later AS string)", "'judgment/' || cast(earlier AS string)")],
    "coveredBy": [Rel("notice_sections", "substr(x, 1, 3)", "x", split="legal_bases", array=True, where="length(x) > 3")],
    # The judgment layer and the links of evidence: one of each an edge.
    "legalGround": [Rel("prior_art_edges", "'pj/' || cast(edge_id AS string)", "x", split="legal_bases", where="x <> '' AND " + _CITED, unique=True)],
    "aboutClaim": [Rel("prior_art_edges", "'pj/' || cast(edge_id AS string)", "'claim/' || target_patent_id || '/1'", where=_CITED, unique=True)],
    "overPriorArt": [Rel("prior_art_edges", "'pj/' || cast(edge_id AS string)", _DOC.format("cited_doc_id"), where=_CITED, unique=True)],
    "inDocument": [Rel("prior_art_edges", _LINK, _DOC.format("cited_doc_id"), where=_EVIDENCE, unique=True)],
    "partOfJudgment": [Rel("prior_art_edges", _LINK, "'case/' || target_patent_id", where=_EVIDENCE, unique=True)],
    "ofPatent": [Rel("prior_art_edges", _LINK, "target_patent_id", where=_EVIDENCE, unique=True)],
    "locatorType": [Rel("prior_art_edges", _LINK, "CASE cited_kind WHEN 'grant' THEN 'LocFigure' WHEN 'publication' THEN 'LocParagraph' ELSE 'LocPage' END", where=_EVIDENCE, unique=True)],
    "locatorValue": [Rel("prior_art_edges", _LINK, "cited_raw", where=_EVIDENCE + " AND cited_raw <> ''", unique=True)],
    "claimTerm": [Rel("prior_art_edges", _LINK, "x", split="legal_bases", where="x <> '' AND " + _EVIDENCE)],
    "isIndependent": [Rel(_EACH_CLAIM, _CLAIM_ID.format(_NO), f"CASE WHEN {_PARENT} IS NULL THEN 'true' ELSE 'false' END", where=f"{_NO} <> ''")],
    "dependsOnClaim": [Rel(_EACH_CLAIM, _CLAIM_ID.format(_NO), _CLAIM_ID.format(_PARENT), where=f"{_NO} <> ''")],
    "hasFeature": [Rel(_EACH_CLAIM, _CLAIM_ID.format(_NO), _FEATURE, split="split(c, ';')", array=True, where=f"{_NO} <> '' AND trim(x) <> ''")],
    "featureText": [Rel(_EACH_CLAIM, _FEATURE, "trim(x)", split="split(c, ';')", array=True, where="trim(x) <> ''")],
    "claimedInterval": [Rel(_CLAIMED, "id", "unit || '|' || coalesce(cast(lo AS string), '') || '|' || coalesce(cast(hi AS string), '')")],
    "disclosedInterval": [Rel(_DISCLOSED, "'doc/' || id", "unit || '|' || coalesce(cast(lo AS string), '') || '|' || coalesce(cast(hi AS string), '')")],
    "companyType": [Rel("supplier", "'expert/' || cast(s_suppkey AS string)", "'nation/' || cast(s_nationkey AS string)", unique=True)],
    "hasSkill": [Rel(_LINKS + " z", "'expert/' || cast(l_suppkey AS string)", "'brand/' || p_brand")],
    "requiresSkill": [Rel("part", "'ptype/' || p_type", "'brand/' || p_brand")],
    "involvesProcess": [Rel(_LINKS + " z", "'problem/' || cast(l_orderkey AS string)", "'ptype/' || p_type")],
    "involvesEquipment": [Rel(_LINKS + " z", "'problem/' || cast(l_orderkey AS string)", "'part/' || cast(l_partkey AS string)")],
    "involvesMaterial": [Rel(_LINKS + " z", "'problem/' || cast(l_orderkey AS string)", "'mat/' || cast(p_size AS string)")],
    "hasProcessExpertise": [Rel(_MOST.format(what="p_type"), "'expert/' || cast(l_suppkey AS string)", "'ptype/' || what", unique=True)],
    # All that it ever supplied.
    "suppliesProcess": [Rel(_LINKS + " z", "'expert/' || cast(l_suppkey AS string)", "'ptype/' || p_type")],
    "hasMaterialExpertise": [Rel(_MOST.format(what="p_size"), "'expert/' || cast(l_suppkey AS string)", "'mat/' || cast(what AS string)", unique=True)],
    "subjectToControl": [Rel("ipc_links", "'sub/' || ipc_4digit", "'control/' || ipc_section")],
    "controlLevel": [Rel("ipc_links", "'control/' || ipc_section", "CASE WHEN ipc_section IN ('H', 'G') THEN 'CRITICAL' ELSE 'STANDARD' END")],
    "hasJurisdiction": [Rel("ipc_links", "'control/' || ipc_section", "'KR'", where="ipc_section IN ('C', 'H')")],
    "jurisdictionNotation": [Rel("ipc_links", "'KR'", "'Republic of Korea'")],
}
TABLES = ["patents_meta", "ipc_links", "claim_texts", "prior_art_edges", "notice_sections", "cited_enriched", "supplier", "part", "orders", "lineitem", "nation"]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables of ``sf_dir``.

    ``label:patent|org`` is the part of a predicate whose subjects are of these
    classes; it reads their tables only. A predicate is a set: each part drops
    repeated pairs unless it has none.
    """

    def make(rels: list[Rel]) -> DataFrame:
        out = None
        for r in rels:
            sql, frames = r.spark().replace("{", "{{").replace("}", "}}"), {}
            for t in TABLES:
                if re.search(rf" {t}\b", sql):
                    sql = re.sub(rf" {t}\b", f" {{{t}}}", sql)
                    frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            df = spark.sql(sql, **frames).where("s is not null and o is not null")
            df = df if r.unique else df.distinct()
            out = df if out is None else out.unionByName(df)
        return out if len({r.cls for r in rels}) == len(rels) else out.distinct()

    def part(name: str):
        base, _, classes = name.partition(":")
        if base not in RELATIONS:
            return None
        rels = [r for r in RELATIONS[base] if not classes or r.cls in classes.split("|")]
        return lambda: make(rels)

    return Graph(spark, dict.fromkeys(RELATIONS), part)


def with_relations(body: str) -> str:
    """DuckDB statement: ``body`` with the relations it names (``r_<predicate>``) put before it."""
    used = [n for n in RELATIONS if re.search(rf"\br_{n}\b", body)]
    ctes = ",\n".join(f"r_{n} AS (" + " UNION ".join(r.duck() for r in RELATIONS[n]) + ")" for n in used)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {ctes}\n{body}"
