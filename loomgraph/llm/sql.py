"""DuckDB statements for those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from loomgraph.functions.keys import STAND_INS
from loomgraph.llm.lookalike import INVISIBLE, SPELT, lookalike_map

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def _has(c: str) -> str:
    words = ", ".join(f"'{x}'" for x in STAND_INS)
    return f"coalesce(lower(trim({c}, {_BLANKS})) NOT IN ('', {words}), false)"


def _p1() -> str:
    fields = ["title", "abstract", "claims", "filing_date", "ipc", "cpc", "applicants"]
    parts = " UNION ALL ".join(f"SELECT k, '{f}' AS field_name, record_id, rs, rk, fetched_at FROM r WHERE {_has(f)}" for f in fields)
    return f"""
WITH r AS (SELECT e.*, upper(trim(cited_doc_id, {_BLANKS})) AS k, coalesce(resolved, false) AS rs, coalesce(trust_rank, 1000000) AS rk
           FROM cited_enriched e LEFT JOIN source_trust t ON e.source = t.source),
     g AS (SELECT k FROM r WHERE k <> '' GROUP BY k HAVING count(*) > 1), v AS ({parts}),
     o AS (SELECT *, row_number() OVER (PARTITION BY k, field_name ORDER BY rs DESC, rk, fetched_at DESC NULLS LAST, record_id) AS n FROM v)
SELECT k AS cited_doc_id, field_name, record_id FROM o WHERE n = 1 AND k IN (SELECT k FROM g)"""


def _p2() -> str:
    a, b = (x.replace("'", "''") for x in lookalike_map())
    parts = " UNION ALL ".join(f"SELECT '{f}' AS field_name, {i} AS id, {f} AS t FROM {tbl} WHERE {f} IS NOT NULL" for tbl, i, f in (("citations", "citation_id", "original"), ("citations", "citation_id", "raw"), ("cited_enriched", "record_id", "claims")))
    spelt = "t"
    for x, y in SPELT.items():
        spelt = f"replace({spelt}, '{x}', '{y}')"
    return f"""
WITH r AS ({parts}), n AS (SELECT *, md5(nfc_normalize(translate(regexp_replace({spelt}, '{INVISIBLE}', '', 'g'), '{a}', '{b}'))) AS k FROM r)
SELECT x.field_name, x.id AS id_a, y.id AS id_b FROM n x JOIN n y ON x.field_name = y.field_name AND x.k = y.k AND x.id < y.id AND x.t <> y.t"""


def _p2_canonical() -> str:
    body, _, _ = _p2().rpartition("SELECT x.field_name")
    nulls = " UNION ALL ".join(f"SELECT '{f}', {i}, NULL, false FROM {tbl} WHERE {f} IS NULL" for tbl, i, f in (("citations", "citation_id", "original"), ("citations", "citation_id", "raw"), ("cited_enriched", "record_id", "claims")))
    return f"""{body}, fm AS (SELECT DISTINCT field_name, k, t FROM n), cl AS (SELECT field_name, k, first(t ORDER BY length(regexp_replace(t, '[\\x00-\\x7f]', '', 'g')), length(t), t) AS canonical FROM fm GROUP BY ALL HAVING count(*) > 1)
SELECT n.field_name, n.id, coalesce(cl.canonical, n.t) AS canonical, coalesce(cl.canonical <> n.t, false) AS changed FROM n LEFT JOIN cl USING (field_name, k) UNION ALL {nulls}"""


_P6 = """
SELECT DISTINCT 'cited_enriched' AS tbl, cast(record_id AS varchar) AS item_id FROM cited_enriched WHERE length(claims) > 3000
UNION ALL SELECT DISTINCT 'claim_texts', doc_id FROM claim_texts WHERE length(claims_full) > 3000"""


#: Different texts with their words (the n-th occurrence of a word is a word of its own), and pairs that share 85 in 100: brute force, for small tables.
_NEAR = """tx AS (SELECT DISTINCT t, md5(t) AS h FROM r), wd AS (SELECT h, w, row_number() OVER (PARTITION BY h, w) AS k FROM (SELECT h, unnest(regexp_split_to_array(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)), '[\\s\\p{Z}]+')) AS w FROM tx)),
sz AS (SELECT h, count(*) AS n FROM wd GROUP BY h), co AS (SELECT a.h AS ha, b.h AS hb, count(*) AS c FROM wd a JOIN wd b USING (w, k) GROUP BY ALL), nr AS (SELECT ha, hb FROM co JOIN sz x ON x.h = ha JOIN sz y ON y.h = hb WHERE c >= 0.85 * greatest(x.n, y.n))"""


def _p3() -> str:
    parts = " UNION ALL ".join(f"SELECT record_id, coalesce(nullif(upper(trim(cited_doc_id, {_BLANKS})), ''), '') AS key, '{f}' AS f, {f} AS t FROM cited_enriched WHERE {_has(f)}" for f in ("abstract", "claims"))
    return f"""
WITH r AS ({parts}), {_NEAR}
SELECT DISTINCT a.record_id AS record_id_a, b.record_id AS record_id_b FROM r a JOIN nr ON nr.ha = md5(a.t) JOIN r b ON md5(b.t) = nr.hb AND a.f = b.f AND a.key <> b.key AND a.record_id < b.record_id"""


def _p4_rows() -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT doc_id, source, '{f}' AS f, {f} AS t FROM claim_texts WHERE {_has(f)}" for f in ("claims_full", "first_independent"))
    canon = "regexp_replace(lower({}.t), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    return f"""
WITH r AS ({parts}), sp AS (SELECT DISTINCT doc_id, lower(trim(split, {_BLANKS})) AS split FROM splits WHERE doc_id IS NOT NULL), {_NEAR},
cn AS (SELECT h, nullif({canon.format('tx')}, '') AS c FROM tx), lk AS (SELECT ha, hb FROM nr UNION SELECT a.h, b.h FROM cn a JOIN cn b USING (c)),
m AS (SELECT a.doc_id AS train_id, b.doc_id AS eval_id, a.f, sb.split FROM r a JOIN sp sa ON sa.doc_id = a.doc_id AND sa.split = 'train' JOIN lk ON lk.ha = md5(a.t) JOIN r b ON md5(b.t) = lk.hb AND a.f = b.f AND a.doc_id <> b.doc_id JOIN sp sb ON sb.doc_id = b.doc_id AND sb.split IN ('dev', 'test', 'test_b'))"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _p1(), "p2_found": _p2(), "p2_canonical": _p2_canonical(), "p3_found": _p3(), "p4_found": _p4_rows() + " SELECT DISTINCT least(train_id, eval_id) AS doc_id_a, greatest(train_id, eval_id) AS doc_id_b FROM m", "p6_found": _P6}
