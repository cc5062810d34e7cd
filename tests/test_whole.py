"""Queries over whole relations: nothing is left out that the question does not ask for."""

import pytest

import __spark_entry__ as e

TABLES = {
    "patents_meta": ("patent_id string, process_family string, value_chain string, applicant_en string, title string, rejection_legal_bases string, primary_ipc_section string", []),
    "ipc_links": ("patent_id string, ipc_4digit string, ipc_section string, ipc_code string", [("p1", "A01B", "A", "A01B1/00"), ("p1", "H10B", "H", "H10B1/00"), ("p2", "C07D", "C", "C07D1/00")]),
    "claim_texts": ("doc_id string, source string, claims_full string", []),
    "prior_art_edges": ("target_patent_id string, cited_doc_id string, is_npl boolean, source_type string", [("p1", "US1", False, "examiner"), ("p1", "EP1", False, "examiner")]),
    "notice_sections": ("section_id bigint", []),
    "cited_enriched": ("cited_doc_id string", []),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey bigint", [(1, "S1", 1), (2, "S2", 1), (3, "S3", 1)]),
    "part": ("p_partkey bigint, p_name string, p_type string, p_brand string, p_size int", [(1, "P1", "T1", "Brand#11", 1), (2, "P2", "T2", "Brand#53", 30), (3, "P3", "T3", "Brand#44", 50)]),
    "orders": ("o_orderkey bigint, o_orderpriority string", [(1, "1-URGENT"), (2, "5-LOW")]),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double", [(1, 1, 1, 5.0), (1, 2, 1, 9.0), (2, 2, 2, 1.0), (2, 2, 2, 1.0)]),
    "nation": ("n_nationkey bigint, n_name string", [(1, "N1")]),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    for name, (schema, data) in TABLES.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_parts_of_any_size_and_orders_of_any_priority(spark, tables):
    run = lambda name: rows(e.queries()[name](spark, tables))
    assert run("cq11") == [("T1", "Brand#11", "S1"), ("T2", "Brand#53", "S1"), ("T2", "Brand#53", "S2")]
    # An expert's expertise is what it supplies most: T2 and size 30 for both.
    assert run("cq12") == sorted([("order 1", "T2", p, x) for p in ("P1", "P2") for x in ("S1", "S2")] + [("order 2", "T2", "P2", x) for x in ("S1", "S2")])
    assert run("cq17") == [(f"order {o}", "size 30", x) for o in (1, 2) for x in ("S1", "S2")]
    assert run("cq20") == [("T2", "S1"), ("T2", "S1"), ("T2", "S2"), ("T2", "S2")]  # a type is a step and a process
    assert run("example_gap") == [("ptype/T1", 1, 0), ("ptype/T2", 1, 2), ("ptype/T3", 1, 0)]


def test_skills_of_any_brand_and_terms_of_any_class(spark, tables):
    run = lambda name: rows(e.queries()[name](spark, tables))
    assert run("cq14") == [("nation/1", 3, 2)]
    want = [(t, f"{t}1/00", d) for t in ("A01B", "H10B") for d in ("doc/EP1", "doc/US1")]
    assert run("cqa08") == sorted([*want, ("C07D", "C07D1/00", None)], key=repr)


def test_experts_are_matched_by_class(spark, tmp_path, monkeypatch):
    """40 experts and 4 problems of one need each are one pair of classes, and the result has all 160 pairs."""
    from loomgraph.plans import graph_queries

    data = {
        "supplier": [(i, f"S{i}", 1) for i in range(40)],
        "part": [(1, "P1", "T1", "Brand#11", 7)],
        "orders": [(50 * i, "1-URGENT") for i in range(4)],
        "lineitem": [(50 * (i % 4), 1, i, 1.0) for i in range(40)],
    }
    for name, (schema, old) in TABLES.items():
        spark.createDataFrame(data.get(name, old), schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sizes, real = {}, graph_queries.materialize
    monkeypatch.setattr(graph_queries, "materialize", lambda df, name="stage": (out := real(df, name), sizes.setdefault(name, []).append(out.count()))[0])
    got = rows(e.queries()["match_experts"](spark, str(tmp_path)).select("expert", "problem", "n_shared"))
    assert got == sorted(((f"expert/{i}", f"problem/{50 * j}", 2) for i in range(40) for j in range(4)), key=repr)
    assert sizes["met"] == [1]


def test_experts_of_one_process_meet_problems_in_many_tasks(spark, tmp_path, monkeypatch):
    """one process is one key of the last join, yet its product is made in more than one task; the same rows the ordinary way."""
    from pyspark.sql import functions as F

    from loomgraph.operators import pattern

    data = {
        "supplier": [(i, f"S{i}", 1) for i in range(40)],
        "part": [(1, "P1", "T1", "Brand#11", 7)],
        "orders": [(i, "1-URGENT") for i in range(50)],
        "lineitem": [(i % 50, 1, i % 40, 1.0) for i in range(200)],
    }
    for name, (schema, old) in TABLES.items():
        spark.createDataFrame(data.get(name, old), schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want = sorted((f"order {o}", "T1", "P1", f"S{i}") for o in range(50) for i in range(40))
    df = e.queries()["cq12"](spark, str(tmp_path))
    assert rows(df) == want
    assert df.select(F.spark_partition_id()).distinct().count() > 1
    monkeypatch.setattr(pattern, "FEW", 39)
    assert rows(e.queries()["cq12"](spark, str(tmp_path))) == want


def test_experts_of_all_they_supply(spark, tables):
    """S1 supplies T2 most, and T1 too."""
    want = [(o, t, p, x) for o, ts, ps in (("order 1", ("T1", "T2"), ("P1", "P2")), ("order 2", ("T2",), ("P2",))) for t in ts for p in ps for x in (("S1",) if t == "T1" else ("S1", "S2"))]
    assert rows(e.queries()["cq12"](spark, tables)) == sorted(want)
