from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.keys import doc_key, has_value
from loomgraph.operators import boolsearch, closure, constraints, faults, metrics, ranking, retrieval, statistics
from loomgraph.operators.components import components
from loomgraph.operators.packed import parse, unpack
from loomgraph.operators.pattern import Graph, natural, not_exists, optional, sequence, union, zero_or_one
from loomgraph.operators.skew import hot_keys, join_unique
from loomgraph.operators.references import orphans, patent_parents, patent_references


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- keys and packed fields


def test_keys_and_values(spark):
    df = spark.createDataFrame([(" kr-1　",), ("",), (None,), ("N/A",), ("없음",), ("-",), ("x" * 100,), (" ",)], "c string")
    got = [tuple(r) for r in df.select(doc_key("c"), has_value("c")).collect()]
    assert got[0] == ("KR-1", True)
    assert got[1] == (None, False) and got[2] == (None, False) and got[7] == (None, False)
    assert [g[1] for g in got[3:7]] == [False, False, False, True]
    padded = [" " * 100 + "N/A", "\t" * 80, "　" * 70 + "없음\n", "n/a or more", "UNKNOWN", " " * 90 + "x", "-" * 3]
    df = spark.createDataFrame([(x,) for x in padded], "c string")
    assert [r[0] for r in df.select(has_value("c")).collect()] == [False, False, False, True, False, True, True]


@pytest.mark.parametrize(
    "text,codes,want",
    [
        ("A/S Foo\nBar Co., Ltd.", False, ["A/S Foo", "Bar Co., Ltd."]),
        ('"A|B Lab"; C, Inc.', False, ["A|B Lab", "C, Inc."]),
        ('The "X" Institute; Y', False, ['The "X" Institute', "Y"]),
        ('"The ""X"" Institute","Y, Inc."', False, ['The "X" Institute', "Y, Inc."]),
        ("a||b|", False, ["a", "b"]),
        ("a / b；c、d", False, ["a", "b", "c", "d"]),
        ('["H05H 1/65", "G03F 7/68"]', True, ["H05H 1/65", "G03F 7/68"]),
        ("H01L21/51  B65G49/48 B08B 3/1(2006.01)", True, ["H01L21/51", "B65G49/48", "B08B 3/1(2006.01)"]),
        ("주식회사 가온,A/S Kaltem", False, ["주식회사 가온", "A/S Kaltem"]),
        ('"X Co., Ltd.",A/S Y', False, ["X Co., Ltd.", "A/S Y"]),
        ("K Works, A/S; B, Co., Ltd. (Korea), C", False, ["K Works, A/S", "B, Co., Ltd. (Korea)", "C"]),
        ("[A61K 8/00; B01D 1/2]", True, ["A61K 8/00", "B01D 1/2"]),
        ('"A", [x; y]', False, ["A", "[x; y]"]),
        ("[a]; [b [c]]", False, ["[a]", "[b [c]]"]),
        ('["a]", "b"]', False, ["a]", "b"]),
        (None, False, []),
        ("  ", False, []),
    ],
)
def test_parse(text, codes, want):
    assert parse(text, codes)[0] == want


def test_parse_backtracks():
    assert parse('"open; b', False) == (['"open', "b"], ["unclosed_quote"])
    assert parse("[a; b", False) == (["[a", "b"], ["unclosed_bracket"])
    assert parse('"a" b; c', False) == (['"a" b', "c"], ["text_after_quote"])


_NAMES = ["Foo Works", "A/S Bar", "Baz Co., Ltd.", "Qux, Inc.", "주식회사 가온", "AB Nor", "Plain LLC", "K B.V."]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([*_NAMES, "Left|Right Lab", 'The "X" Institute', "M; N, and O"]), st.booleans()), min_size=1, max_size=6), st.sampled_from([",", ", ", ";", "; ", "|", " | ", "\n", "；", "、", " / "]))
def test_packed_round_trip(values, sep):
    """Values with legal forms, quoted where they hold marks, come back whatever parts them."""
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    packed = sep.join(quote(v) if quoted or v not in _NAMES else v for v, quoted in values)
    assert parse(packed) == ([v for v, _ in values], [])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet='ab"|;, ', min_size=1, max_size=8).map(str.strip).filter(bool), min_size=2, max_size=5))
def test_quoted_round_trip(values):
    packed = "|".join('"' + v.replace('"', '""') + '"' for v in values)
    assert parse(packed) == (values, [])


def test_unpack_cases(spark):
    df = spark.createDataFrame([(1, "a|b", "x"), (1, "a|b", "x"), (2, None, None), (3, "", "N/A"), (4, "one", "t" * 30000 + ";u")], "record_id bigint, ipc string, item string")
    got = rows(unpack(df, "record_id", {"ipc": False, "item": False}, least=2).select("field_name", "record_id", "item_no"))
    assert got == [("ipc", 1, 1), ("ipc", 1, 1), ("ipc", 1, 2), ("ipc", 1, 2), ("item", 4, 1), ("item", 4, 2)]
    assert unpack(df.limit(0), "record_id", {"ipc": False}).count() == 0


# --- references


def test_orphans(spark):
    t = datetime(2024, 1, 2)
    edges = spark.createDataFrame([(1, "a ", False, t), (2, "B", None, t), (3, "C", True, t), (4, None, False, t), (5, "d", False, t), (6, "a", False, datetime(2020, 1, 1))], "edge_id bigint, cited_doc_id string, is_npl boolean, collected_at timestamp_ntz")
    sections = spark.createDataFrame([(7, ["d", " D", None, ""], t), (8, None, t), (9, [], t)], "section_id bigint, cited_ids array<string>, issued_at timestamp_ntz")
    recs = spark.createDataFrame([("A", True, datetime(2023, 1, 1)), ("a", True, datetime(2022, 1, 1)), ("b", False, t), (None, True, t), ("D", None, t)], "cited_doc_id string, resolved boolean, fetched_at timestamp_ntz")
    got = rows(orphans(patent_references(edges, sections), patent_parents(recs)).select("ref_table", "row_id", "key", "status"))
    assert got == [("notice_sections", 7, "D", "missing"), ("prior_art_edges", 2, "B", "missing"), ("prior_art_edges", 5, "D", "missing"), ("prior_art_edges", 6, "A", "late")]
    assert orphans(patent_references(edges.limit(0), sections.limit(0)), patent_parents(recs.limit(0))).count() == 0


def test_hot_keys_stay_where_they_are(spark):
    rows_ = spark.range(6000).select(F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4010, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    unique = spark.createDataFrame([("hot", 1), ("4500", 2), ("nobody", 3)], "k string, v int")
    assert hot_keys(rows_, "k") == ["hot"]
    for how in ("inner", "left"):
        got, want = join_unique(rows_, unique, "k", how), rows_.join(unique, "k", how)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert hot_keys(rows_.limit(0), "k") == []


# --- graph patterns


@pytest.fixture(scope="module")
def g(spark):
    t = [("p1", "a", "Patent"), ("p1", "a", "Patent"), ("p2", "a", "Patent"), ("p1", "step", "s1"), ("p2", "step", "s2"), ("s1", "label", "etch"), ("s2", "label", "clean"), ("s3", "label", "bake"), ("p1", "date", "2020"), ("s1", "next", "s2"), ("s2", "next", "s3")]
    return Graph.of_triples(spark.createDataFrame(t, "s string, p string, o string"))


def test_patterns(g):
    assert rows(g.match(("?p", "a", "Patent"), ("?p", "step", "?s"), ("?s", "label", "?l")).select("p", "l")) == [("p1", "etch"), ("p2", "clean")]
    assert rows(optional(g.match(("?p", "a", "Patent")), g.match(("?p", "date", "?d")))) == [("p1", "2020"), ("p2", None)]
    assert rows(not_exists(g.match(("?s", "label", "?l")), g.match(("?p", "step", "?s"))).select("s")) == [("s3",)]
    assert rows(union(g.match(("?s", "next", "?o")), g.match(("?s", "label", "?l"))).select("s").distinct()) == [("s1",), ("s2",), ("s3",)]
    assert rows(sequence(g, "x", ["next", "next"], "y")) == [("s1", "s3")]
    start = g.match(("?s", "label", "?l"))
    assert rows(zero_or_one(g, "next", start, "s", "e")) == [("s1", "s1"), ("s1", "s2"), ("s2", "s2"), ("s2", "s3"), ("s3", "s3")]
    assert rows(optional(g.match(("?s", "next", "?n")), g.match(("?s", "label", "?l")), F.col("l") != "etch").select("s", "l")) == [("s1", None), ("s2", "clean")]
    assert natural(g.match(("?s", "next", "?n")), g.match(("?x", "date", "?d"))).count() == 2
    assert g.match(("?s", "?q", "s2")).count() == 2


# --- boolean search


def test_boolsearch(spark):
    df = spark.createDataFrame([("alpha metal beam",), ("beta 금속막",), ("alphabet soup",), (None,), ("",)], "t string")

    def hits(q):
        return df.where(boolsearch.matches(boolsearch.parse(q), [F.col("t")])).count()

    assert hits("alpha") == 2 and hits("al !metal") == 1 and hits("속막") == 1
    assert hits("alpha beam + 금속") == 2 and hits("(alpha + beta) * 금속") == 1 and hits('"soup"') == 1
    assert hits("beta + alpha * !(metal + soup)") == 1 and hits("!!alpha soup") == 1 and hits('alpha "tal b"') == 1
    for bad in ("", "!a", "(a", "a)", "a + !b", '""', "a + ", "* a", "()", 'a "b'):
        with pytest.raises(boolsearch.QueryError):
            boolsearch.parse(bad)


def test_field_search(spark):
    docs = spark.createDataFrame([("a", "gas tool", "x", "", "plasma part"), ("b", "plasma", None, "gas", None), ("c", "none", "gas", "plasma", "gas")], "doc_id string, title string, abstract string, claims string, first string")
    find = lambda q, **kw: [r[0] for r in rows(boolsearch.search(docs, q, {"TI": "title", "AB": "abstract", "CL": "claims"}, fallback="first", **kw))]
    assert find("plasma") == ["a", "b", "c"] and find("plasma", use="CL") == ["a", "c"] and find("gas", use="TI AB") == ["a", "c"]
    assert find("gas", exclude=docs.where("doc_id = 'a'")) == ["b", "c"]
    held = spark.createDataFrame([("a", "H01L 21/30"), ("b", "H01L 21/306"), ("c", "C23C 16/44")], "doc_id string, code string")
    over = lambda *c: boolsearch.codes_within(held, spark.createDataFrame([(x,) for x in c], "code string"))
    assert find("gas", codes=over("H01L 21/30")) == ["a"] and find("gas", codes=over("H01L 21", "C23C")) == ["a", "b", "c"]


# --- ranking and metrics


def test_ranking_and_metrics(spark):
    run = ranking.ranked(spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 3.0)], "qid string, doc_id string, score double"))
    assert rows(run.select("doc_id", "rank")) == [("a", 2), ("b", 3), ("c", 1)]
    qrel = spark.createDataFrame([("q", "a"), ("q", "x"), ("r", "a")], "qid string, doc_id string")
    got = {r.qid: r for r in metrics.per_query(run, qrel, (1, 10)).collect()}
    assert got["q"].recall_10 == 0.5 and got["q"].rr == 0.5 and got["r"].recall_10 == 0.0
    fam = spark.createDataFrame([("a", "f"), ("c", "f")], "doc_id string, family_id string")
    assert rows(ranking.fold(run, fam).select("family_id", "representative", "rank")) == [("b", "b", 2), ("f", "c", 1)]
    e = {r.qid: (r.effort, r.censored) for r in metrics.effort(run, qrel, 0.5, 10).collect()}
    assert e == {"q": (2, False), "r": (11, True)}
    assert rows(metrics.bpref(run, qrel)) == [("q", 0.25), ("r", 0.0)]
    ties = {r.doc_id: (r.pos, r.group_start, r.group_size) for r in ranking.tie_groups(run.drop("rank")).collect()}
    assert ties == {"c": (1, 1, 1), "a": (2, 2, 2), "b": (3, 2, 2)}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "gas inlet 가스유입구"), (2, "gas outlet"), (3, None), (4, "가스유입구 세정")], "doc_id bigint, text string")
    post = retrieval.postings(docs, "doc_id", "text")
    assert post.where("doc_id = 3").count() == 0
    q = post.where("doc_id = 1").select(F.col("doc_id").alias("qid"), "term", "tf")
    assert [r.doc_id for r in ranking.ranked(retrieval.bm25(q, post)).orderBy("rank").collect()] == [4, 2]
    assert {r.doc_id for r in retrieval.tfidf(q, post).collect()} == {2, 4}
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id bigint, vector array<double>")
    top = retrieval.dense_top_k(e.withColumnRenamed("doc_id", "qid").where("qid = 1"), e, 1)
    assert rows(top.select("doc_id", "rank")) == [(2, 1)]


# --- closures and components


def test_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("u", "v"), ("v", "u")], "child string, parent string")
    c = closure.ancestors(e)
    assert rows(c.where("node = 'a'").select("ancestor", "steps")) == [("a", 0), ("b", 1), ("c", 2)]
    d = closure.min_depth(e, c)
    assert rows(d) == [("a", 3), ("b", 2), ("c", 1), ("x", 2)]
    assert rows(closure.cyclic_nodes(e, c)) == [("u",), ("v",)]
    w = closure.wu_palmer(spark.createDataFrame([("a", "x"), ("a", "u")], "a string, b string"), c, d)
    assert {(r.a, r.b): round(r.similarity, 3) for r in w.collect()} == {("a", "x"): 0.4, ("a", "u"): 0.0}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(spark, links):
    parent = {x: x for l in links for x in l}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(rows(components(spark.createDataFrame(links, "a int, b int"), "a", "b")))
    assert got == {x: find(x) for x in parent}


# --- statistics, constraints, faults, text


def test_statistics(spark):
    assert statistics.mcnemar(0, 0) == 1.0 and statistics.mcnemar(1, 9) == pytest.approx(0.0215, abs=1e-4)
    assert statistics.holm({"a": 0.01, "b": 0.04, "c": 0.03}) == {"a": True, "b": False, "c": False}
    b = statistics.paired_bootstrap([0.1, 0.2, -0.1, 0.3], 500)
    assert b["low"] <= b["mean"] <= b["high"] and (b["win"], b["loss"], b["tie"]) == (3, 1, 0)
    assert statistics.exclusive_quartiles([1, 2, 3, 4]) == [1.25, 2.5, 3.75]
    df = spark.createDataFrame([("1", "1"), ("2", "2"), ("1", "2"), ("2", "2"), (None, "1")], "a string, b string")
    assert statistics.cohen_kappa(df, "a", "b").first().kappa == pytest.approx(0.5)
    assert statistics.cohen_kappa(df, "a", "b", True).first().kappa == pytest.approx(0.5)
    long = spark.createDataFrame([(i, r, float(i + r)) for i in range(4) for r in range(3)], "item int, rater int, value double")
    assert statistics.icc(long).first().icc_mean == pytest.approx(5 / (5 + 3 * 0 + 4 / 4 * 1), abs=0.3)


def test_constraints(spark):
    target = spark.createDataFrame([("a",), ("b",), ("b",)], "s string")
    path = spark.createDataFrame([("a", "5"), ("a", "x")], "s string, o string")
    v = constraints.check(constraints.Shape("S", target, [constraints.Property(path, "p", 1, 1, at_most=4, datatype="int", has_value="5")]))
    assert rows(v.select("focus", "rule", "value")) == [("a", "count", "2"), ("a", "datatype", "x"), ("a", "maxInclusive", "5"), ("a", "maxInclusive", "x"), ("b", "count", "0"), ("b", "hasValue", None)]
    assert rows(constraints.target_counts([constraints.Shape("E", target.limit(0))]))[0] == ("E", 0, "vacuous")
    assert rows(constraints.family_crossing(spark.createDataFrame([("f", "train"), ("f", "dev"), ("g", "dev"), (None, "dev")], "family_id string, split string"))) == [("f", 2)]


def test_faults(spark):
    t = spark.createDataFrame([(f"s{i}", "p", f"o{i}") for i in range(200)] + [("s1", "q", "z")], "s string, p string, o string")
    left = faults.delete_edges(t, "p", 0.2, 1)
    assert 120 < left.count() < 195 and left.where("p = 'q'").count() == 1
    mixed = faults.shuffle_objects(t, "p", 1, 2)
    assert mixed.count() == t.count() and rows(mixed.select("o")) == rows(t.select("o"))
    twins = spark.createDataFrame([("a", "p", "x"), ("b", "p", "x"), ("c", "p", "y")], "s string, p string, o string")
    s = {r.node: r.signature for r in faults.signatures(twins).collect()}
    assert s["a"] == s["b"] != s["c"]
    assert rows(faults.merge_entities(twins, spark.createDataFrame([("b", "a")], "old string, new string"))) == [("a", "p", "x"), ("c", "p", "y")]


def test_text(spark):
    df = spark.createDataFrame([("2020.01.31", "h01l21/30 (2006.01)", "Ａ  b", "1. A\n2. The x of claim 1"), ("20200231", "zz", None, None)], "d string, i string, n string, c string")
    got = df.select(T.iso_date("d").alias("d"), T.int_date("d").alias("k"), T.ipc("i").alias("i"), T.nfkc_lower("n").alias("n"), T.split_claims("c").alias("c")).collect()
    assert tuple(got[0]) == ("2020-01-31", 20200131, "H01L 21/30", "a b", ["1. A", "2. The x of claim 1"])
    assert tuple(got[1])[:4] == (None, 0, None, None)
    one = spark.range(1).select(T.claim_range(F.lit("1-3, 5, 7 to 9")).alias("r"), T.claim_parents(F.lit("제3항 또는 claim 2")).alias("p"), T.char_ngrams(F.lit("ab")).alias("g"), T.org_slug(F.lit("A/S Foo Bar Co., Ltd.")).alias("o"), T.language(F.lit("")).alias("l")).first()
    assert tuple(one) == ([1, 2, 3, 5, 7, 8, 9], [3, 2], [], "foo-bar", "und")
