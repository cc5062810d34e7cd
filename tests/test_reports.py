"""Claims, sources, faults, gates, samples and report shapes against cases and brute force."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import claims as C
from loomgraph.operators import closure, faults, gates, sampling, shaping, statistics
from loomgraph.sources import formats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_claim_elements(spark):
    assert C.elements("1. A tool comprising: a gas inlet; a valve; and a plate") == ("A tool comprising", ["a gas inlet", "a valve", "a plate"], None)
    assert C.elements("2. 장치에 있어서,\n 노즐; 및\n 밸브")[1] == ["노즐", "밸브"]
    assert C.elements("A kit including (a) one part (b) two parts")[1] == ["one part", "two parts"]
    assert C.elements("plain words")[2] == "single_element" and C.elements("a; " + "x" * 700)[2] == "oversized_element" and C.elements("") == ("", [], "single_element")
    df = spark.createDataFrame([(1, 1, "1. A comprising: b; c", "x"), (2, 1, None, "x"), (3, 1, "", "x")], "id bigint, claim_no int, claim string, element string")
    assert rows(C.claim_elements(df).select("id", "seq", "element")) == [(1, 1, "b"), (1, 2, "c")]


def test_root_claims(spark):
    df = spark.createDataFrame([("a", 1, []), ("a", 2, [1]), ("a", 3, [1, 2]), ("a", 4, None), ("a", 5, [4, 2]), ("a", 6, [7]), ("a", 7, [6]), ("a", 8, [99]), ("b", 2, [1])], "id string, claim_no int, parents array<int>")
    got = {}
    for i, c, r in rows(C.root_claims(df)):
        got.setdefault((i, c), set()).add(r)
    assert got == {("a", 1): {1}, ("a", 2): {1}, ("a", 3): {1}, ("a", 4): {4}, ("a", 5): {1, 4}}


def test_text_functions(spark):
    one = lambda c, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "c string").select(c).collect()]
    c = F.col("c")
    assert one(C.readable_symbol(c), "H01L0021306000", "H01L0021020000", "H01L0021000000", "x", None) == ["H01L21/306", "H01L21/02", "H01L21/00", None, None]
    assert one(C.unfenced(c), "```json\n{}\n```", " plain ") == ["{}", "plain"]
    assert one(C.url_key(c), "https://WWW.a.b/c/", "a.b/c") == ["a.b/c", "a.b/c"]
    assert one(C.publication_keys(c), "KR 10-2020-1234567 A1")[0] == ["KR1020201234567A1", "KR1020201234567", "KR20201234567"]
    assert one(C.typed(c, "integer"), "5", "x", None) == [5, None, None] and one(C.typed(c, "boolean"), "false", "") == [True, False]
    assert one(C.grounded(F.lit("a  b"), c), "x a b y", "ab", None) == [True, False, False]
    a = spark.createDataFrame([(["x", "y"], ["x"], ["x"], "q", "a q"), ([], ["x"], ["x"], "", "a")], "cited array<string>, allowed array<string>, right array<string>, quote string, source string")
    assert tuple(C.score_answers(a).first()) == (2, 1, 0.5, 0.5, 0.5)


def test_turtle_csv_json_xml(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix e: <http://e/> .\n\ne:s a e:T ;\n  e:p "x \\"q\\""@en , 5 ;\n  e:q [ e:r true ] .\n\n# note\ne:t e:p <http://z/1> .\n')
    t, missing = formats.read_present(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "none.ttl")])
    assert missing == [str(tmp_path / "none.ttl")] and t.count() == 6
    assert ("http://e/s", "http://e/p", 'x "q"', "literal", None, "en") in rows(t)
    formats.write_turtle(t, str(tmp_path / "out"))
    back = formats.read_turtle(spark, str(tmp_path / "out"))
    assert {r[:3] for r in rows(back) if not r[0].startswith("_:") and r[3] != "blank"} == {r[:3] for r in rows(t) if not r[0].startswith("_:") and r[3] != "blank"}
    (tmp_path / "v.csv").write_text('id,name\n1,"a\nb, ""c"""\n2,\n')
    assert rows(formats.read_csv(spark, str(tmp_path / "v.csv"), "id int, name string")) == [(1, 'a\nb, "c"'), (2, None)]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "props": {"x": 1}, "provenance": {"by": "me"}}], "edges": [{"src": "a", "dst": "b", "context_modifiers": {"m": "n"}}], "synonyms": [{"node_id": "a", "term": "A", "lang": "en"}]}')
    n, e, s = formats.read_graph_json(spark, str(tmp_path / "g.json"))
    assert set(n.columns) == {"id", "props_x", "prov_by"} and set(e.columns) == {"src", "dst", "ctx_m"} and s.count() == 1
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.xml", '<all><concordance from="H01L"><to>H10D</to></concordance><other/></all>')
    assert [(r.source_file, r.fields) for r in formats.read_concordance(spark, str(tmp_path / "c.zip")).collect()] == [("c.zip!x.xml", {"from": "H01L", "to": "H10D"})]


def test_faults(spark):
    t = spark.createDataFrame([(f"n{i}", "p", f"o{i % 3}") for i in range(12)] + [(f"n{i}", "a", "T") for i in range(12)], "s string, p string, o string")
    assert faults.leak(t, "p", "q", 1.0).count() == 36 and faults.dangle(t, "p", 1.0).where("o like 'gone/%'").count() == 12
    assert faults.retype(t, "T", "U", 1.0).where("o = 'U'").count() == 12 and faults.repeat_nodes(t, "p", 1.0).count() == 48
    assert faults.merge_synonyms(t, "p", 1.0).where("p = 'p'").count() == 3
    assert rows(faults.shuffle_objects(t, "p").groupBy("o").count()) == rows(t.groupBy("o").count())
    runs = spark.createDataFrame([("g", "f1", True, True), ("g", "f2", True, False), ("g", "n", False, False), ("h", "f1", True, True), ("h", "n", False, True)], "gate string, run string, is_fault boolean, flagged boolean")
    assert rows(faults.detection(runs)) == [("g", 2, 1, 0, 1, False), ("h", 1, 1, 1, 1, True)]


def test_fault_matrix_sees_faults_and_no_normal_change(spark):
    import __spark_entry__ as e

    got = {r.gate: r for r in e.queries()["fault_matrix"](spark, "/root/testdata/sf0.001").collect()}
    assert all(r.false_alarms == 0 and r.normal == 2 for r in got.values()) and got["row_counts"].detected >= 3 and got["dangling"].detected >= 2


def test_gates(spark, tmp_path):
    v = lambda *xs: spark.createDataFrame([(x,) for x in xs], "verdict string")
    assert tuple(gates.accept(v("pass", "waived")).first()) == (True, 0) and tuple(gates.accept(v("pass", "fail")).first()) == (False, 1) and gates.accept(v("pass").limit(0)).first()[0] is False
    old, new = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.5)], "suite string, rate double"), spark.createDataFrame([("a", 0.9), ("b", 0.5)], "suite string, rate double")
    assert [r.verdict for r in gates.suite_verdict(old, new, ("c",)).orderBy("suite").collect()] == ["fail", "pass", "waived"]
    groups = spark.createDataFrame([(0.01, True), (0.9, False)], "drop double, reliable boolean")
    assert gates.subgroup_verdict(groups).first().verdict == "pass" and gates.subgroup_verdict(groups.where("not reliable")).first().verdict == "undetermined"
    p = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)]
    assert {r.name: r.rejected for r in gates.holm_frame(spark.createDataFrame(p, "name string, p double")).collect()} == statistics.holm(dict(p))
    assert gates.forbidden_columns(["title", "a.qrel_rank", "Label"]) == ["a.qrel_rank", "Label"]
    m = lambda *xs: spark.createDataFrame(xs, "path string, sha256 string")
    assert rows(gates.classify_files(m(("a", "1"), ("b", "2"), ("c", "3")), m(("a", "1"), ("b", "9"), ("d", "4")))) == [("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added")]
    sealed = gates.Sealed(old, "test_b", str(tmp_path / "ledger"))
    for allow, why in ((False, "x"), (True, " ")):
        with pytest.raises(PermissionError):
            sealed.open(allow, why)
    assert sealed.open(True, "final run").count() == 3 and spark.read.json(str(tmp_path / "ledger")).count() == 1
    assert gates.leakage_report({"k": old, "m": None}).where("status = 'UNMEASURABLE'").count() == 1


def test_mcnemar_equals_its_definition():
    for b, c in ((0, 0), (3, 9), (12, 12), (20, 40)):
        n = b + c
        want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n < 25 else math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))
        assert statistics.mcnemar(b, c) == pytest.approx(want)
    same = statistics.paired_bootstrap([0.1] * 20)
    assert same["low"] == same["high"] == pytest.approx(0.1) and same["win"] == 20 and statistics.ratio_bootstrap([1, 2], [0, 4])["dropped"] == 1


def test_samples(spark):
    df = spark.createDataFrame([(i, "hot" if i < 900 else f"s{i % 7}", i) for i in range(1000)], "id bigint, stratum string, other bigint")
    a = rows(sampling.quota(df, ["stratum"], "id", 5).select("id"))
    assert a == rows(sampling.quota(df.repartition(7), ["stratum"], "id", 5).select("id")) and len(a) == 40
    docs = spark.createDataFrame([(f"d{i}", "A" if i % 2 else "B", "S" if i % 2 else "T", f"f{i % 10}") for i in range(40)], "id string, cls string, section string, family string")
    cited = spark.createDataFrame([("d1", "d3"), ("d1", "d5")], "qid string, doc_id string")
    for hard in (True, False):
        got = sampling.negatives(docs, docs, cited, 3, hard).collect()
        of = {r.id: r for r in docs.collect()}
        assert all((of[r.qid].cls == of[r.doc_id].cls) == hard and of[r.qid].family != of[r.doc_id].family for r in got)
        assert not {("d1", "d3"), ("d1", "d5")} & {(r.qid, r.doc_id) for r in got} and len([r for r in got if r.qid == "d1"]) == 3


def test_shaping(spark):
    g = spark.createDataFrame([(i, i // 4, 1 + i % 3) for i in range(30)], "group bigint, at bigint, n bigint")
    got = {r.group: r.split for r in shaping.cumulative_split(g).collect()}
    total, run = sum(1 + i % 3 for i in range(30)), 0
    for i in range(30):
        run += 1 + i % 3
        assert got[i] == ("train" if run <= total * 0.6 else "dev" if run <= total * 0.8 else "test")
    assert rows(shaping.checksum(shaping.cumulative_split(g))) == rows(shaping.checksum(shaping.cumulative_split(g.repartition(5))))
    a = spark.createDataFrame([("k", " ", "x"), ("m", "t", None)], "k string, a string, b string")
    b = spark.createDataFrame([("k", "second", "y"), ("n", None, "z")], "k string, a string, b string")
    assert rows(shaping.precedence_merge([a, b], "k", ["a", "b"])) == [("k", "second", "x"), ("m", "t", None), ("n", None, "z")]
    o = spark.createDataFrame([("a", ["1"]), ("b", ["1"]), ("c", ["1"]), ("d", ["1"])], "k string, v array<string>")
    n = spark.createDataFrame([("a", ["1"]), ("b", ["1", "2"]), ("c", ["2"]), ("e", ["1"])], "k string, v array<string>")
    assert {r.k: r.status for r in shaping.additive_delta(o, n, "k", "v").collect()} == {"a": "unchanged", "b": "extended", "c": "changed", "d": "lost", "e": "new"}


def test_entailment(spark):
    frame = lambda *xs: spark.createDataFrame(list(xs), "a string, b string")
    t = spark.createDataFrame([("x", "sub", "y"), ("z", "a", "C")], "s string, p string, o string")
    full = set(rows(closure.entail(t, frame(("C", "B"), ("B", "A")), frame(("sub", "top")), frame(("top", "C")), frame(("sub", "D")))))
    assert full == {("x", "sub", "y"), ("x", "top", "y"), ("x", "a", "C"), ("x", "a", "B"), ("x", "a", "A"), ("y", "a", "D"), ("z", "a", "C"), ("z", "a", "B"), ("z", "a", "A")}
    assert rows(closure.disjoint_members(spark.createDataFrame([("x", "C"), ("x", "D"), ("y", "C")], "s string, o string"), frame(("D", "B")), frame(("C", "B")))) == [("x", "B", "D")]


def test_random_conjunctions(spark):
    rnd = random.Random(3)
    held = {i: {rnd.choice("abcde") for _ in range(3)} for i in range(40)}
    want = {q: {rnd.choice("abcde") for _ in range(2)} for q in range(8)}
    p = spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "id bigint, key string")
    w = spark.createDataFrame([(q, k) for q, ks in want.items() for k in ks], "qid bigint, key string")
    assert rows(shaping.conjunctive(p, w)) == sorted(((q, i) for q, ks in want.items() for i, hs in held.items() if ks <= hs), key=repr)
