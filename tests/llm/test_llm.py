"""Training-data operators against brute force, round trips and the awkward cases."""

import random
import unicodedata
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import lookalike, mixing, neardup, overlap, packing, residue, segment, survivor, tokens


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- p1

REC = "record_id bigint, cited_doc_id string, source string, resolved boolean, fetched_at timestamp_ntz, title string, claims string, n_claims int, ipc string, trust_rank int, group_key string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def trust(spark):
    return spark.createDataFrame([("kipris", 1), ("epo", 2)], "source string, trust_rank int")


def test_survivors(spark, trust):
    data = [
        (1, "a", "epo", True, T2, "old", None, None, "X", 9, "z"),
        (2, "A ", "kipris", True, T1, "N/A", "c2", 2, "Y", 9, "z"),
        (3, "a", "kipris", False, T2, "bad", "c3", 3, None, 9, "z"),
        (4, "a", None, True, T2, "", "", None, "Z", 9, "z"),
        (5, "b", "epo", None, None, "alone", None, None, None, 9, "z"),
        (6, None, "epo", True, T1, "nokey", None, None, None, 9, "z"),
        (7, "c", "epo", True, T1, "same", None, None, None, 9, "z"),
        (8, "C", "epo", True, T1, "same", "", None, None, 9, "z"),
    ]
    df = spark.createDataFrame(data, REC)
    got = rows(survivor.survivors(df, trust, {f: [f] for f in ("title", "claims", "ipc")}))
    assert got == [("A", "claims", 2), ("A", "ipc", 2), ("A", "title", 1), ("C", "title", 7)]
    assert survivor.survivors(df.limit(0), trust.limit(0), {"title": ["title"]}).count() == 0


def test_bundles_keep_dependencies(spark, trust):
    """Against brute force: the cheapest pair of records whose values stand together."""
    rnd = random.Random(5)
    data = [(i, f"k{i % 12}", rnd.choice(["kipris", "epo", None]), rnd.random() < 0.7, T1, rnd.choice(["t1", "t2", None]), rnd.choice(["c1", "c2", "c3", None]), i, None, 1, "") for i in range(90)]
    df = spark.createDataFrame(data, REC)
    chosen = {(k, b): r for k, b, r in rows(survivor.survivors(df, trust, {"x": ["title"], "y": ["claims"]}, [("title", "claims")]))}
    order = lambda r: (0 if r[3] else 1, {"kipris": 1, "epo": 2}.get(r[2], survivor.NO_RANK), -r[4].timestamp(), r[0])
    cost = lambda r: (0 if r[3] else 100) + min(order(r)[1], 10)
    by = {}
    for r in data:
        by.setdefault(r[1].upper(), []).append(r)
    for k, rs in by.items():
        seen = {(r[5], r[6]) for r in rs if r[5] and r[6]}
        ok = [(cost(a) + cost(b), order(a), order(b)) for a in rs if a[5] for b in rs if b[6] and (a[5], b[6]) in seen]
        if ok:
            ids = {r[0]: r for r in rs}
            a, b = ids[chosen[k, "x"]], ids[chosen[k, "y"]]
            assert (a[5], b[6]) in seen and cost(a) + cost(b) == min(ok)[0]


def test_bundles_that_share_a_bundle(spark, trust):
    """Two dependencies over one bundle are settled together."""
    data = [(1, "k", "kipris", True, T1, "t1", "c1", 1, None, 0, ""), (2, "k", "epo", True, T1, None, "c2", 2, "z1", 0, ""), (3, "k", None, True, T1, "t3", "c2", 3, None, 0, "")]
    df = spark.createDataFrame(data, REC)
    chosen = {b: r for _, b, r in rows(survivor.survivors(df, trust, {"x": ["title"], "y": ["claims"], "z": ["ipc"]}, [("title", "claims"), ("claims", "ipc")]))}
    assert chosen["z"] == 2 and (chosen["x"], chosen["y"]) in {(1, 1), (3, 2)}


@pytest.mark.parametrize("functional", [False, True])
def test_joint_search_equals_brute_force(spark, trust, functional):
    rnd = random.Random(9)
    data = [(i, f"k{i % 25}", rnd.choice(["kipris", "epo", None]), rnd.random() < 0.7, rnd.choice([T1, T2]), rnd.choice(["t1", "t2", "t3", None]), rnd.choice(["c1", "c2", "c3", None, "N/A"]), rnd.choice([1, 2, None]), rnd.choice(["z1", "z2", None]), 1, "") for i in range(130)]
    df = spark.createDataFrame(data, REC)
    deps = [("title", "claims"), ("claims", "ipc"), ("n_claims", "ipc")]
    got = {}
    for k, b, r in rows(survivor.survivors(df, trust, {"x": ["title"], "y": ["claims", "n_claims"], "z": ["ipc"]}, deps, functional=functional)):
        got[k, b] = r
    rank = {"kipris": 1, "epo": 2, None: survivor.NO_RANK}
    order = lambda r: (0 if r[3] else 1, rank[r[2]], -r[4].timestamp(), r[0])
    cost = lambda r: survivor.LEFT_OUT if r is None else (0 if r[3] else 100) + min(rank[r[2]], 10)
    at = {"title": 5, "claims": 6, "n_claims": 7, "ipc": 8}
    val = lambda r, f: None if r is None or r[at[f]] == "N/A" else r[at[f]]
    by = {}
    for r in data:
        by.setdefault(r[1].upper(), []).append(r)
    for k, rs in by.items():
        seen = {}
        for x, y in deps:
            pairs = [(order(r), val(r, x), val(r, y)) for r in rs if val(r, x) is not None and val(r, y) is not None]
            if functional:
                pairs = [min(p for p in pairs if p[1] == v) for v in {p[1] for p in pairs}]
            seen[x, y] = {(a, b) for _, a, b in pairs}
        options = [[None, *(r for r in rs if val(r, f) is not None)] for f in ("title", "claims", "ipc")]

        def fits(t, c, z):
            rec = {"title": t, "claims": c, "n_claims": c, "ipc": z}
            for (x, y), s in seen.items():
                a, b = val(rec[x], x), val(rec[y], y)
                if a is not None and b is not None and (a, b) not in s:
                    return False
            return True

        best = min(cost(t) + cost(c) + cost(z) for t in options[0] for c in options[1] for z in options[2] if fits(t, c, z))
        ids = {r[0]: r for r in rs}
        pick = [ids.get(got.get((k, b))) for b in "xyz"]
        assert fits(*pick) and sum(map(cost, pick)) == best


def test_merged_takes_whole_bundles(spark):
    recs = spark.createDataFrame([(1, "t1", None, "i1"), (2, "t2", "c2", None), (3, None, "c3", "i3")], "record_id bigint, title string, claims string, ipc string")
    chosen = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "y", 3)], "group_key string, bundle string, record_id bigint")
    assert rows(survivor.merged(recs, chosen, {"x": ["title", "ipc"], "y": ["claims"]})) == [("A", 1, 2, "t1", "i1", "c2"), ("B", None, 3, None, None, "c3")]


# --- p2


def test_lookalikes(spark):
    forms = ["KR 10-2020", "ＫＲ 10‐2020", "KR 10-20​20", "КR 10-2020", "kr 10-2020", "KR 10-2021", "한국", unicodedata.normalize("NFD", "한국"), "é", unicodedata.normalize("NFD", "é"), "e", "a²", "a2", "", None, "x" * 20000, "x" * 19999 + "ｘ"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate([*forms, forms[0]])], "id bigint, t string, field_name string")
    got = {(a, b) for _, a, b in rows(lookalike.pairs(df, "id", "t"))}
    same = [{0, 1, 2, 3, 17}, {6, 7}, {8, 9}, {15, 16}]
    want = {(a, b) for s in same for a in s for b in s if a < b and (a, b) != (0, 17)}
    assert got == want
    one = {r.id: r.canonical for r in lookalike.unify(df, "id", "t").collect()}
    assert one[1] == one[2] == one[3] == "KR 10-2020" and one[14] is None and one[13] == "" and len(one) == 18
    assert lookalike.pairs(df.limit(0), "id", "t").count() == 0
    both = spark.createDataFrame([(1, "ﬁlm Ⅳ", "ㄱ나"), (2, "film IV", "ᄀ나"), (3, "film VI", "film IV"), (4, None, "ﬁlm Ⅳ")], "id bigint, t string, u string")
    assert rows(lookalike.pairs(both, "id", ["t", "u"])) == [("t", 1, 2), ("u", 1, 2), ("u", 3, 4)]


# --- p3, p4


def brute(texts, line=0.85):
    c = [Counter(t.split()) for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i) if texts[i] != texts[j] and sum((c[i] & c[j]).values()) >= line * max(sum(c[i].values()), sum(c[j].values())) > 0}


def _near_copies(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(20, 120))]
        out.append(" ".join(base))
        for _ in range(2):
            x = list(base)
            for _ in range(max(1, len(x) // 25)):
                x[rnd.randrange(len(x))] = f"e{rnd.randrange(9999)}"
            if rnd.random() < 0.5:
                x = x[len(x) // 2 :] + x[: len(x) // 2]
            out.append(" ".join(x))
    return out


def test_near_records_equals_brute_force(spark):
    texts = _near_copies(40, 3)
    data = [(i, f"d{i}", t, None, "x") for i, t in enumerate(texts)]
    data += [(900, "d0", texts[0], None, "x"), (901, "other", texts[0], "", "x"), (902, None, None, "N/A", "x"), (903, "s", "one", "one", "x"), (904, "t", "one", None, "x")]
    df = spark.createDataFrame(data, "rid bigint, k string, abstract string, claims string, text_id string")
    got = {(a, b) for a, b, *_ in rows(neardup.near_records(df, "rid", "k", ["abstract", "claims"]).select("id_a", "id_b").distinct())}
    want = {(j, i) for i, j in brute(texts)}
    near0 = {max(p) if min(p) == 0 else min(p) for p in want if 0 in p}
    want |= {(x, r) for x in near0 for r in (900, 901)} | {(0, 901), (900, 901), (903, 904)}
    assert got == want
    assert neardup.near_records(df.limit(0), "rid", "k", ["abstract"]).count() == 0
    classes_of_pairs(neardup.near_classes(df, "rid", "k", ["abstract", "claims"]), neardup.near_records(df, "rid", "k", ["abstract", "claims"]), [r[0] for r in data])
    assert neardup.near_classes(df.limit(0), "rid", "k", ["abstract"]).count() == 0


def classes_of_pairs(classes, pairs, ids):
    """Classes are the components of the pairs, and links their number."""
    least, links = {i: i for i in ids}, Counter()

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b, *_ in rows(pairs.select("id_a", "id_b", "field_name")):
        links[a] += 1
        links[b] += 1
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    size = Counter(root(i) for i in ids)
    assert rows(classes.select("id", "class_id", "class_size", "n_links")) == sorted(((i, root(i), size[root(i)], links[i]) for i in ids), key=repr)


def test_classes_with_keys_and_shared_texts(spark):
    """Texts under one key are no pair, but another key's copy joins them all; fields do not mix."""
    rnd = random.Random(4)
    texts = _near_copies(6, 11)
    data = [(i, f"k{rnd.randrange(5)}", rnd.choice(texts), rnd.choice([None, "N/A", *texts])) for i in range(80)]
    df = spark.createDataFrame(data, "rid bigint, k string, abstract string, claims string")
    classes_of_pairs(neardup.near_classes(df, "rid", "k", ["abstract", "claims"]), neardup.near_records(df, "rid", "k", ["abstract", "claims"]), range(80))


def test_design_grows_with_the_collection():
    a, b = neardup.design(1000), neardup.design(10**8)
    assert a.width == 20 and b.width > a.width and b.segments >= a.segments and a.reach < a.width * a.segments // 2


def test_cross_split(spark):
    base = _near_copies(12, 8)
    docs = [(f"d{i}", t, "X " + t, "s", "junk") for i, t in enumerate(base)] + [("up", base[0].upper() + " !", None, "s", "junk"), ("d0", base[0], None, "s", "junk"), ("none", None, "", "s", "junk")]
    df = spark.createDataFrame(docs, "doc_id string, claims_full string, first_independent string, source string, split string")
    where = [(f"d{i}", "TRAIN " if i % 3 == 0 else "dev" if i % 3 == 1 else "holdout") for i in range(36)] + [("d0", "train"), ("up", "Test_B"), ("missing", "dev"), (None, "dev"), ("none", None)]
    sp = spark.createDataFrame(where, "doc_id string, split string")
    found = overlap.cross_split(df, sp, ["claims_full", "first_independent"])
    got = {(a, b) for a, b, *_ in rows(found.select("train_id", "eval_id").distinct())}
    want = {tuple(sorted((i, j), key=lambda x: x % 3)) for i, j in brute(base) if {i % 3, j % 3} == {0, 1}}
    assert got == {(f"d{a}", f"d{b}") for a, b in want} | {("d0", "up")}
    assert {r.how for r in found.where("eval_id = 'up'").collect()} == {"same"}
    assert overlap.leak_report(found, df, sp).count() > 0
    key = lambda r: (r.split, r.source, r.field_name, r.how)
    counted = {key(r): (r.n_pairs, r.n_eval_docs, r.n_train_docs) for r in overlap.leak_counts(df, sp, ["claims_full", "first_independent"]).collect()}
    assert counted == {key(r): (r.n_pairs, r.n_eval_docs, r.n_train_docs) for r in overlap.leak_report(found, df, sp).collect()}
    both = spark.createDataFrame([("a", base[0], None, None), ("b", base[0], None, "s")], "doc_id string, claims_full string, first_independent string, source string")
    twice = spark.createDataFrame([("a", "train"), ("a", "dev"), ("b", "dev")], "doc_id string, split string")
    assert rows(overlap.leak_counts(both, twice, ["claims_full"])) == [("dev", "s", "claims_full", "same", 1, 1, 1)]
    assert overlap.cross_split(df.limit(0), sp.limit(0), ["claims_full"]).count() == 0


# --- p6


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .\n1가。", min_size=0, max_size=900), st.sampled_from([(60, 10), (101, 50), (300, 0)]))
def test_cut_round_trip(text, how):
    limit, over = how
    got = segment.cut(text, limit, over)
    assert all(e - s <= limit for s, e, _ in got)
    out = "".join(text[s if i == 0 else s + over : e] for i, (s, e, _) in enumerate(got))
    assert out == text
    assert all(got[i + 1][0] == got[i][1] - over for i in range(len(got) - 1))


def test_cut_prefers_natural_ends():
    text = "\n".join(f"{i}. " + f"claim{i} word. " * 40 for i in range(1, 20))
    assert {k for *_, k in segment.cut(text, 3000, 200)} == {"claim", "last"}
    assert {k for *_, k in segment.cut("word " * 2000, 3000, 200)} == {"word", "last"}
    assert {k for *_, k in segment.cut("x" * 9000, 3000, 200)} == {"none", "last"}


def test_depths_equal_a_walk_to_the_peaks_and_are_linear():
    import time

    import numpy as np

    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 60):
        sim = rnd.integers(0, 5, n) / 4
        want = []
        for i in range(n):
            l = r = i
            while l > 0 and sim[l - 1] >= sim[l]:
                l -= 1
            while r < n - 1 and sim[r + 1] >= sim[r]:
                r += 1
            want.append(sim[l] + sim[r] - 2 * sim[i])
        assert segment._depths(sim) == pytest.approx(want)
    began = time.time()
    got = segment.cut("a. " * 40_000)
    assert time.time() - began < 20 and max(e - s for s, e, _ in got) <= 3000


def test_cut_at_the_deepest_valley():
    """A change of subject at a sentence end is cut at, not a claim end within one subject."""
    one, two = "gas inlet valve flow " * 6, "mask resist expose align " * 6
    text = "".join(f"{one}.\n{i}. " for i in range(1, 14)) + one + ". " + (two + ". ") * 12
    place = text.index("mask")
    assert place in {e for _, e, _ in segment.cut(text, 3000, 100)}


def test_pieces_cases(spark):
    df = spark.createDataFrame([("t", "1", "a b " * 1000), ("t", "1", "a b " * 1000), ("t", "2", None), ("t", "3", ""), ("t", "4", "short"), ("t", "5", "y" * 50000)], "tbl string, item_id string, text string")
    got = segment.pieces(df)
    assert {r.item_id for r in got.collect()} == {"1", "5"} and got.where("item_id = '1'").count() == 2
    assert segment.pieces(df.limit(0)).count() == 0


# --- p8, p9


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=30), st.sampled_from([(100,), (25, 50, 100), (128,)]))
def test_plan_holds_everything(histogram, capacities):
    made = packing.plan(histogram, capacities)
    used = Counter()
    for _, times, length, pattern in made:
        assert sum(s * k for s, k in pattern) <= length <= max(capacities)
        for s, k in pattern:
            used[s] += times * k
    assert dict(used) == histogram and len(made) <= 4 * len(histogram) + 4


def test_containers(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["gas", "inlet", "가스유입구", "装置"]) for _ in range(rnd.randrange(1, 60))), 1) for i in range(300)]
    docs += [(1000, "gas " * 900, 1), (1001, None, 1), (1002, "", 1), (1003, "가" * 2000, 1), (5, docs[5][1], 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, length int")
    c = packing.containers(df, capacities=(256,), lengths=(64, 128, 256)).collect()
    assert all(r.fill <= 256 and r.room == 256 - r.fill and r.length >= r.fill and r.fill == sum(x.n_tokens for x in r["items"]) for r in c)
    texts = {}
    for x in sorted((x for r in c for x in r["items"]), key=lambda x: (x.doc_id, x.piece_no)):
        texts[x.doc_id] = texts.get(x.doc_id, "") + x.text
    assert texts == {i: t for i, t, _ in docs if t}
    split = {x.doc_id for r in c for x in r["items"] if x.piece_no > 1}
    assert split == {1000, 1003} and sum(r.room for r in c) < 0.05 * 256 * len(c)
    assert packing.containers(df.limit(0)).count() == 0


def test_token_runs():
    enc = tokens.encoder(tokens.DEFAULT)
    text = "가나다 gas 装置 " * 50
    got = tokens.split_sizes(text, 37, tokens.DEFAULT)
    assert "".join(text[a:b] for a, b, _ in got) == text and sum(n for *_, n in got) == len(enc.encode_ordinary(text)) and max(n for *_, n in got) <= 37


def test_water_fill():
    have, w, r = {"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 2, "c": 5}
    exact = mixing.water_fill(have, w, r)
    assert exact["b"] == pytest.approx(20) and exact["a"] == pytest.approx(25) and exact["c"] == 0
    clamped = mixing.water_fill(have, w, r, 120)
    assert clamped["b"] == 20 and clamped["a"] == pytest.approx(100)
    assert mixing.water_fill(have, w, r, 1e9) == {"a": 200, "b": 20, "c": 0}
    assert mixing.water_fill({}, w, r) == {"a": 0, "b": 0, "c": 0}


def test_mixture(spark):
    docs = [(i, f"text number {i} of some source", "big" if i < 800 else "small", 1.0) for i in range(900)] + [(901, None, "big", 1.0), (902, "x y", None, 1.0), (903, docs_text := "text number 1 of some source", "big", 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, target_share double")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.1, 1), (None, 0.5, 9)], "source string, target_share double, max_repeats int")
    sample, report = mixing.mixture(df, t)
    s = sample.collect()
    assert all(x.n_times <= (1 if x.source == "big" else 3) for x in s) and len({x.doc_id for x in s}) == len(s) and 903 not in {x.doc_id for x in s}
    r = {x.source: x for x in report.collect()}
    assert r["big"].share_reached == pytest.approx(0.6, abs=0.01) and r["gone"].tokens_drawn == 0
    assert rows(mixing.mixture(df, t)[0]) == rows(sample)
    full, said = mixing.mixture(df, t, "all")
    x = {r.source: r for r in said.collect()}
    assert x["small"].clamped and x["small"].tokens_drawn == 3 * x["small"].tokens_there and not x["gone"].clamped
    everything = sum(r.tokens_there for r in x.values())
    assert x["big"].clamped == (x["big"].tokens_there <= everything - x["small"].tokens_drawn)
    assert sum(r.tokens_drawn for r in x.values()) == pytest.approx(everything, rel=0.01) or x["big"].clamped
    assert sum(r.n_tokens * r.n_times for r in full.collect()) == sum(r.tokens_drawn for r in x.values())
    twice = spark.createDataFrame([(1, f"words of text {i}", "big", 1.0) for i in range(9)], "doc_id bigint, text string, source string, target_share double")
    assert len({tuple(rows(mixing.mixture(twice.repartition(n), t, "all")[0])) for n in (1, 2, 3)}) == 1 and mixing.mixture(twice, t, "all")[0].count() == 1
    assert mixing.mixture(df.limit(0), t)[0].count() == 0 and mixing.mixture(df, t.limit(0))[0].count() == 0


# --- p10


def test_residue(spark):
    prose = "The gas inlet 12 is aligned with the chamber wall and the valve plate moves by 3 mm relative to it."
    bad = ["Title: {{ title }}", prose + " [TODO: agent]", "명칭: {agent}\nTitle: {title}\nX: {examiner}", "Lorem ipsum dolor sit amet", "Text to follow. Text to follow.", "xxxx xx ooo zz xxxx .. zzz", "404 Not Found", "Menu\nThe page was not found on this server. Please try again.", '{"status":"error","code":500}', "asdf qwer asdf qwer asdf qwer asdf qwer", "Filed: ______", prose + " " + "mirel tavre oscum venit lorem forsit quorat elin vanta pena sorem labor dolor ultra magna sit"]
    good = [prose, "The {100} plane and the set {A, B, C}, see [0012].", "The not found flag is set to zero after alignment.", "", None, prose * 300, "가스 유입구 12는 챔버벽과 정렬된다.", "페이지를 찾을 수 없는 경우 메모리 장치는 다음 블록을 조회한다."]
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(bad + good)] + [(0, bad[0], "r")], "doc_id bigint, text string, reason string")
    got = {r.doc_id for r in residue.residue(df).collect()}
    assert got == set(range(len(bad)))
    assert residue.residue(df.limit(0)).count() == 0


def _near_lines(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    lines = [(f"t{i}-{j}", " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(9)}" for w in words), 1 + j % 2) for i, words in enumerate(base) for j in range(6)]
    return spark.createDataFrame(lines, "text_id string, text string, side int")


@pytest.mark.parametrize("between", [False, True], ids=["F1 p3", "F2 p4"])
def test_near_texts_hold_few_stages(spark, monkeypatch, between):
    """segments a few at a time give the same pairs; words are sent once a place and stages go when they are read."""
    t = _near_lines(spark)
    want = {tuple(r) for r in neardup.near_texts(t, 0.85, between).collect()}
    assert want
    kept, real, gone = {}, neardup.materialize, neardup.release
    monkeypatch.setattr(neardup, "_CELLS", 1)
    monkeypatch.setattr(neardup, "materialize", lambda df, name="stage": kept.setdefault(name, []).append(out := real(df, name)) or out)
    dropped = []
    monkeypatch.setattr(neardup, "release", lambda *s: dropped.extend(s) or gone(*s))
    assert {tuple(r) for r in neardup.near_texts(t, 0.85, between).collect()} == want
    assert len(kept["met"]) > 2
    left = [n for n, dfs in kept.items() for df in dfs if not any(df is x for x in dropped)]
    assert sorted(left) == ["looked", "names"]


def test_texts_are_sketched_in_parts(spark, monkeypatch):
    """of many texts a part lies in a stage at a time, sketches hold segments once, and the join of equal canonical texts moves hashes only."""
    t = _near_lines(spark)
    want = {tuple(r) for r in neardup.near_texts(t).collect()}
    kept, real = {}, neardup.materialize
    monkeypatch.setattr(neardup, "_TEXTS", 20)
    monkeypatch.setattr(neardup, "materialize", lambda df, name="stage": (out := real(df, name), kept.setdefault(name, []).append((out.count(), out.columns)))[0])
    assert {tuple(r) for r in neardup.near_texts(t).collect()} == want
    assert sum(n for n, _ in kept["texts"]) == t.count() and max(n for n, _ in kept["texts"]) < t.count() / 2
    assert kept["sketches"][0][1] == ["nid", "side", "segs", "check", "words"]
    lines = t.select(F.col("text_id").alias("doc_id"), F.col("text").alias("claims_full"))
    found = overlap.cross_split(lines, t.select(F.col("text_id").alias("doc_id"), F.when(F.col("side") == 1, "train").otherwise("dev").alias("split")), ["claims_full"])
    assert found.count() and "p{L}" not in found._jdf.queryExecution().optimizedPlan().toString()
