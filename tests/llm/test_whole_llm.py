"""Training-data operators where a search that is only likely to find everything loses cases."""

import random

from loomgraph.llm import neardup


def test_pairs_just_at_the_line_are_all_found(spark):
    rnd = random.Random(5)
    data, want = [], set()
    for i in range(1500):
        base = [f"w{i}_{k}" for k in range(20)]
        other = base[:17] + [f"x{i}_{k}" for k in range(3)]
        rnd.shuffle(other)
        data += [(f"{i}a", " ".join(base), 1), (f"{i}b", " ".join(other), 2)]
        want.add((f"{i}a", f"{i}b"))
    df = spark.createDataFrame(data, "text_id string, text string, side int")
    for between in (False, True):
        assert {(r.text_a, r.text_b) for r in neardup.near_texts(df, between=between).collect()} == want
