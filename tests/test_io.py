import importlib.util

from pyspark.sql.types import IntegerType, StructType

from loomgraph.session import materialize, shared_dir
from loomgraph.sources import formats
from loomgraph.streaming import windows


def test_ntriples_round_trip(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<s> <p> "x \\"y\\""@en .\n<s> <p> <o> .\n<s> <p> <o> .\n# no triple\n', encoding="utf-8")
    t = formats.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert sorted((r.o, r.o_kind, r.lang) for r in t.collect()) == [("o", "iri", None), ('x "y"', "literal", "en")]
    formats.write_ntriples(t, str(tmp_path / "out"))
    assert formats.read_ntriples(spark, str(tmp_path / "out")).exceptAll(t).count() == 0


def test_runs_jsonl_ledger_manifest(spark, tmp_path):
    run = spark.createDataFrame([("q", "d", 1, 0.5)], "qid string, doc_id string, rank bigint, score double")
    formats.write_run(run, str(tmp_path / "run"), "t")
    assert tuple(formats.read_run(spark, str(tmp_path / "run")).first()) == ("q", "d", 1, 0.5, "t")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    good, bad = formats.read_jsonl(spark, str(tmp_path / "x.jsonl"), StructType().add("a", IntegerType()))
    assert [r.a for r in good.collect()] == [1] and [r.value for r in bad.collect()] == ["{broken"]
    formats.append_ledger(run, str(tmp_path / "ledger"))
    formats.append_ledger(run, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2
    assert formats.manifest(spark, str(tmp_path / "run")).count() >= 1


def test_turtle_blocks(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("d:a a x ;\n  p y .\n\ne:b a z .\n")
    assert [r.block for r in formats.turtle_blocks(spark, str(tmp_path / "a.ttl"), "d:").collect()] == ["d:a a x ;\n  p y ."]


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    assert df.count() == 3 and shared_dir(spark).split("://")[-1] in df.inputFiles()[0]


def test_stream_reads_to_its_end(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS ts, 'a' AS k UNION ALL SELECT timestamp_ntz'2024-01-02 01:00:00', 'a'").write.parquet(str(tmp_path / "in"))
    s = windows.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    windows.run_batches_complete(windows.windowed_counts(s, "ts", "k"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o" / "out")).count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert {"p5_found", "p7_found", "cq01", "cq33", "cqr02"} <= set(names) and set(e.oracle_sql()) <= set(names)
    if importlib.util.find_spec("loomgraph.llm") is not None:
        assert {"p1_found", "p10_found"} <= set(names)
    assert e.entry(spark).count() > 0
