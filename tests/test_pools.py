import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import pools, rerank, retrieval
from loomgraph.plans import analysis, ranking_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sql(module, name, d):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from read_parquet('{p}/*.parquet')")
    return sorted(con.execute(module.SQL[name]).fetchall())


def test_words_are_the_terms(spark):
    texts = ["A bc 12 d3", "반도체소자 가 나다", "化学 蒸 カーボン層の", "", "x-ray Ⅲ İi 웨이퍼A1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), retrieval.terms(F.col("t")).alias("ts"))
    assert all(sorted(pools.words(r.low)) == sorted(r.ts) for r in df.collect())


@pytest.mark.parametrize("often", [4, 1024], ids=["mostly added", "mostly one product"])
def test_pools_are_whole(spark, monkeypatch, often):
    """Pools hold the best k whatever the bounds are, and few rows more; a pool that its bound left short is made again."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.expovariate(0.05))}x" for _ in range(rng.randrange(0, 30)))) for i in range(600)], "doc_id bigint, text string").repartition(6)
    post = retrieval.postings(docs, "doc_id", "text")
    want = rows(retrieval.bm25_top_k(post.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "term"), post, 40))
    for n in ("_OFTEN", "_DOCS", "_BLOCK", "_SOME"):
        monkeypatch.setattr(pools, n, {"_OFTEN": often, "_DOCS": 32, "_BLOCK": 5, "_SOME": 300}[n])
    tok = pools.tokens(docs, {})

    def got(bounds=pools._bounds):
        monkeypatch.setattr(pools, "_bounds", bounds)
        pool, _ = pools.pools(tok, "doc_id % 50 = 0", 40, {})
        return pool.count(), rows(retrieval._ranked(pool, 40))

    real = pools._bounds
    n, best = got()
    assert best == want and n < 4 * len(want)
    assert got(lambda *a: real(*a) * 1.5)[1] == want


def test_documents_of_one_id_take_the_other_way(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert not ranking_queries._one_row(spark, str(tmp_path))


@pytest.fixture
def no_arrow(spark):
    """A plain session hands arrays to the driver as lists."""
    key = "spark.sql.execution.arrow.pyspark.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, was)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """120 documents, two of them queries; some hold no term of a query, one no term at all."""
    d, rng = str(tmp_path_factory.mktemp("odd")), random.Random(3)
    docs = [(i, f"p{i // 3}", f"alone{i}" if i % 10 == 1 else "" if i == 7 else " ".join(f"w{rng.randrange(30)}x" for _ in range(8))) for i in range(1, 121)]
    spark.createDataFrame(docs, "doc_id bigint, patent_id string, text string").write.parquet(f"{d}/documents.parquet")
    links = [(f"p{i}", c[0], c, f"{c}{i % 2}/00") for i in range(0, 40) for c in rng.sample(["H01L", "H10B", "C23C", "G03F"], 1 + i % 3)]
    spark.createDataFrame(links, "patent_id string, ipc_section string, ipc_4digit string, ipc_code string").write.parquet(f"{d}/ipc_links.parquet")
    vectors = [(i, [math.cos(a), math.sin(a)]) for i, a in ((i, rng.uniform(0, 6)) for i in range(1, 121))]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["rerank_p0", "rerank_p1", "rerank_one_axis", "rerank_path", "grid_search"])
def test_documents_without_terms_of_a_query_in_a_plain_session(spark, no_arrow, odd_tables, name):
    """without Arrow, documents that share no term with any query gave places of no integer kind."""
    assert rows(ranking_queries.QUERIES[name](spark, odd_tables)) == sql(ranking_queries, name, odd_tables)


def test_fused_runs_are_ranked_where_a_query_lies(spark, odd_tables):
    """no postings are joined, and the rows of the pools are moved once, by query, to be ranked, fused and ranked again."""
    df = analysis.search_fused(spark, odd_tables)
    moved = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 2  # one for both runs, one for the dense run by itself
    assert rows(df) == sql(analysis, "search_fused", odd_tables)


@pytest.mark.parametrize("listed", [500_000, 0], ids=["lists sent", "lists joined"])
def test_every_document_is_a_query_of_run_b5(spark, odd_tables, monkeypatch, listed):
    """F8: not every fiftieth one alone."""
    monkeypatch.setattr(rerank, "_LISTED", listed)
    got = rows(ranking_queries.run_b5(spark, odd_tables).select("qid", "doc_id", "score", "rank"))
    assert {x[0] for x in got} == set(range(1, 120))  # document 120 alone has a patent without codes
    assert got == sql(ranking_queries, "run_b5", odd_tables)
