"""Dense search: exact, indexed and filtered, on odd and uneven vectors."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import vectors as vs
from marlstone.plans.queries import PROBED

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    unit = lambda v: np.float64(np.float32(v)) / np.linalg.norm(np.float64(np.float32(v)))
    out = []
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(e)), 6), key) for key, e in rows)
        out += [(q, key, -s, r + 1) for r, (s, key) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["vec_id"], round(r["score"], 6) + 0.0, r["rank"]) for r in df.collect())



def test_exact_with_small_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vs, "PART", 30)
    monkeypatch.setattr(vs, "BLOCK", 3)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=12).tolist()) for i in range(100)] + [(200 + i, [1.0] * 12) for i in range(60)]
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [None] + [1.0] * 11), (905, [float("inf")] * 12)]
    table = spark.createDataFrame([(*x, 0) for x in rows + odd], SCHEMA).repartition(4)
    asks = [(i, rows[i][1]) for i in (0, 1, 2, 3, 4, 5, 6, 120)]
    queries = spark.createDataFrame([*asks, (77, None), (78, [0.0] * 12)], "query_id long, query array<float>")
    assert found(vs.exact(table, queries, 9)) == brute(rows, asks, 9)
    index = vs.build(table, lists=7)
    assert found(vs.search(index, queries, 9)) == brute(rows, asks, 9)
    assert index.postings().count() == len(rows)


def recall(table, share):
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vs.build(table)
    pairs = lambda df: {tuple(r) for r in df.select("query_id", "vec_id").collect()}
    want = pairs(vs.exact(table, queries))
    return len(want & pairs(vs.search(index, queries, n_probes=max(1, round(share * len(index.centroids)))))) / len(want)


def test_recall_of_the_registered_share_of_lists(spark, sf_dir):
    assert recall(spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet"), PROBED) >= 0.9


def test_recall_on_grouped_vectors(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 16)) * 4
    table = spark.createDataFrame([(i, (centres[i % 40] + r.normal(size=16)).tolist(), 0) for i in range(2000)], SCHEMA)
    assert recall(table, 0.1) >= 0.9


def test_filter_falls_back_to_an_exact_search(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist(), i % 50 if i < 400 else 1) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in (0, 9)], "query_id long, query array<float>")
    index = vs.build(table, lists=5)
    for label, strategy in ((1, "index"), (2, "exact")):
        got = vs.filtered(index, table, queries, F.col("label") == label, k=5).drop("strategy")
        kept = [(key, v) for key, v, at in rows if at == label]
        assert found(got) == brute(kept, [(i, rows[i][1]) for i in (0, 9)], 5)
        assert {x["strategy"] for x in vs.filtered(index, table, queries, F.col("label") == label, k=5).collect()} == {strategy}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    one = spark.createDataFrame([(5, [2.0, 0.0], 1)], SCHEMA)
    assert vs.exact(none, queries).count() == 0 and vs.search(vs.build(none), queries).count() == 0
    assert vs.exact(one, queries.where("false")).count() == 0
    assert found(vs.exact(one, queries)) == [(1, 5, 1.0, 1)]
