"""Chosen paths on texts that share a shingle: no bucket stays large for it, and near copies still meet."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm.common import numbered
from marlstone.llm.op2_jaccard_join import LIMIT, classes, embedded, leaves, similar_classes


def test_a_shared_shingle_keeps_no_bucket_together(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 10**9, (1500, 6))
    texts = [(i, "this very template line stands " + " ".join(f"w{w}" for w in row)) for i, row in enumerate(words.tolist())]
    texts += [(2000 + i, f"{text} more of it all the same {'x ' * 30}tail") for i, (_, text) in enumerate(texts[:3])] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    reps = classes(embedded(numbered(docs.select("doc_id", F.col("text").alias("_text"))), "doc_id", "_text"))
    sig = np.array([np.frombuffer(r["sig"], "<u4") for r in reps.select("sig").collect()])
    assert max(np.unique(column, return_counts=True)[1].max() for column in sig.T) > 0.65 * len(sig)  # some value is shared by most
    found = leaves(reps).agg(F.max("size").alias("size"), F.count("*").alias("n")).first()
    assert found["size"] <= LIMIT and found["n"] < 100 * len(sig)
    got = {r["doc_id"]: r["n_links"] for r in similar_classes(docs).collect()}
    assert got == {i: int(i >= 2000) for i, _ in texts}


def test_splits_of_a_group_about_a_middle_are_made_once_and_few(spark, monkeypatch):
    from marlstone.llm import op2_jaccard_join as op2

    rng = np.random.default_rng(5)
    middle, rows = rng.integers(0, 2**32, op2.TOKENS, dtype=np.uint64), []
    for i in range(900):  # agreement with the middle 0.73 on average, from 0.5 to 0.96: with each other 0.53, hence not dense
        own = rng.random(op2.TOKENS) < rng.uniform(0.04, 0.5)
        rows.append((i, np.where(own, rng.integers(0, 2**32, op2.TOKENS, dtype=np.uint64), middle).astype("<u4").tobytes()))
    reps, made, kept = spark.createDataFrame(rows, "rep long, sig binary"), {}, op2.stored

    def watched(df, name):
        splits = "Generate explode(filter(" in df._jdf.queryExecution().optimizedPlan().toString()
        out = kept(df, name)
        made.setdefault(name, []).append((splits, out.count()))
        return out

    monkeypatch.setattr(op2, "stored", watched)
    found = op2.leaves(reps).groupBy("bucket").agg(F.count("*").alias("n"), F.first("size").alias("size")).collect()
    assert all(r["n"] == r["size"] for r in found) and max(r["size"] for r in found) > LIMIT
    assert not any(splits for name in ("sizes", "paths") for splits, _ in made[name])  # rows of a split are made once
    assert sum(n for _, n in made.get("splits", [])) < 10 * len(rows)
