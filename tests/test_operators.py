"""Invariants of the operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.partitions import partition
from marlstone.functions.scope import Scope, lineage, offered
from marlstone.operators import retrieval as rt


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("Photo Synthesis!", "photo_synthesis"), ("Éléments  de", "elements_de"), ("--a--", "a"), ("Straße", "strae")])
def test_slug(spark, raw, want):
    assert one(spark, tx.slug(F.col("t")), t=raw) == want


def test_sentences_and_tokens(spark):
    text = 'One is here. "Two is it. 3 follows! not this? Yes'  # a quote may open a sentence; small letters do not
    assert one(spark, tx.sentences(F.col("t")), t=text) == ["One is here.", '"Two is it.', "3 follows! not this?", "Yes"]
    assert one(spark, tx.token_count(F.col("t")), t="") == 1
    assert one(spark, tx.token_count(F.col("t")), t="a b") == 3


def test_query_terms_fall_back_to_stop_words(spark):
    assert one(spark, tx.query_terms(F.col("t")), t="what is the x") == ["what", "is", "the"]


def test_redaction(spark):
    assert one(spark, tx.redact_secrets(F.col("t")), t="api_key=abc password") == "[redacted]=[redacted] [redacted]"


@pytest.mark.parametrize(
    "title, text, before, want",
    [
        ("Answer Key", "x", None, "evaluation_only"),
        ("Exercises", "x", None, "practice_only"),
        ("Concept Development", "x", None, "teacher_strategy"),
        ("Forces", "Expected response: 4", None, "evaluation_only"),
        ("Forces", "text", "The answer key", "evaluation_only"),
        ("Forces", "All rights reserved.", None, "excluded_boilerplate"),
        ("Forces", "text", None, "student_evidence"),
    ],
)
def test_partition_rules(spark, title, text, before, want):
    df = spark.createDataFrame([(title, text, before)], "t string, b string, p string")
    assert df.select(partition(F.col("t"), F.col("b"), F.col("p")).alias("x")).first()["x"] == want


def test_scope():
    assert offered(2) == ("mathematics",) and "science" in offered(10) and "physics" in offered(11)
    assert lineage("physics") == ("physics", "science") and lineage("") == ()
    for bad in (Scope(), Scope(grade=2, subject="science"), Scope(grade=13, subject="mathematics")):
        with pytest.raises(ValueError):
            bad.validate()


def test_fusion_prefers_agreement(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 20, 2), (1, 30, 1)], "query_id int, doc_id int, rank int")
    rows = rt.rrf({"a": (a, 1.0), "b": (b, 1.0)}, "doc_id").orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [20, 10, 30] and rows[0]["rrf_score"] == round(2 / 62, 8)


def test_selection_tiers(spark):
    rows = spark.createDataFrame(
        [(1, 1, -1.0, "primary", 3), (1, 2, 2.0, "support", 1), (1, 3, 1.0, "primary", 2)], "query_id int, doc_id int, logit double, source_role string, rerank int"
    )
    got = rt.select_final(rows).orderBy("final_rank").collect()
    assert [(r["doc_id"], r["reason"]) for r in got] == [(3, "primary_adequate"), (2, "support_fills_gap"), (1, "below_score_floor_fill")]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, doc_id int, rank int")
    labels = spark.createDataFrame([(1, 8, 1), (2, 9, 1)], "query_id int, doc_id int, gain int")
    r = rt.ir_metrics(found, labels).first()
    assert (r["n_queries"], r["recall"], r["mrr"]) == (2, 0.5, 0.25)


def test_more_queries_than_a_block(spark, sf_dir, monkeypatch):
    from marlstone.plans.queries import QUERIES

    names = ("dense_topk_exact", "dense_topk_filtered", "retrieval_metrics")
    whole = {n: sorted(QUERIES[n](spark, sf_dir).collect()) for n in names}
    monkeypatch.setattr(rt, "QUERY_ROWS", 2)
    assert {n: sorted(QUERIES[n](spark, sf_dir).collect()) for n in names} == whole and all(whole.values())
