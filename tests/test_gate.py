"""The evidence gate, search strings and maths searches on literal cases."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.partitions import boilerplate
from marlstone.operators import retrieval as rt


def judged(spark, rows, question=("forces and motion", 5, "science")):
    """The verdict on rows of (logit, text, grade, subject, partition), and its checks."""
    asked = spark.createDataFrame([(1, *question)], "query_id long, text string, grade int, subject string")
    selected = spark.createDataFrame([(1, i, r[0], i + 1) for i, r in enumerate(rows)], "query_id long, doc_id long, logit double, final_rank int")
    texts = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, grade int, subject string, content_partition string")
    verdict = rt.gate(selected, asked, texts)
    return verdict.first(), {r["check_name"]: r["passed"] for r in rt.gate_checks(verdict).collect()}


GOOD = "Forces change the motion of a body"


@pytest.mark.parametrize(
    "rows, confidence, failed, made",
    [
        ([], "none", "candidates_exist", 1),
        ([(None, GOOD, 5, "science", None)], "unknown", "reranked", 2),
        ([(2.0, GOOD, 5, "science", "evaluation_only")], "none", "safe_partition", 3),
        ([(2.0, "All rights reserved.", 5, "science", None)], "none", "safe_partition", 3),
        ([(2.0, GOOD, 9, "science", None)], "insufficient", "scope_match", 8),
        ([(2.0, "Nothing that was asked", 5, "science", None)], "insufficient", "query_term_overlap", 8),
        ([(2.0, GOOD, 5, "science", "teacher_strategy")], "medium", None, 8),
        ([(0.5, GOOD, 5, "science", None)], "low", None, 8),
        ([(-2.0, GOOD, 5, "science", None), (-1.0, GOOD, 9, "science", None)], "low", None, 8),
        ([(4.5, GOOD, 5, "science", None), (3.0, GOOD, 5, "science", None), (1.0, GOOD, 4, "science", None)], "high", None, 8),
    ],
)
def test_verdicts(spark, rows, confidence, failed, made):
    verdict, checks = judged(spark, rows)
    assert verdict["confidence"] == confidence and len(checks) == made and verdict["sufficient"] == (failed is None)
    assert failed is None or not checks[failed]


def test_prior_grades_need_more(spark):
    rows = [(0.5, GOOD, 5, "science", None), (0.5, GOOD, 4, "science", None), (1.5, GOOD, 3, "science", None)]
    assert judged(spark, rows)[0]["n_kept"] == 2 and judged(spark, rows[1:])[0]["n_kept"] == 2


def test_maths_terms_of_an_exercise_do_not_count(spark):
    page = [(2.0, "Solving linear equations", 5, "mathematics", None)]
    assert judged(spark, page, ("3x plus 6 equals 12", 5, "mathematics"))[0]["overlap"] == 1.0
    assert judged(spark, page, ("solving 3x plus 6", 5, "mathematics"))[0]["overlap"] == 1.0
    assert judged(spark, page, ("3x plus 6 equals 12", 5, "science"))[0]["overlap"] == 0.0


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_search_strings_are_escaped(spark):
    terms = F.array(F.lit("3+4"), F.lit('a"b\\c'), F.lit("x:y/z"))
    assert one(spark, tx.lucene_query(terms), "") == '"3\\+4 a\\"b\\\\c x\\:y\\/z"^3 OR 3\\+4 OR a\\"b\\\\c OR x\\:y\\/z'
    assert one(spark, tx.lucene_query(F.array(F.lit("one"))), "") == "one" and one(spark, tx.lucene_query(F.array().cast("array<string>")), "") == ""


@pytest.mark.parametrize(
    "text, want",
    [
        ("differentiate (2x+1)^3", tx.CHAIN_RULE), ("find d/dx of x^2", tx.POWER_RULE), ("Simplify 3x plus 6 by factoring", "simplify factoring"), ("what is a prime number", "what is a prime number"),
        ("3x + 6", "3x + 6"), ("", ""), (None, ""),
    ],
)
def test_maths_search(spark, text, want):
    assert one(spark, tx.maths_query(F.col("t")), text) == want


def test_maths_search_looks_at_the_question_first(spark):
    assert one(spark, tx.maths_query(F.lit("roots of a quadratic"), F.col("t")), "differentiate x^2") == tx.POWER_RULE


@pytest.mark.parametrize("text", ["Great Minds. Eureka-Math", "see https://ncert.nic.in", "the NYS Common Core", "National Council of Educational Research", "https://greatminds.org"])
def test_publisher_notices(spark, text):
    assert one(spark, boilerplate(F.col("t")), text)
