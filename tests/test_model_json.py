"""Objects in model output: the shapes that occur, and the second try."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import model_json as mj


def rewritten(spark, raw, original="why do things fall"):
    return mj.rewrite(spark.createDataFrame([(raw, original)], "raw string, original string")).first().asDict()


GOOD = {"retrieval_query": "  gravity \n and  mass", "intent": "Explain", "input_kind": "diagram", "transcribed_question": " what  falls "}


@pytest.mark.parametrize("raw", [json.dumps(GOOD), f"```json\n{json.dumps(GOOD)}\n```", f"Sure: {json.dumps(GOOD)} That is it."])
def test_objects_are_found(spark, raw):
    assert rewritten(spark, raw) == {
        "retrieval_query": "gravity and mass", "intent": "explain", "input_kind": "diagram", "transcribed_question": "what falls", "fallback": False, "reason": None,
    }


@pytest.mark.parametrize(
    "raw, original, query, reason",
    [
        ("no object", "q", "q", mj.NOT_JSON), (None, "q", "q", mj.NOT_JSON), ("{not json}", "q", "q", mj.NOT_PARSED), ('{"retrieval_query": ""}', " q ", "q", mj.NO_QUERY), ('{"retrieval_query": 7}', "q", "q", mj.NO_QUERY),
        ('{"transcribed_question": "seen"}', "", "seen", mj.NO_QUERY), ('{"transcribed_question": ["x"], "intent": 3}', None, "", mj.NO_QUERY),
    ],
)
def test_fallbacks(spark, raw, original, query, reason):
    got = rewritten(spark, raw, original)
    assert (got["retrieval_query"], got["fallback"], got["reason"], got["intent"]) == (query, True, reason, "other")


@pytest.mark.parametrize("raw, want", [('{"a": "x", "b": "cut of', "x"), ('```json\n{"a": "x",', "x"), ('{"a": "x"', "x"), ('{"a": "x", "c": [1, 2', "x"), ("nothing", None)])
def test_cut_objects_are_closed(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(mj.text_field(mj.json_object(F.col("raw"), repair=True), "a").alias("a"), mj.text_field(mj.json_object(F.col("raw")), "a").alias("b")).first()
    assert row["a"] == want and row["b"] is None


def test_only_failed_rows_are_asked_again(spark):
    asked = []

    def complete(rows):
        asked.append(rows.count())
        mended = F.col("prompt").contains("JSON only")
        return rows.withColumn("raw", F.when((F.col("id") == 1) | (mended & (F.col("id") == 2)), F.concat(F.lit('{"a": "'), F.col("id"), F.lit('"}'))).otherwise("sorry"))

    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "id int, prompt string")
    got = mj.retry_once(rows, complete, lambda raw: mj.text_field(mj.json_object(raw), "a"), "JSON only", F.lit("none"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "1", 1), (2, "2", 2), (3, "none", 3)] and asked == [3, 2]
