"""A tutor's explanations and judgements: literal cases of what is shown and what is refused."""

import json

import pytest

from marlstone.functions import tutor as tu

EXAMPLE = {"problem": "differentiate x^3 + 2x", "steps": ["Take each term", " Apply the rule "], "answer": "3x^2 + 2"}
GOOD = {"explanation": " A slope at a point. ", "formula_or_rule": "power rule", "worked_example": EXAMPLE}


def explain(spark, raw, question="differentiate x^5", maths=True):
    raw = raw if raw is None or isinstance(raw, str) else json.dumps(raw)
    rows = spark.createDataFrame([(raw, question, maths)], "raw string, question string, maths boolean")
    return tu.explained(rows, "raw", "question", "maths").first()["explanation"]


def test_an_explanation_is_laid_out(spark):
    whole = "A slope at a point.\n\nFormula or rule\n\npower rule\n\nWorked example\n\ndifferentiate x^3 + 2x\n\n1. Take each term\n\n2. Apply the rule\n\nAnswer: 3x^2 + 2"
    assert explain(spark, GOOD) == whole
    assert explain(spark, f"```json\n{json.dumps(GOOD)}\n```") == whole
    assert explain(spark, {"explanation": "Plants need light.", "formula_or_rule": " ", "worked_example": None}, maths=False) == "Plants need light."
    assert explain(spark, {"explanation": "Plants need light."}, None, None) == "Plants need light."


@pytest.mark.parametrize(
    "change",
    [
        {"explanation": "  "}, {"explanation": 3}, {"formula_or_rule": 3}, {"formula_or_rule": ["x"]}, {"worked_example": None}, {"worked_example": "x"}, {"worked_example": EXAMPLE | {"steps": []}},
        {"worked_example": EXAMPLE | {"steps": ["a", " "]}}, {"worked_example": EXAMPLE | {"steps": ["a", 2]}}, {"worked_example": EXAMPLE | {"steps": "a"}}, {"worked_example": EXAMPLE | {"answer": ""}},
        {"worked_example": EXAMPLE | {"problem": "Differentiate  x ** 5"}}, {"worked_example": EXAMPLE | {"problem": "please differentiate x^5 now"}}, {"explanation": "see [E1]"},
        {"explanation": "the correct answer is 4"}, {"explanation": "word " * 451},
    ],
)
def test_explanations_refused(spark, change):
    assert explain(spark, GOOD | change) is None


def test_no_object_no_explanation(spark):
    assert explain(spark, None) is None and explain(spark, "sorry") is None and explain(spark, "[1]") is None
    assert explain(spark, {"explanation": "x", "worked_example": "y"}, maths=False) is None


def confirm(spark, raw, locked=None, expected=None):
    raw = raw if raw is None or isinstance(raw, str) else json.dumps(raw)
    rows = spark.createDataFrame([(raw, locked, expected)], "raw string, locked boolean, expected string")
    return tu.confirmed(rows, "raw", "locked", "expected").first()["confirmation"]


RIGHT = {"verdict": " Correct ", "brief_reason": "You used the rule.", "mistake_groups": []}
WRONG = {"verdict": "incorrect", "brief_reason": "A sign went astray.", "mistake_groups": [{"mistake": "Lost  sign", "hint": "Look at the second term."}, {"mistake": " lost sign", "hint": "Again."}, {"mistake": "Power", "hint": "Lower it."}]}


def test_judgements_are_laid_out(spark):
    assert confirm(spark, RIGHT) == confirm(spark, RIGHT, True) == "Correct. You used the rule."
    assert confirm(spark, WRONG, False, "2x+1") == "Not quite.\n\n- Lost  sign\n  Hint: Look at the second term.\n- Power\n  Hint: Lower it."


@pytest.mark.parametrize(
    "raw, locked, expected",
    [
        (RIGHT, False, None), (WRONG, True, None), (RIGHT | {"verdict": "maybe"}, None, None), (RIGHT | {"verdict": 1}, None, None), (RIGHT | {"brief_reason": " "}, None, None), (RIGHT | {"mistake_groups": None}, None, None),
        (RIGHT | {"mistake_groups": WRONG["mistake_groups"]}, None, None), (RIGHT | {"brief_reason": "That is wrong."}, None, None), (WRONG | {"mistake_groups": []}, None, None), (WRONG | {"brief_reason": "It is correct."}, None, None),
        (WRONG | {"mistake_groups": [{"mistake": "a"}]}, None, None), (WRONG | {"mistake_groups": ["a"]}, None, None), (WRONG | {"brief_reason": "Incorrect: look."}, None, None), (RIGHT | {"brief_reason": "See the retrieved material."}, None, None),
        (WRONG | {"brief_reason": "The answer is 4."}, None, None), (WRONG | {"brief_reason": "Think of 2 * X + 1."}, None, "2x+1"), (RIGHT | {"brief_reason": "word " * 300}, None, None), (None, None, None), ("no", True, "x"),
    ],
)
def test_judgements_refused(spark, raw, locked, expected):
    assert confirm(spark, raw, locked, expected) is None
