"""Rules for a tutor's answers and how evidence is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most words of an answer by state.
WORD_LIMITS = {"give_hint": 90, "explain_concept": 450, "confirm_answer": 300, "insufficient_evidence": 130}

#: Phrases that show internals, give the answer away, list steps, or answer while declining.
LEAK = (
    r"(?i)(?:\[E\d+\]|\bE[123]\b|CURRICULUM EVIDENCE|according to the (?:curriculum|evidence)|the retrieved material|\bchunk[_ ]id\b|"
    r"\bGIVE_HINT\b|\bEXPLAIN_CONCEPT\b|\bCONFIRM_ANSWER\b|\bINSUFFICIENT_EVIDENCE\b|JSON REPAIR|LOCKED SYMBOLIC)"
)
REVEALS = (
    r"(?i)\b(?:the\s+(?:correct\s+)?(?:final\s+)?answer\s+is|corrected\s+(?:final\s+)?answer|complete(?:d)?\s+replacement\s+solution|"
    r"the\s+correct\s+derivative\s+is)\b"
)
STEPS = r"(?is)\bstep\s*1\b.+\bstep\s*2\b"
DECLINE_ANSWERS = r"(?i)(?:\bthe\s+(?:correct\s+)?answer\s+is\b|\btherefore\s+(?:the\s+)?(?:result|derivative|value)\b|\bequals\s+[-+]?\d)"

EVIDENCE_CHARS, PREVIEW_CHARS = 1000, 160


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def within_limit(text: Column, state: str) -> Column:
    return word_count(text) <= WORD_LIMITS[state]


def hint_ok(hint: Column, question: Column) -> Column:
    """A hint that asks nothing, then one question that ends in the only question mark; no steps, leaks or answers."""
    whole = F.concat_ws("\n\n", hint, question)
    no = lambda p: ~F.regexp_like(hint, F.lit(p)) & ~F.regexp_like(question, F.lit(p))
    ok = (
        (hint != "") & ~F.contains(hint, F.lit("?")) & question.endswith("?") & (F.regexp_count(question, F.lit(r"\?")) == 1)
        & no(STEPS) & no(LEAK) & no(REVEALS) & within_limit(whole, "give_hint")
    )
    return F.coalesce(ok, F.lit(False))


def long_words(text: Column) -> Column:
    """Distinct runs of four or more Latin letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(long_words(left), long_words(right)))


def decline_ok(nearby: Column, evidence: Column) -> Column:
    """What a refusal points to must share a word with the evidence and not answer."""
    return (overlap(nearby, evidence) > 0) & ~F.regexp_like(F.coalesce(nearby, F.lit("")), F.lit(DECLINE_ANSWERS))


def state_of(sufficient: Column, asked: Column) -> Column:
    """Insufficient evidence wins, then what was asked for, then a hint."""
    return F.when(~sufficient, "insufficient_evidence").otherwise(F.coalesce(asked, F.lit("give_hint")))


def page_range(start: Column, end: Column) -> Column:
    one = F.when(end.isNull() | (start == end), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.when(start.isNull(), "?").otherwise(one)


def preview(text: Column, width: int = PREVIEW_CHARS) -> Column:
    flat = collapsed(text)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.left(flat, F.lit(width - 3)), F.lit("...")))


def evidence_text(text: Column, most: int = EVIDENCE_CHARS) -> Column:
    """The text on one line, cut before the word that passes ``most`` characters."""
    flat = collapsed(text)
    cut = F.regexp_replace(F.left(flat, F.lit(most)), " [^ ]*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit(" ...")))
