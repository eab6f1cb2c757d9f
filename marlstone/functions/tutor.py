"""A tutor's explanations and judgements of answers: read from model output, checked, and laid out as text; null where a rule is broken.

All of it is built-in expressions on variants, so it stays in generated code. Each function takes rows and gives them with one more column, as every step is a column of its own
and an output is parsed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import answers as an
from marlstone.functions import model_json as mj

#: A verdict ahead of a field, a reason that speaks against its verdict, and what the layout of a verdict may not say.
VERDICT_AHEAD = r"(?i)^\s*(?:correct|not quite|incorrect)\b[.:!]?"
AGAINST_CORRECT = r"(?i)\bnot quite\b|\bincorrect\b|\bwrong\b"
AGAINST_INCORRECT = r"(?i)\b(?:is|are)\s+correct\b"
#: Fixed value: an example of so many characters that the question holds, or the other way round, is the question's own.
SAME_PROBLEM = 12


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def kind(variant: Column) -> Column:
    """STRING, OBJECT, ARRAY or another kind of a variant; null for none and for a JSON null."""
    name = F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)
    return F.when(name != "VOID", name)


def part(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, f"$.{path}", "variant")


def words_in(variant: Column) -> Column:
    """A string that is not blank, without the white space around it; null for anything else."""
    text = F.when(kind(variant) == "STRING", stripped(F.try_variant_get(variant, "$", "string")))
    return F.when(text != "", text)


def items(variant: Column) -> Column:
    return F.when(kind(variant) == "ARRAY", F.try_variant_get(variant, "$", "array<variant>"))


def bare_problem(text: Column) -> Column:
    """A problem's text as it is compared: lower case, no white space, one sign for powers."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("**"), F.lit("^")), r"\s+", "")


def same_problem(example: Column, question: Column) -> Column:
    a, b = bare_problem(example), bare_problem(question)
    held = ((F.length(a) >= SAME_PROBLEM) & F.contains(b, a)) | ((F.length(b) >= SAME_PROBLEM) & F.contains(a, b))
    return (a != "") & (b != "") & ((a == b) | held)


def _clean(texts: Column, *patterns: str) -> Column:
    """No text of an array matches a pattern."""
    return ~F.exists(texts, lambda t: reduce(lambda x, y: x | y, [F.regexp_like(t, F.lit(p)) for p in patterns]))


def explained(rows: DataFrame, raw: str, question: str, maths: str, out: str = "explanation") -> DataFrame:
    """An explanation, with a rule and a worked example if there are any. Mathematics must have an example, and its problem must not be the question's.

    The example needs a problem, an answer and one step or more, none blank. Nulls: no output means no explanation, no question is like no problem, ``maths`` null is false.
    """
    own = rows.columns
    read = rows.withColumn("_v", mj.json_object(F.col(raw)))
    read = read.withColumns({"_text": words_in(part(F.col("_v"), "explanation")), "_f": part(F.col("_v"), "formula_or_rule"), "_e": part(F.col("_v"), "worked_example")})
    read = read.withColumns({
        "_rule": words_in(F.col("_f")), "_rule_ok": F.coalesce(kind(F.col("_f")) == "STRING", F.lit(True)), "_has": F.coalesce(kind(F.col("_e")) == "OBJECT", F.lit(False)), "_none": kind(F.col("_e")).isNull(),
        "_problem": words_in(part(F.col("_e"), "problem")), "_answer": words_in(part(F.col("_e"), "answer")), "_steps": F.transform(items(part(F.col("_e"), "steps")), words_in),
    })
    whole = F.col("_problem").isNotNull() & F.col("_answer").isNotNull() & F.coalesce(F.size("_steps") > 0, F.lit(False)) & ~F.coalesce(F.exists("_steps", lambda s: s.isNull()), F.lit(False))
    good = whole & ~same_problem(F.col("_problem"), F.col(question))
    numbered = F.transform("_steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    shown = F.concat(F.array(F.lit("Worked example"), F.col("_problem")), numbered, F.array(F.concat(F.lit("Answer: "), F.col("_answer"))))
    no = F.array().cast("array<string>")
    parts = F.concat(F.array("_text"), F.when(F.col("_rule").isNotNull(), F.array(F.lit("Formula or rule"), F.col("_rule"))).otherwise(no), F.when(F.col("_has"), shown).otherwise(no))
    able = F.when(F.col("_has"), good).otherwise(F.col("_none") & ~F.coalesce(F.col(maths), F.lit(False)))
    read = read.withColumn("_parts", F.when(F.col("_text").isNotNull() & F.col("_rule_ok") & able, parts)).withColumn("_whole", F.array_join("_parts", "\n\n"))
    ok = _clean(F.array("_whole"), an.LEAK, an.REVEALS) & an.within_limit(F.col("_whole"), "explain_concept")
    return read.select(*own, F.when(ok, F.col("_whole")).alias(out))


def _fingerprint(text: Column) -> Column:
    return F.replace(bare_problem(text), F.lit("*"), F.lit(""))


def confirmed(rows: DataFrame, raw: str, locked: str, expected: str, out: str = "confirmation") -> DataFrame:
    """What a judgement of an answer tells the student: that it is correct and why, or each mistake once with a hint.

    The verdict must be the ``locked`` one (true: correct, false: incorrect, null: either), must not be contradicted by its reason, and an answer that is not correct must not
    be given away: neither in words nor as the ``expected`` expression (null: none). A repeated mistake keeps its first hint.
    """
    own = rows.columns
    read = rows.withColumn("_v", mj.json_object(F.col(raw)))
    read = read.withColumns({"_verdict": F.lower(words_in(part(F.col("_v"), "verdict"))), "_reason": words_in(part(F.col("_v"), "brief_reason")), "_items": items(part(F.col("_v"), "mistake_groups"))})
    group = lambda v: F.struct(words_in(part(v, "mistake")).alias("mistake"), words_in(part(v, "hint")).alias("hint"))
    read = read.withColumn("_groups", F.transform("_items", group))
    read = read.withColumn("_keys", F.transform("_groups", lambda g: F.regexp_replace(F.lower(g["mistake"]), r"\s+", " ")))
    first = F.filter("_groups", lambda g, i: F.array_position(F.col("_keys"), F.get(F.col("_keys"), i)) == i + 1)
    whole = F.forall("_groups", lambda g: g["mistake"].isNotNull() & g["hint"].isNotNull())
    read = read.withColumns({"_whole": whole, "_kept": first})
    fields = F.concat(F.array("_reason"), F.transform("_kept", lambda g: g["mistake"]), F.transform("_kept", lambda g: g["hint"]))
    read = read.withColumn("_fields", F.when(F.col("_whole"), fields))
    right = F.col("_verdict") == "correct"
    needle = _fingerprint(F.col(expected))
    told = F.when(F.length(needle) >= 2, F.exists("_fields", lambda t: F.contains(_fingerprint(t), needle))).otherwise(False)
    able = F.when(right, (F.size("_kept") == 0) & ~F.regexp_like("_reason", F.lit(AGAINST_CORRECT)))
    able = able.otherwise((F.size("_kept") > 0) & ~F.regexp_like("_reason", F.lit(AGAINST_INCORRECT)) & _clean(F.col("_fields"), an.REVEALS) & ~told)
    held = F.coalesce(F.col(locked) == right, F.lit(True))
    hints = F.transform("_kept", lambda g: F.concat(F.lit("- "), g["mistake"], F.lit("\n  Hint: "), g["hint"]))
    text = F.when(right, F.concat(F.lit("Correct. "), F.col("_reason"))).otherwise(F.concat(F.lit("Not quite.\n\n"), F.array_join(hints, "\n")))
    ok = F.col("_verdict").isin("correct", "incorrect") & held & able & _clean(F.col("_fields"), VERDICT_AHEAD, an.LEAK) & an.within_limit(text, "confirm_answer")
    return read.select(*own, F.when(F.col("_whole") & ok, text).alias(out))
