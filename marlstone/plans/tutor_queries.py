r"""Queries on a tutor's output: objects made of the turns of every conversation, bare, fenced or inside other text, then read back, checked and laid out.

A turn is the text ``t``, the next ``n``, the one before ``b``. The SQL tells the result from the turns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import answers as an
from marlstone.functions import tutor as tu
from marlstone.plans import queries as q
from marlstone.plans.queries import query

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BARE = r"regexp_replace(replace(lower({}), '**', '^'), '\s+', '', 'g')"
_FEW = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')) <= {}"
_NO = lambda text, *patterns: " AND ".join(f"NOT regexp_matches({text}, '{q._q(p)}')" for p in patterns)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), value)


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def _said(found: Column) -> Column:
    """The object as a model may give it."""
    way = F.col("conv_id") % 4
    return F.when(way == 1, F.concat(F.lit("```json\n"), found, F.lit("\n```"))).when(way == 2, F.concat(F.lit("Sure: "), found, F.lit(" That is it."))).otherwise(found)


@query(
    rf"""WITH {q._PAIRS}, s AS (SELECT conv_id, turn, n AS question, {_STRIP.format("t")} AS text, {_STRIP.format("b")} AS step, CASE WHEN turn % 2 = 0 THEN {_STRIP.format("n")} ELSE '' END AS rule, conv_id % 3 <> 0 AS has,
      {_STRIP.format("CASE WHEN conv_id % 3 = 1 THEN 'Find the start of ' || b[1:40] ELSE n END")} AS problem, {_STRIP.format("t[1:20]")} AS answer FROM p),
    d AS (SELECT *, {_BARE.format("problem")} AS x, {_BARE.format("question")} AS y, concat_ws(chr(10) || chr(10), text, CASE WHEN rule <> '' THEN 'Formula or rule' END, CASE WHEN rule <> '' THEN rule END,
      CASE WHEN has THEN concat_ws(chr(10) || chr(10), 'Worked example', problem, '1. ' || step, '2. ' || text, 'Answer: ' || answer) END) AS whole FROM s)
    SELECT conv_id, turn, CASE WHEN text <> '' AND turn % 5 <> 4 AND (has OR conv_id % 2 <> 0) AND (NOT has OR (problem <> '' AND answer <> '' AND step <> ''
      AND NOT (x <> '' AND y <> '' AND (x = y OR (length(x) >= 12 AND contains(y, x)) OR (length(y) >= 12 AND contains(x, y))))))
      AND {_NO("whole", an.LEAK, an.REVEALS)} AND {_FEW.format("whole", an.WORD_LIMITS["explain_concept"])} THEN whole END AS explanation FROM d"""
)
def tutor_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n, b, third = F.col("t"), F.col("n"), F.col("b"), F.col("conv_id") % 3
    rule = F.when(F.col("turn") % 5 == 4, F.lit("7")).when(F.col("turn") % 2 == 0, _quoted(n)).otherwise(F.lit("null"))
    problem = F.when(third == 1, F.concat(F.lit("Find the start of "), F.left(b, F.lit(40)))).otherwise(n)
    steps = F.concat(F.lit("["), _quoted(b), F.lit(", "), _quoted(t), F.lit("]"))
    example = _object(_field("problem", _quoted(problem)), _field("steps", steps), _field("answer", _quoted(F.left(t, F.lit(20)))))
    raw = _said(_object(_field("explanation", _quoted(t)), _field("formula_or_rule", rule), F.when(third != 0, _field("worked_example", example))))
    rows = q._pairs(spark, sf_dir).withColumns({"raw": raw, "maths": F.col("conv_id") % 2 == 0})
    return tu.explained(rows, "raw", "n", "maths").select("conv_id", "turn", "explanation")


@query(
    rf"""WITH {q._PAIRS}, s AS (SELECT conv_id, turn, conv_id % 2 = 0 AS well, CASE turn % 4 WHEN 1 THEN true WHEN 2 THEN false END AS held, {_STRIP.format("t")} AS reason, {_STRIP.format("b")} AS mistake, {_STRIP.format("n")} AS hint,
      CASE WHEN turn % 5 = 0 THEN replace({_BARE.format("t[5:9]")}, '*', '') ELSE '' END AS needle FROM p),
    d AS (SELECT *, CASE WHEN well THEN [reason] ELSE [reason, mistake, hint] END AS fields,
      CASE WHEN well THEN 'Correct. ' || reason ELSE 'Not quite.' || chr(10) || chr(10) || '- ' || mistake || chr(10) || '  Hint: ' || hint END AS whole FROM s)
    SELECT conv_id, turn, CASE WHEN reason <> '' AND coalesce(held = well, true) AND len(list_filter(fields, lambda f: regexp_matches(f, '{q._q(tu.VERDICT_AHEAD)}') OR regexp_matches(f, '{q._q(an.LEAK)}'))) = 0
      AND CASE WHEN well THEN turn % 7 <> 6 AND {_NO("reason", tu.AGAINST_CORRECT)} ELSE mistake <> '' AND hint <> '' AND {_NO("reason", tu.AGAINST_INCORRECT)}
        AND len(list_filter(fields, lambda f: regexp_matches(f, '{q._q(an.REVEALS)}') OR (length(needle) >= 2 AND contains(replace({_BARE.format("f")}, '*', ''), needle)))) = 0 END
      AND {_FEW.format("whole", an.WORD_LIMITS["confirm_answer"])} THEN whole END AS confirmation FROM d"""
)
def tutor_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n, b, well = F.col("t"), F.col("n"), F.col("b"), F.col("conv_id") % 2 == 0
    group = lambda mistake, hint: _object(_field("mistake", _quoted(mistake)), _field("hint", _quoted(hint)))
    twice = F.concat(F.lit("["), group(b, n), F.lit(", "), group(F.replace(b, F.lit(" "), F.lit("  ")), t), F.lit("]"))
    groups = F.when(~well, twice).when(F.col("turn") % 7 == 6, F.concat(F.lit("["), group(b, n), F.lit("]"))).otherwise(F.lit("[]"))
    verdict = F.when(well, F.lit('"correct"')).otherwise(F.lit('" Incorrect"'))
    raw = _said(_object(_field("verdict", verdict), _field("brief_reason", _quoted(t)), _field("mistake_groups", groups)))
    quarter = F.col("turn") % 4
    rows = q._pairs(spark, sf_dir).withColumns({
        "raw": raw, "locked": F.when(quarter == 1, True).when(quarter == 2, False), "expected": F.when(F.col("turn") % 5 == 0, F.substring(t, 5, 5)),
    })
    return tu.confirmed(rows, "raw", "locked", "expected").select("conv_id", "turn", "confirmation")
