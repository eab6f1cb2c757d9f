"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

``RULES`` is data: each row names a numerator, a denominator, the bounds in hundredths and the
number of words from which it applies. ``compile_rules`` turns the rows into boolean columns, so a
text is judged in one pass with no user function, no join and no shuffle.

Defined results: a null or empty text has no words, no lines with words and fails the base rule;
a text of any length is read whole; repeated rows are judged separately; columns of the input that
are not asked for are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on are as with be by this from or have an they which at not but "
    "le la les de des du un une et est que qui dans pour par sur avec en au pas plus "
    "der die das und den dem von zu mit ist im nicht ein eine auf als auch es sich für "
    "el los las y del que en una por con para no se su lo al como más"
).split()


class Rule(NamedTuple):
    """100 * part must lie within [low, high] * whole, for texts of ``from_words`` words or more."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None
    from_words: int


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500, 10),
    Rule("symbols", "n_symbols", "n_words", None, 10, 10),
    Rule("stop_words", "n_stop_words", "n_words", 4, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30, 10),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90, 10),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30, 10),
)

#: The base rule: fewer words than this, or more than this share of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 10, 20


def repeat_words(grams: Column) -> Column:
    """Words covered by windows whose value occurs twice or more; ``grams`` holds a value for each window."""

    def covered(at: Column) -> Column:
        step = F.zip_with(
            at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(pairs: Column) -> Column:
        both = F.zip_with(
            pairs,
            F.slice(pairs, 2, F.size(pairs)),
            lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return bind(F.sort_array(F.array_distinct(F.flatten(both))), covered)

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), bind(ordered, repeated)).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counted columns that the rules compare."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_body", body).withColumn("_words", words(F.col("_body")))
    df = df.withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    firsts = lambda a: F.slice(a, 1, F.greatest(F.size(a) - (WINDOW - 1), F.lit(0)))
    join = lambda a: F.transform(firsts(a), lambda h, i: F.xxhash64(h, *[F.get(a, i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("_grams", bind(F.transform("_words", lambda w: F.xxhash64(w)), join))
    long = lambda c: c.cast("long")
    return df.withColumns(
        {
            "n_words": long(n),
            "word_chars": long(F.length(F.array_join("_words", ""))),
            "n_symbols": long(F.regexp_count("_body", F.lit(f"[{SYMBOLS}]"))),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_bullet_lines": long(F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]")))),
            "n_ellipsis_lines": long(F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$")))),
            "n_stop_words": long(F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS)))),
            "n_repeat_words": repeat_words(F.col("_grams")),
        }
    ).drop("_body", "_words", "_lines", "_grams")


def compile_rules(rules=RULES) -> dict[str, Column]:
    """A boolean column for each row of the table: true where the text breaks the rule."""
    out = {}
    for r in rules:
        part, whole = F.col(r.part) * 100, F.col(r.whole)
        low = part < whole * r.low if r.low is not None else F.lit(False)
        high = part > whole * r.high if r.high is not None else F.lit(False)
        out[f"fails_{r.name}"] = (F.col("n_words") >= r.from_words) & (low | high)
    return out


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``df`` with its measures, a flag for each rule, ``base_failed`` and ``kept``."""
    fails = compile_rules(rules)
    out = measures(df, text).withColumns(fails)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    broken = reduce(lambda a, b: a | b, (F.col(k) for k in fails), F.lit(False))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~broken)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select(*cols, "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         length(body) - length(translate(body, '{SYMBOLS}', '')) AS n_symbols
  FROM d),
g AS (
  SELECT doc_id, i, list_extract(ws, i) || chr(0) || list_extract(ws, i + 1) || chr(0) || list_extract(ws, i + 2) || chr(0)
         || list_extract(ws, i + 3) || chr(0) || list_extract(ws, i + 4) AS gram
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
r AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM r GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ws, lambda x: list_contains([{_STOPS}], x))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words OR 100 * n_symbols > 10 * n_words
         OR (n_words >= 50 AND 100 * n_stop_words < 4 * n_words) OR 100 * n_dup_lines > 30 * n_lines
         OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_ellipsis_lines > 30 * n_lines) AS kept,
       n_lines, n_stop_words, n_bullet_lines, n_ellipsis_lines
FROM b
"""
