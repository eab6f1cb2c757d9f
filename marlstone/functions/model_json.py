"""Objects read from what a language model wrote: fences and text around them cut away, fields checked, and one second try."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What fields may hold.
INTENTS = ("explain", "verify", "practice", "other")
INPUT_KINDS = ("math_problem", "diagram", "other")
#: Why a rewrite was not used.
NOT_JSON, NOT_PARSED, NO_QUERY = "rewriter output was not JSON", "rewriter JSON could not be parsed", "retrieval_query missing"

_FENCE, _FENCE_END, _OBJECT = r"^```(?:json)?\s*", r"\s*```$", r"(?s)\{.*\}"


def _bare(raw: Column) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, _FENCE, ""), _FENCE_END, "")).otherwise(text)


def object_text(raw: Column) -> Column:
    """The text between the first opening and the last closing brace, or null."""
    return F.regexp_substr(_bare(raw), F.lit(_OBJECT))


def json_object(raw: Column, repair: bool = False) -> Column:
    """The object in a text as a variant, or null. With ``repair``, an object that is cut off is closed: after its last whole value, or inside a string."""
    whole = F.try_parse_json(object_text(raw))
    if not repair:
        return whole
    opened = F.regexp_substr(_bare(raw), F.lit(r"(?s)\{.*"))
    tries = [F.try_parse_json(F.concat(F.regexp_replace(opened, r"[,\s]+$", ""), F.lit(end))) for end in ("}", '"}', "]}", '"]}', "}}", '"}}')]
    return F.coalesce(whole, *tries)


def text_field(variant: Column, name: str) -> Column:
    """A field that holds a string, its white space collapsed; null for any other."""
    value = F.try_variant_get(variant, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.trim(F.regexp_replace(F.try_variant_get(variant, f"$.{name}", "string"), r"\s+", " ")))


def _one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise("other")


def rewrite(rows: DataFrame, raw: str = "raw", original: str = "original") -> DataFrame:
    """``rows`` with retrieval_query, intent, input_kind, transcribed_question, fallback and reason of a rewriter's output; where it can't be used, the question itself is searched.

    Each step is a column of its own, so an output is parsed once.
    """
    own = [c for c in rows.columns if c not in (raw, original)]
    read = rows.select(*own, F.coalesce(original, F.lit("")).alias("_original"), object_text(F.col(raw)).alias("_found"))
    read = read.withColumn("_parsed", F.try_parse_json("_found"))
    fields = {f"_{n}": text_field(F.col("_parsed"), n) for n in ("retrieval_query", "transcribed_question", "intent", "input_kind")}
    read = read.withColumns(fields).withColumn("_told", F.coalesce("_transcribed_question", F.lit("")))
    why = F.when(F.col("_found").isNull(), NOT_JSON).when(F.col("_parsed").isNull(), NOT_PARSED).when(F.coalesce("_retrieval_query", F.lit("")) == "", NO_QUERY)
    read = read.withColumn("reason", why)
    good, missing = F.col("reason").isNull(), F.col("reason") == NO_QUERY
    question = F.when(missing & (F.trim("_original") != ""), F.trim("_original")).when(missing & (F.col("_told") != ""), F.col("_told")).otherwise(F.col("_original"))
    return read.select(
        *own,
        F.when(good, F.col("_retrieval_query")).otherwise(question).alias("retrieval_query"),
        F.when(good, _one_of(F.col("_intent"), INTENTS)).otherwise("other").alias("intent"),
        _one_of(F.col("_input_kind"), INPUT_KINDS).alias("input_kind"),
        F.col("_told").alias("transcribed_question"),
        F.col("reason").isNotNull().alias("fallback"),
        "reason",
    )


def retry_once(rows: DataFrame, complete: Callable[[DataFrame], DataFrame], validate: Callable[[Column], Column], repair: str, fallback: Column, key: str = "id") -> DataFrame:
    """key, answer, tries: a valid answer to each prompt, or ``fallback``.

    ``complete`` adds ``raw`` to rows of key and prompt; ``validate`` gives the answer in it, or null. Rows without a valid answer are asked once more with ``repair``
    added to the prompt; ``complete`` should store what it gives, as both passes read it.
    """
    first = complete(rows).withColumn("answer", validate(F.col("raw")))
    again = first.where(F.col("answer").isNull()).select(key, F.concat("prompt", F.lit("\n\n"), F.lit(repair)).alias("prompt"))
    second = complete(again).withColumn("answer", validate(F.col("raw")))
    good = first.where(F.col("answer").isNotNull()).select(key, "answer", F.lit(1).alias("tries"))
    rest = second.join(rows.select(key, fallback.alias("_fallback")), key).select(key, F.coalesce("answer", "_fallback").alias("answer"), F.when(F.col("answer").isNull(), 3).otherwise(2).alias("tries"))
    return good.unionByName(rest)
