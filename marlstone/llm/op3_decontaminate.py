"""Benchmark decontamination by a distributed positional inverted index.

Steps, all DataFrame operations:

1. count every benchmark term over the whole corpus, and take for each window of ten benchmark
   words its rarest term (the lead) and its second rarest (the partner);
2. store the postings of leads and partners: row, position and, for leads, the nineteen words
   around, which hold any window through that position; one more posting for each row holds its
   number of words. Documents are read where they lie: only postings leave the scan;
3. adjust positions by the term's offset in the benchmark item and intersect the lists: rows of
   equal (document, item, shift) hold the offsets that agree;
4. compare the stored words with the window exactly, and merge the hit intervals of a document.

A near match is an item of which at least three leads or partners of different windows stand within ``SLOP``
positions of their places, without an exact window.

Defined results: null and empty texts have no words and no hits; an item without words matches
nothing; repeated rows are each a document, also without a key; equal items under several ids all count; an item
without an id counts and is listed as the empty text; texts of any length are read whole; extra columns
are ignored, whatever their names; without benchmark rows nothing is hit. Lists are split by (document, item, shift), so a
passage found in a third of the rows spreads over all tasks. Tables of the benchmark are broadcast only up to a
counted size; beyond it they are joined as stored tables, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, numbered, small, stored, table

SIZE = 10
SLOP = 8
NEAR_TERMS = 3


def tokens(text: Column) -> Column:
    low = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item, first (0-based), gram: every different window of ``SIZE`` words, or all words of a shorter item.

    Of equal windows of an item the first stands for all, as they hit the same words; a run of one word is thus one window, whatever its length.
    """
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(name.alias("item"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0).distinct()
    at = F.sequence(F.lit(0), F.greatest(F.size("t") - SIZE, F.lit(0)))
    every = items.withColumn("first", F.explode(at)).select("item", "first", F.slice("t", F.col("first") + 1, SIZE).alias("gram"))
    return every.groupBy("item", "gram").agg(F.min("first").alias("first")).select("item", "first", "gram")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in the whole corpus."""
    found = docs.select(F.explode(tokens(F.col("text"))).alias("term")).join(small(stored(terms, "terms")), "term", "left_semi")
    return found.groupBy("term").count()


def anchors(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with ``lead`` and ``partner``: (offset in the item, term) of their two rarest terms."""
    places = windows.select("item", "first", "gram", F.posexplode("gram").alias("k", "term"))
    counts = stored(term_counts(docs, places.select("term").distinct()), "counts")
    ranked = places.join(counts, "term", "left").groupBy("item", "first", "gram").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), (F.col("first") + F.col("k")).alias("at"), "term"))).alias("r")
    )
    return ranked.select("item", "first", "gram", F.col("r")[0].alias("lead"), F.get("r", F.lit(1)).alias("partner"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """_row, doc_id, n_words, term, pos, around, around_from: the stored index.

    ``terms`` has (term, is_lead). Every row of ``docs`` also gives one posting without a term, which alone has its doc_id and n_words.
    """
    t = docs.select("doc_id", "_row", tokens(F.col("text")).alias("t"))
    # a space stands in no term, so the row's own posting meets none, and such postings spread like any others
    own = F.array(F.concat(F.lit(" "), F.col("_row").cast("string")))
    every = t.select("doc_id", "_row", "t", F.posexplode(F.concat(own, F.col("t"))).alias("p", "term"))
    got = every.join(small(terms), "term", "left").where((F.col("p") == 0) | F.col("is_lead").isNotNull()).withColumn("pos", F.col("p") - 1)
    start = F.greatest(F.col("pos") - (SIZE - 1), F.lit(0))
    return got.select(
        "_row",
        F.when(F.col("p") == 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("p") == 0, F.size("t").cast("long")).alias("n_words"),
        F.when(F.col("p") > 0, F.col("term")).alias("term"),
        "pos",
        F.when(F.col("is_lead"), F.slice("t", start + 1, 2 * SIZE - 1)).alias("around"),
        F.when(F.col("is_lead"), start).alias("around_from"),
    )


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, exact, near): the stored postings; _row, item, first, last of exact windows; _row, item of near ones."""
    windows = stored(anchors(docs, benchmark_windows(benchmark)), "windows")
    places = (
        windows.select("item", "lead.term", "lead.at", F.lit(True).alias("is_lead"))
        .unionByName(windows.where("partner IS NOT NULL").select("item", "partner.term", "partner.at", F.lit(False).alias("is_lead")))
        .groupBy("item", "term", "at")
        .agg(F.max("is_lead").alias("leads"))
    )
    places = stored(places, "places")
    index = stored(postings(docs, stored(places.groupBy("term").agg(F.max("leads").alias("is_lead")), "anchors")), "postings")
    shifted = (
        index.where("term IS NOT NULL")
        .join(small(places), "term")
        .select("_row", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", F.when(F.col("leads"), F.struct("at", "around", "around_from")).alias("kwic"))
    )
    agreed = shifted.groupBy("_row", "item", "shift").agg(F.collect_set("at").alias("ats"), F.collect_list("kwic").alias("kwics"))
    start = F.col("shift") + F.col("first")
    # a lead meets only the windows it leads, at most SIZE of them in an item
    led = agreed.select("_row", "item", "shift", "ats", F.explode("kwics").alias("k")).withColumn("lead_at", F.col("k.at"))
    both = (
        led.join(small(windows.withColumn("lead_at", F.col("lead.at"))), ["item", "lead_at"])
        .where(F.col("partner").isNull() | F.array_contains("ats", F.col("partner.at")))
        .where(start >= 0)
    )
    same = F.slice(F.col("k.around"), F.greatest(start - F.col("k.around_from") + 1, F.lit(1)), F.size("gram")) == F.col("gram")
    exact = both.where((start >= F.col("k.around_from")) & same).select("_row", "item", start.alias("first"), (start + F.size("gram")).alias("last"))
    spot = Window.partitionBy("_row", "item").orderBy("shift").rangeBetween(0, SLOP)
    # the places of an item bound this set, whatever the document's length
    wide = agreed.select("_row", "item", F.explode("ats").alias("at")).groupBy("_row", "item").agg(F.size(F.collect_set("at")).alias("n")).where(F.col("n") >= NEAR_TERMS)
    near = (
        agreed.join(wide, ["_row", "item"], "left_semi")
        .withColumn("n", F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(spot)))))
        .where(F.col("n") >= NEAR_TERMS)
        .select("_row", "item")
        .distinct()
    )
    return index, exact, near


def covered(spans: Column) -> Column:
    """Positions in the union of (first, last) spans, sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["last"] - F.greatest(x["first"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["last"]).alias("to")
    )
    return F.aggregate(spans, zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, fixed: bool = False) -> DataFrame:
    """A row for each document: _row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items.

    ``fixed`` says that ``docs`` is read from files, else it is stored first; ``_row`` is as ``numbered`` gives it.
    """
    index, exact, near = matches(numbered(docs.select("doc_id", "text"), fixed), benchmark)
    span, none = F.struct("first", "last"), lambda kind: F.lit(None).cast(kind)
    kinds = {"doc_id": "long", "n_words": "long", "span": "struct<first:int,last:int>", "item": "string", "close": "string"}
    row = lambda df, **has: df.select("_row", *[has.get(k, none(t)).alias(k) for k, t in kinds.items()])
    lengths = row(index.where("n_words IS NOT NULL"), doc_id=F.col("doc_id"), n_words=F.col("n_words"))
    every = lengths.unionByName(row(exact, span=span, item=F.col("item"))).unionByName(row(near, close=F.col("item")))
    rows = every.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
        F.collect_set("close").alias("close"),
    )
    return rows.select(
        "_row",
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size(F.array_except("close", "items")).cast("long").alias("n_near"),
        "items",
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), fixed=True).drop("_row", "items")
