"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

A template of n words belongs to the class L, the power of two from n on, and is sought in windows of
2 L words every L words: any text of up to L + 1 words lies whole in one window. A window that
holds the template shares at least (n - 2) of its 2 L - 2 shingles, so one of ``BANDS`` MinHash
values agrees with probability 1 - (1 - s) ** BANDS, over 0.9999 at the smallest s. Bands are looked up from the
templates' side: a value can agree only where the window holds the shingle that is the template's minimum there, so windows
with none of these shingles are left out before their own values are computed. What is retrieved is verified exactly.

Covered: the names of ``license_texts.TEMPLATES`` (grants and notices, and whole bodies of the short licenses).

Defined results: null, empty and short texts have no matches; every window of a long text is read;
repeated rows match separately, also without a key; the same template found in several windows is one row with the
count and the first place; of templates of one license the greatest containment holds, so ties change nothing; extra columns are ignored, whatever
their names; an empty table gives an empty result. The only tables joined are the fixed templates, so no key of the data is shuffled but (row, license).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table
from .license_texts import TEMPLATES

SHINGLE = 3
BANDS = 96
CONTAINED = 0.8

def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``shingles``: a hash for each three words in a row; fewer words have none."""
    firsts = lambda a: F.slice(a, 1, F.greatest(F.size(a) - (SHINGLE - 1), F.lit(0)))
    join = lambda a: F.transform(firsts(a), lambda h, i: F.xxhash64(h, *[F.get(a, i + k) for k in range(1, SHINGLE)]))
    return df.withColumn("shingles", bind(F.transform(license_words(F.col(text)), lambda w: F.xxhash64(w)), join))


def signature(shingles: Column) -> Column:
    """``BANDS`` MinHash values of one row each."""
    seeds = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(seeds, lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, reach (class L), wanted (distinct shingles), bands, least (the shingles that are a minimum in some band)."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = with_shingles(spark.createDataFrame(rows, "template int, license string, text string"))
    n = F.size(license_words(F.col("text")))
    reach = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(4))))).cast("int")
    t = t.select("template", "license", reach.alias("reach"), F.array_distinct("shingles").alias("wanted")).withColumn("bands", signature(F.col("wanted")))
    least = F.filter("wanted", lambda h: F.exists("bands", lambda v: F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(h, j) == v)))
    return t.withColumn("least", least)


def license_matches(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id") -> DataFrame:
    """key, license, n_windows, first_word, containment: a row for each document and license found."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    fixed = known.collect()  # the templates alone
    values = [(r["license"], r["template"], r["reach"], r["wanted"], j, v) for r in fixed for j, v in enumerate(r["bands"])]
    bands = F.broadcast(spark.createDataFrame(values, "license string, template int, reach int, wanted array<bigint>, band int, value bigint"))
    reaches = sorted({r["reach"] for r in fixed})
    any_of = lambda some: F.array(*[F.lit(h) for h in sorted({h for r in some for h in r["least"]})]).cast("array<bigint>")
    rows = docs.select(F.col(key).alias("_key"), F.col("text"), F.monotonically_increasing_id().alias("_row"))
    rows = with_shingles(rows).drop("text").where(F.arrays_overlap("shingles", any_of(fixed)))

    def windows(reach: int) -> Column:
        least = any_of([r for r in fixed if r["reach"] == reach])
        starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - 1, F.lit(0)), F.lit(reach))
        cut = F.transform(starts, lambda at: F.struct(F.lit(reach).alias("reach"), at.alias("at"), F.array_distinct(F.slice("shingles", at + 1, 2 * reach - (SHINGLE - 1))).alias("window")))
        return F.filter(cut, lambda w: F.arrays_overlap(w["window"], least))

    rows = rows.select("_key", "_row", F.explode(F.concat(*[windows(r) for r in reaches])).alias("w")).select("_key", "_row", "w.*")
    rows = rows.withColumn("minima", signature(F.col("window")))
    banded = rows.select("_key", "_row", "reach", "at", "window", F.posexplode("minima").alias("band", "value"))
    inside = F.size(F.array_intersect("wanted", "window")) / F.size("wanted")
    # a window's template may agree in many bands; it is verified once
    found = banded.join(bands, ["reach", "band", "value"]).dropDuplicates(["_row", "reach", "at", "template"])
    hits = found.withColumn("share", inside).where(F.col("share") >= CONTAINED)
    return (
        hits.groupBy("_row", "license")
        .agg(F.first("_key").alias(key), F.countDistinct("at").alias("n_windows"), F.min("at").cast("long").alias("first_word"), F.max("share").alias("containment"))
        .select(key, "license", "n_windows", "first_word", "containment")
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
