"""Digest trees: chunk digests folded to page, document and unit digests, and two snapshots compared from the top down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels from the bottom up, each with its parent's column.
LEVELS = ("chunk", "page", "document", "unit")
#: Children of a unit are folded by prefixes of their id's hash, two hexadecimal digits at a time, so no group gathers more than this many times the mean.
PREFIX = 4


def _folded(children: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, digest, n: the digest of the children's digests in order, and how many they are."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("digest").alias("d"))))
    return children.groupBy(*by).agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["d"]), ",").cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def levels(chunk_rows: DataFrame) -> dict[str, DataFrame]:
    """id, parent, digest for each level; ``chunk_rows`` has chunk_id, chunk_index, page_start, document_id, unit_id and text.

    A chunk belongs to the page it begins on. Chunks are folded in the order of their index and pages in that of their number, which one document bounds. A unit may hold
    any share of all documents: their digests are folded by hash prefix of the document's id first, so a large unit is spread over many groups.
    """
    page_id = F.concat("document_id", F.format_string(":p%04d", "page_start"))
    chunk = chunk_rows.select("chunk_id", "chunk_index", "page_start", page_id.alias("page_id"), "document_id", "unit_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    page = _folded(chunk, ["page_id", "page_start", "document_id", "unit_id"], "chunk_index").drop("n")
    document = _folded(page, ["document_id", "unit_id"], "page_start").drop("n")
    fold = document.withColumn("prefix", F.substring(F.sha2("document_id", 256), 1, PREFIX)).withColumnRenamed("document_id", "child")
    for length in range(PREFIX, -1, -2):
        fold = _folded(fold.withColumn("prefix", F.substring("prefix", 1, length)), ["unit_id", "prefix"], "child").drop("n").withColumn("child", F.col("prefix"))
    tell = lambda df, key, parent: df.select(F.col(key).alias("id"), parent.alias("parent"), "digest")
    return {
        "chunk": tell(chunk, "chunk_id", F.col("page_id")),
        "page": tell(page, "page_id", F.col("document_id")),
        "document": tell(document, "document_id", F.col("unit_id")),
        "unit": tell(fold, "unit_id", F.lit(None).cast("string")),
    }


def changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """level, id, change (added, removed, changed): what differs between two snapshots.

    Units are compared first; each further level only below what differs on the level above, so the work below the top follows the changes and not the
    size of the snapshots.
    """
    found, above = None, None
    for level in reversed(LEVELS):
        a, b = old[level], new[level]
        if above is not None:
            a, b = (df.join(above, "parent", "left_semi") for df in (a, b))
        both = a.select("id", F.col("digest").alias("_old")).join(b.select("id", F.col("digest").alias("_new")), "id", "full")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
        differs = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.lit(level).alias("level"), "id", change.alias("change"))
        found = differs if found is None else found.unionByName(differs)
        above = differs.select(F.col("id").alias("parent"))
    return found
