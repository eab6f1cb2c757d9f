"""What a user looks up about a graph: the surroundings of every chunk, the contents of every unit, and counts by kind.

Lists are cut to their first rows before anything is joined: of a section or page only the first ``MOST + 1`` chunks can be among the ``MOST`` first neighbours of any
of its chunks, so a section that holds a third of all chunks costs each of them no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how many neighbours, sections and concepts are shown.
MOST = 15


def _first(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("position", place.cast("int")).where(F.col("position") <= most)


def neighbours(chunks: DataFrame, on_page: DataFrame, most: int = MOST) -> DataFrame:
    """chunk_id, relation, neighbour_id, position: the first one-hop neighbours of every chunk by relation, then by id; the chunk itself is none.

    Repeated chunks count once; a chunk without neighbours has no row. ``on_page`` gives (chunk_id, page_id), a row for each page of a chunk.
    """
    rows = chunks.select("chunk_id", "document_id", "section_id", "chunk_index").distinct()
    found = []
    for relation, members, key in (("SAME_SECTION", rows.select("chunk_id", "section_id"), "section_id"), ("SAME_PAGE", on_page.select("chunk_id", "page_id").distinct(), "page_id")):
        able = _first(members, key, ["chunk_id"], most + 1).select(key, F.col("chunk_id").alias("neighbour_id"))
        found.append(members.join(able, key).select("chunk_id", F.lit(relation).alias("relation"), "neighbour_id"))
    beside = reading_order(rows).select("chunk_id", F.explode(F.array("previous_id", "next_id")).alias("neighbour_id"))
    found.append(beside.select("chunk_id", F.lit("ADJACENT").alias("relation"), "neighbour_id"))
    every = found[0].unionByName(found[1]).unionByName(found[2]).where(F.col("neighbour_id").isNotNull() & (F.col("neighbour_id") != F.col("chunk_id"))).distinct()
    return _first(every, "chunk_id", ["relation", "neighbour_id"], most)


def concepts_of(mentions: DataFrame, most: int = MOST) -> DataFrame:
    """chunk_id, concept, occurrences, corpus_mentions, position: the concepts of every chunk that occur most in it, with how many chunks hold them."""
    corpus = mentions.groupBy("concept").agg(F.count("*").alias("corpus_mentions"))
    return _first(mentions.join(corpus, "concept"), "chunk_id", [F.desc("occurrences"), "concept"], most)


def reading_order(chunks: DataFrame) -> DataFrame:
    """chunk_id, previous_id, next_id within the document."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    return chunks.select("chunk_id", F.lag("chunk_id").over(w).alias("previous_id"), F.lead("chunk_id").over(w).alias("next_id"))


def contents(chunks: DataFrame, mentions: DataFrame, most: int = MOST) -> DataFrame:
    """unit_id, kind, name, n, position: the documents of a unit with their chunks (all, so without position), its first sections by id, its most mentioned concepts."""
    documents = chunks.groupBy("unit_id", F.col("document_id").alias("name")).agg(F.count("*").alias("n"))
    sections = chunks.groupBy("unit_id", F.col("section_id").alias("name")).agg(F.count("*").alias("n"))
    concepts = mentions.join(chunks.select("chunk_id", "unit_id"), "chunk_id").groupBy("unit_id", F.col("concept").alias("name")).agg(F.count("*").alias("n"))
    shown = documents.withColumns({"kind": F.lit("document"), "position": F.lit(None).cast("int")})
    shown = shown.unionByName(_first(sections, "unit_id", ["name"], most).withColumn("kind", F.lit("section")))
    return shown.unionByName(_first(concepts, "unit_id", [F.desc("n"), "name"], most).withColumn("kind", F.lit("concept"))).select("unit_id", "kind", "name", "n", "position")


def counts(chunks: DataFrame, on_page: DataFrame, mentions: DataFrame) -> DataFrame:
    """kind (node or edge), label, n: how many nodes and edges of each kind there are, and of all."""
    grade_subject = F.struct("grade", "subject")

    def told(rows: DataFrame, kinds: list[tuple[str, str, Column]]) -> DataFrame:
        one = rows.agg(*[n.alias(f"_{i}") for i, (_, _, n) in enumerate(kinds)])
        each = [F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.coalesce(f"_{i}", F.lit(0)).cast("long").alias("n")) for i, (kind, label, _) in enumerate(kinds)]
        return one.select(F.inline(F.array(*each)))

    levels = [("grade", F.countDistinct("grade")), ("subject", F.countDistinct(grade_subject)), ("unit", F.countDistinct("unit_id")), ("document", F.countDistinct("document_id"))]
    last = [("section", F.countDistinct("section_id")), ("chunk", F.countDistinct("chunk_id"))]
    made = [("node", label, n) for label, n in levels + last]
    # every level but the first hangs on one above it by one edge
    made += [("edge", edge, n) for edge, (_, n) in zip(("HAS_SUBJECT", "HAS_UNIT", "HAS_DOCUMENT", "HAS_SECTION", "HAS_CHUNK"), (levels + last)[1:], strict=True)]
    made.append(("edge", "NEXT", F.countDistinct("chunk_id") - F.countDistinct("document_id")))
    paged = [("node", "page", F.countDistinct("page_id")), ("edge", "HAS_PAGE", F.countDistinct("page_id")), ("edge", "ON_PAGE", F.countDistinct("chunk_id", "page_id"))]
    out = told(chunks, made).unionByName(told(on_page, paged))
    out = out.unionByName(told(mentions, [("node", "concept", F.countDistinct("concept")), ("edge", "MENTIONS", F.countDistinct("chunk_id", "concept"))]))
    return out.select("kind", F.explode(F.array("label", F.lit("all"))).alias("label"), "n").groupBy("kind", "label").agg(F.sum("n").alias("n"))
