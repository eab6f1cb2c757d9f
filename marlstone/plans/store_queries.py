"""Queries on the store: load, change, merge and sweep; and on digest trees of two snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import digests as dg
from marlstone.plans import queries as q
from marlstone.plans.queries import query
from marlstone.session import shared_folder, stored, table
from marlstone.sources import corpus
from marlstone.sources.store import Store

VERSION = "ingest-1"
#: In the second snapshot, documents that ``labels`` calls toxic are rewritten, and those of the purged sources are gone.
_REVISED = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
_SECOND = f"SELECT doc_id, CASE WHEN {_REVISED} THEN 'revised' || chr(10) || coalesce(text, '') ELSE text END AS text, source, lang FROM documents WHERE NOT {q._PURGED}"


def _revised(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("_r", F.lit(True))
    name = F.lower(F.coalesce("source", F.lit("")))
    kept = docs.where(~(name.contains(q.PURGED[0]) | name.contains(q.PURGED[1])))
    text = F.when(F.col("_r"), F.concat(F.lit("revised\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return kept.join(toxic, "doc_id", "left").withColumn("text", text).drop("_r")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return tuple(stored(corpus.cut(df), "snapshot") for df in (docs, _revised(spark, sf_dir, docs)))


def _snapshot_sql(name: str, source: str) -> str:
    """The CTEs of the chunks of a snapshot, renamed."""
    text = q._CHUNKS.replace("FROM documents", f"FROM {source}")
    for cte in ("lineage", "lined", "cut", "chunks"):
        text = text.replace(f"{cte} AS (", f"{cte}_{name} AS (").replace(f"FROM {cte})", f"FROM {cte}_{name})").replace(f"FROM {cte} ", f"FROM {cte}_{name} ")
    return text.replace("FROM lineage)", f"FROM lineage_{name})").strip()


_DIGESTS = """,
page_{n} AS (SELECT document_id || printf(':p%04d', page_start) AS page_id, page_start, document_id, unit_id, sha256(string_agg(sha256(text), ',' ORDER BY chunk_index)) AS digest FROM chunks_{n} GROUP BY 1, 2, 3, 4),
document_{n} AS (SELECT document_id, unit_id, sha256(string_agg(digest, ',' ORDER BY page_start)) AS digest FROM page_{n} GROUP BY 1, 2)"""
_TWO = f"second AS ({_SECOND}), {_snapshot_sql('a', 'documents')}, {_snapshot_sql('b', 'second')}{_DIGESTS.format(n='a')}{_DIGESTS.format(n='b')}"
_DIFFER = "SELECT '{level}' AS level, coalesce(a.{key}, b.{key}) AS id, CASE WHEN a.{key} IS NULL THEN 'added' WHEN b.{key} IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {a} a FULL JOIN {b} b ON a.{key} = b.{key} WHERE a.{d} IS DISTINCT FROM b.{d}"


@query(f"WITH {_snapshot_sql('a', 'documents')}{_DIGESTS.format(n='a')} SELECT document_id, unit_id, digest FROM document_a")
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.chunks(spark, sf_dir)
    return dg.levels(chunks)["document"].select(F.col("id").alias("document_id"), F.col("parent").alias("unit_id"), "digest")


@query(
    f"""WITH {_TWO}, chunk_a AS (SELECT chunk_id, sha256(text) AS digest FROM chunks_a), chunk_b AS (SELECT chunk_id, sha256(text) AS digest FROM chunks_b),
    unit_a AS (SELECT unit_id, string_agg(document_id || digest, ',' ORDER BY document_id) AS digest FROM document_a GROUP BY 1), unit_b AS (SELECT unit_id, string_agg(document_id || digest, ',' ORDER BY document_id) AS digest FROM document_b GROUP BY 1)
    {" UNION ALL ".join(_DIFFER.format(level=level, key=f"{level}_id", a=f"{level}_a", b=f"{level}_b", d="digest") for level in dg.LEVELS)}"""
)
def digest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the documents and their second snapshot, found from the top down."""
    old, new = _snapshots(spark, sf_dir)
    return dg.changes(dg.levels(old), dg.levels(new))


def _hierarchy(chunks: DataFrame, generation: int) -> dict[str, DataFrame]:
    """Rows of the upper tables for the documents of some chunks."""
    docs = chunks.groupBy("document_id", "unit_id", "grade", "subject", "source").agg(F.count("*").alias("n_chunks"))
    grade_id = F.format_string("grade_%02d", "grade")
    subject_id = F.concat_ws(":", grade_id, "subject")
    made = [F.lit(generation).alias("created"), F.lit(generation).alias("updated")]
    return {
        "grades": docs.select(grade_id.alias("grade_id"), F.concat(F.lit("Grade "), "grade").alias("name"), *made).distinct(),
        "subjects": docs.select(subject_id.alias("subject_id"), grade_id.alias("grade_id"), F.col("subject").alias("name"), *made).distinct(),
        "units": docs.select("unit_id", subject_id.alias("subject_id"), F.col("source").alias("name"), *made).distinct(),
        "documents": docs.select("document_id", "unit_id", "source", "n_chunks", *made),
    }


def ingest(store: Store, chunks: DataFrame, generation: int) -> None:
    """Brings the store to a snapshot: documents that changed are rebuilt, others are left as they are, and those not in it go with all that hangs on them."""
    state = stored(dg.levels(chunks)["document"].select(F.col("id").alias("document_id"), "digest"), "state")
    if store.exists("documents"):
        store.remove("documents", stored(store.read("documents").join(state, "document_id", "left_anti").select("document_id"), "absent"))
    todo = stored(store.pending(state, VERSION), "todo")
    built = stored(chunks.join(todo, "document_id", "left_semi"), "built")
    for name, rows in _hierarchy(built, generation).items():
        store.merge(name, rows)
    sections = built.groupBy("section_id", "document_id").agg(F.min_by("section_title", "chunk_index").alias("title"))
    pages = built.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("p")).select(F.concat("document_id", F.format_string(":p%04d", "p")).alias("page_id"), "document_id").distinct()
    store.replace_content(todo, {"sections": sections, "pages": pages, "chunks": built.select("chunk_id", "document_id", "section_id", "chunk_index", "source", "text")})
    store.mark_complete(built.groupBy("document_id").agg(F.count("*").alias("n_chunks")).join(todo, "document_id").withColumn("version", F.lit(VERSION)))
    store.sweep()


_STATE = "SELECT 'document' AS kind, b.document_id AS id, CAST(1 AS INT) AS created, CAST(CASE WHEN a.digest IS DISTINCT FROM b.digest THEN 2 ELSE 1 END AS INT) AS updated FROM document_b b LEFT JOIN document_a a USING (document_id)"


@query(
    f"""WITH {_TWO}, doc AS ({_STATE}), of AS (SELECT DISTINCT document_id AS id, unit_id, printf('grade_%02d', grade) AS grade_id, printf('grade_%02d', grade) || ':' || subject AS subject_id, source FROM chunks_b)
    SELECT kind, id, created, updated, n AS n_below, texts FROM doc JOIN (SELECT document_id AS id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS texts FROM chunks_b GROUP BY 1) USING (id)
    UNION ALL SELECT 'unit', unit_id, 1, max(updated), count(*), NULL FROM doc JOIN of USING (id) GROUP BY 2
    UNION ALL SELECT 'subject', subject_id, 1, max(updated), count(DISTINCT unit_id), NULL FROM doc JOIN of USING (id) GROUP BY 2
    UNION ALL SELECT 'grade', grade_id, 1, max(updated), count(DISTINCT subject_id), NULL FROM doc JOIN of USING (id) GROUP BY 2"""
)
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after all documents were loaded, then its second snapshot merged: what is there, since when, and when it was last written."""
    old, new = _snapshots(spark, sf_dir)
    store = Store(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}", buckets=8)
    ingest(store, old, 1)
    ingest(store, new, 2)

    def tell(name: str, kind: str, key: str, below: str) -> DataFrame:
        count = store.read(below).groupBy(key).agg(F.count("*").alias("n_below"))
        return store.read(name).join(count, key).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "created", "updated", "n_below")

    in_order = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    texts = store.read("chunks").groupBy(F.col("document_id").alias("id")).agg(F.sha2(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").cast("binary"), 256).alias("texts"))
    rows = tell("documents", "document", "document_id", "chunks").join(texts, "id", "left")
    for name, kind, key, below in (("units", "unit", "unit_id", "documents"), ("subjects", "subject", "subject_id", "units"), ("grades", "grade", "grade_id", "subjects")):
        rows = rows.unionByName(tell(name, kind, key, below).withColumn("texts", F.lit(None).cast("string")))
    return rows
