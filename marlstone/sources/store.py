"""A keyed store of Parquet tables: merge with create-only fields, replacement of a document's content, orphan sweep, completion marks.

A table is a folder of ``BUCKETS`` partitions by the hash of its bucket key (its own key, or the document that owns the row), so a merge reads and rewrites only the buckets that
its rows fall in. What a merge writes is stored in full first and then takes the buckets' place by dynamic partition overwrite; a merge that is cut off is run again and gives the same table, as
merging the same rows twice changes nothing. Rows are sorted by key within a bucket, so equal tables are equal files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import stored

BUCKETS = 32


@dataclass(frozen=True)
class Table:
    """Its key, the column that buckets it, the fields that are set on creation only, and the table and column that its rows hang on."""

    name: str
    key: str
    bucket_by: str
    create_only: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None


#: The hierarchy from the top down. Grades and subjects keep what they were created with; units and documents are overwritten.
TABLES = {
    t.name: t
    for t in (
        Table("grades", "grade_id", "grade_id", ("name", "created")),
        Table("subjects", "subject_id", "subject_id", ("name", "created"), ("grades", "grade_id")),
        Table("units", "unit_id", "unit_id", ("created",), ("subjects", "subject_id")),
        Table("documents", "document_id", "document_id", ("created",), ("units", "unit_id")),
        Table("sections", "section_id", "document_id", (), ("documents", "document_id")),
        Table("pages", "page_id", "document_id", (), ("documents", "document_id")),
        Table("chunks", "chunk_id", "document_id", (), ("documents", "document_id")),
        Table("mentions", "mention_id", "document_id", (), ("documents", "document_id")),
        Table("concepts", "concept_id", "concept_id", ("created",)),
        Table("marks", "document_id", "document_id", (), ("documents", "document_id")),
    )
}
#: Tables that hold a document's content.
CONTENT = ("sections", "pages", "chunks", "mentions", "marks")


def _buckets(rows: DataFrame) -> list[int]:
    """The buckets that rows fall in, at most as many as the store has."""
    return [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self, table: Table) -> Column:
        return F.pmod(F.xxhash64(table.bucket_by), F.lit(self.buckets)).cast("int")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        system, path = self._folder(name)
        return system.exists(path)

    def read(self, name: str) -> DataFrame:
        """The table's rows, without its buckets."""
        return self.spark.read.parquet(f"{self.path}/{name}").drop("_bucket")

    def _touched(self, table: Table, numbers: list[int]) -> DataFrame:
        """Rows of the given buckets; others are not read."""
        return self.spark.read.parquet(f"{self.path}/{table.name}").where(F.col("_bucket").isin(numbers))

    def _put(self, table: Table, rows: DataFrame) -> None:
        """Replaces the buckets that ``rows`` has."""
        dealt = rows.repartition(self.buckets, "_bucket").sortWithinPartitions("_bucket", table.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/{table.name}")

    def merge(self, name: str, rows: DataFrame) -> None:
        """Upserts rows by key. Of equal keys in ``rows`` any one counts, so give each key once. Create-only fields of a row that is there stay; fields that
        ``rows`` doesn't have stay as well."""
        table = TABLES[name]
        rows = rows.withColumn("_bucket", self._bucket(table))
        if not self.exists(name):
            self._put(table, rows)
            return
        rows = stored(rows, f"{name}-new")
        before = self._touched(table, _buckets(rows))
        old, new = before.select(F.struct("*").alias("o"), F.col(table.key).alias("k")), rows.select(F.struct("*").alias("n"), F.col(table.key).alias("k"))
        both = old.join(new, "k", "full")
        merged = []
        for c in before.columns:
            if c not in rows.columns:
                merged.append(F.col(f"o.{c}").alias(c))
            elif c in table.create_only:
                merged.append(F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
            else:
                merged.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        self._put(table, stored(both.select(*merged), name))

    def remove(self, name: str, keys: DataFrame, key: str | None = None) -> None:
        """Deletes the rows whose ``key`` (the table's own unless given, or its bucket key) stands in ``keys``."""
        table = TABLES[name]
        if not self.exists(name):
            return
        key = key or table.key
        if key == table.bucket_by:
            doomed = keys.select(key).distinct().withColumn("_bucket", self._bucket(table))
        else:
            doomed = self.spark.read.parquet(f"{self.path}/{name}").join(keys.select(key).distinct(), key, "left_semi").select("_bucket")
        numbers = _buckets(doomed)
        if not numbers:
            return
        self._rewrite(table, numbers, self._touched(table, numbers).join(keys.select(key).distinct(), key, "left_anti"))

    def _rewrite(self, table: Table, numbers: list[int], rows: DataFrame) -> None:
        """Puts ``rows`` in the place of the given buckets, which need not all get some."""
        rows = stored(rows, table.name)
        self._put(table, rows)
        # a bucket without rows is not overwritten by what has no rows for it
        for number in set(numbers) - set(_buckets(rows)):
            system, path = self._folder(f"{table.name}/_bucket={number}")
            system.delete(path, True)

    def replace_content(self, documents: DataFrame, content: dict[str, DataFrame]) -> None:
        """Takes away all content of the given documents (document_id) and puts the new, which must be theirs, in its place: one rewrite of a table's touched buckets."""
        documents = stored(documents.select("document_id").distinct().withColumn("_bucket", self._bucket(TABLES["documents"])), "replaced")
        numbers = _buckets(documents)
        for name in CONTENT:
            table, new = TABLES[name], content.get(name)
            if not self.exists(name):
                if new is not None:
                    self.merge(name, new)
            elif numbers:
                kept = self._touched(table, numbers).join(documents.select("document_id"), "document_id", "left_anti")
                if new is not None:
                    kept = kept.unionByName(new.withColumn("_bucket", self._bucket(table)), allowMissingColumns=True)
                self._rewrite(table, numbers, kept)

    def sweep(self) -> dict[str, int]:
        """Removes what hangs on nothing any more: content without its document, concepts without mentions, then units, subjects and grades without anything below.
        What a table hangs on is swept before it, so one pass reaches the fixpoint. Gives how many rows went, by table."""
        gone: dict[str, int] = {}
        upward = [(name, "documents", "document_id") for name in CONTENT] + [("concepts", "mentions", "concept_id")]
        upward += [(t.parent[0], t.name, TABLES[t.parent[0]].key) for t in reversed(TABLES.values()) if t.parent and t.name not in CONTENT]
        for name, needed, key in upward:
            if not (self.exists(name) and self.exists(needed)):
                continue
            own = TABLES[name].key
            orphans = stored(self.read(name).join(self.read(needed).select(key), key, "left_anti").select(own), f"{name}-orphans")
            n = orphans.count()
            if n:
                self.remove(name, orphans)
                gone[name] = n
        return gone

    def mark_complete(self, documents: DataFrame) -> None:
        """Writes the completion marks of documents (document_id, digest, version, n_chunks)."""
        self.merge("marks", documents.select("document_id", "digest", "version", F.col("n_chunks").cast("long").alias("n_chunks"), F.lit("complete").alias("status")))

    def pending(self, documents: DataFrame, version: str) -> DataFrame:
        """Those of ``documents`` (document_id, digest) that must be built: without a complete mark of the same digest and version that tells of chunks."""
        if not self.exists("marks"):
            return documents
        done = self.read("marks").where((F.col("status") == "complete") & (F.col("version") == version) & (F.col("n_chunks") > 0))
        return documents.join(done.select("document_id", "digest"), ["document_id", "digest"], "left_anti")

    def refresh(self, documents: DataFrame, fields: tuple[str, ...]) -> None:
        """Passes changed provenance fields of documents that are not rebuilt to them and to their chunks."""
        self.merge("documents", documents.select("document_id", *fields))
        if self.exists("chunks"):
            chunks = self.read("chunks")
            told = chunks.select("chunk_id", "document_id").join(documents.select("document_id", *[f for f in fields if f in chunks.columns]), "document_id")
            self.merge("chunks", told)
