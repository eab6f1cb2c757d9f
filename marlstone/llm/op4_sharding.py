"""Sharding by a two-pass external shuffle.

Pass one counts the rows of each bucket; a row's bucket is a seeded hash of its key and its place in the input, so buckets are
of equal expected size and fit in memory, also where one key repeats. Pass two scatters the rows to their buckets, shuffles each
bucket by Fisher-Yates with a seed of its own, and deals the shuffled sequence of all buckets to
the shards in turn. Shard sizes differ by one row at most, and slots have no gaps.

Defined results: null texts are kept as null and count one byte; within a bucket rows are ordered by a hash of their key before the shuffle, and those of
equal or missing keys by their places in the input; repeated rows each get a slot; a text of any length goes to one slot whole; extra columns are
written along unchanged, those named shard or slot are replaced; an empty table gives no rows. The order depends on seed, number of buckets and the
input's files only, not on how Spark cuts them into splits, so a lost task is made again alike and so is the whole order on another cluster.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, shared_folder, table

SHARDS = 16
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 64


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 17, key: str = "doc_id", text: str = "text", buckets: int | None = None, fixed: bool = False) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; ``fixed`` says that ``docs`` is read from files, else it is stored first."""
    docs = docs.drop("shard", "slot", "_bucket", "_first", "_row", "_key", "_file", "_rank", "_index")
    names, schema = docs.columns, docs.schema
    if buckets is None:
        total = docs.select(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    bucket_of = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("_row")), F.lit(buckets)).cast("int")
    rows = numbered(docs, fixed).withColumn("_bucket", bucket_of)
    sizes = rows.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row for each bucket
    rows = rows.join(F.broadcast(first) if buckets <= 100_000 else first, "_bucket")

    def deal(bucket: pa.Table) -> pa.Table:
        number, start = bucket["_bucket"][0].as_py(), bucket["_first"][0].as_py()
        bucket = bucket.sort_by([("_key", "ascending"), ("_row", "ascending")]).select(names)
        place = start + np.random.Generator(np.random.PCG64([seed, number])).permutation(bucket.num_rows)
        return bucket.append_column("shard", pa.array((place % shards).astype("int32"))).append_column("slot", pa.array(place // shards))

    out = T.StructType([*schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # Arrow, not pandas, which would turn integer columns with nulls to floats
    dealt = rows.withColumn("_key", F.xxhash64(key)).repartition(buckets, "_bucket")
    return dealt.groupBy("_bucket").applyInArrow(deal, out)


def write_shards(docs: DataFrame, path: str, **how) -> DataFrame:
    """Writes the shards as Parquet below ``path``, a folder for each shard, and returns them as read again."""
    rows = shuffled(docs, **how)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = write_shards(docs, f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}", fixed=True)
    body = F.coalesce("text", F.lit(""))
    return made.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
