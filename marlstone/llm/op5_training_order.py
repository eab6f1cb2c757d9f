"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot.

Texts become sequences of at most ``LENGTH`` token ids, each text closed by id 0. A first pass stores
the ids and counts the sequences of each run of rows that a task reads from one file; their running sum in the order of
files and rows gives every sequence an ordinal below N, however the files are cut into splits. A Feistel network over the next even power of two, walked along its cycle until it lands
below N, maps ordinals to slots one to one, with no table of the permutation. Slots are range-partitioned: shard k
holds the slots from k * ``PER_SHARD`` on, is sorted by one task and lies in a folder of its own as blocks, each a run of
fixed-stride records. A reader finds slot s in shard s // PER_SHARD, block s // PER_BLOCK, at byte (s % PER_BLOCK) * STRIDE;
it reads shards one after the other and resumes anywhere without opening those before.

Defined results: a null text is an empty one and gives one sequence of id 0; a missing key stays
missing; repeated rows each give sequences, and there are no ties, as slots follow from places; a text of any length
gives as many sequences as it takes; extra columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import uuid
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, numbered, shared_folder, stored, table
from .tokens import default_vocabulary, tokenizer

LENGTH = 1024
HEAD = 16
STRIDE = HEAD + 2 * LENGTH
PER_BLOCK = 512
PER_SHARD = 16 * PER_BLOCK
NO_KEY = -(1 << 63)


def feistel(at: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """Slots below ``n`` of the ordinals ``at``, one to one."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            y = right + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
            y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((y ^ (y >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(at.astype(np.uint64))
    while (late := out >= n).any():
        out[late] = once(out[late])
    return out.astype(np.int64)


def tokenised(docs: DataFrame, vocabulary: str, id_column: str, text: str, fixed: bool = False) -> DataFrame:
    """part, at, n, _key, ids: each text's ids closed by id 0 and its n sequences; the first row of its run, and how many the run has before it."""
    rows = numbered(docs.select(F.coalesce(F.col(id_column), F.lit(NO_KEY)).alias("_key"), F.col(text).alias("_text")), fixed)

    def encode(batches):
        ids_of, part, at, last = tokenizer(vocabulary).ids, -1, 0, -2
        for batch in batches:
            ids = [ids_of(t) + b"\0\0" for t in batch["_text"].tolist()]
            n = np.array([-(-len(x) // (2 * LENGTH)) for x in ids], dtype=np.int64)
            rows_, before = batch["_row"].to_numpy(), n.cumsum() - n
            opens = np.flatnonzero(rows_ != np.concatenate([[last], rows_[:-1]]) + 1)  # the run of the batch before goes on until the first of these
            which = np.searchsorted(opens, np.arange(len(rows_)), side="right")
            starts = np.concatenate([[part], rows_[opens]])
            shift = np.concatenate([[at], -before[opens]])
            place = before + shift[which]
            yield pd.DataFrame({"part": starts[which], "at": place, "n": n, "_key": batch["_key"], "ids": ids})
            if len(rows_):
                part, at, last = int(starts[which[-1]]), int(place[-1] + n[-1]), int(rows_[-1])

    return rows.mapInPandas(encode, "part long, at long, n long, _key long, ids binary")


def materialise(
    docs: DataFrame, path: str, key: int = 2024, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text", fixed: bool = False
) -> DataFrame:
    """Writes blocks of records in training order below ``path``; returns shard, block, n, payload as read again.

    ``fixed`` says that ``docs`` is read from files, else it is stored first.
    """
    whole = stored(tokenised(docs, vocabulary or default_vocabulary(), id_column, text, fixed), "ids", compression="zstd")
    first, total = {}, 0
    for r in sorted(whole.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row for each input partition and file
        first[r["part"]], total = total, total + r["n"]

    def place(batches):
        for batch in batches:
            ordinals, records = [], []
            for part, at, key_, ids in zip(*(batch[c].tolist() for c in ("part", "at", "_key", "ids")), strict=True):
                for i, start in enumerate(range(0, len(ids), 2 * LENGTH)):
                    piece = ids[start : start + 2 * LENGTH]
                    head = int(key_).to_bytes(8, "big", signed=True) + (start // 2).to_bytes(4, "big") + (len(piece) // 2).to_bytes(4, "big")
                    records.append(head + piece)
                    ordinals.append(first[part] + at + i)
                if len(records) >= 4096:
                    yield framed(ordinals, records)
                    ordinals, records = [], []
            yield framed(ordinals, records)

    def framed(ordinals, records):
        slots = feistel(np.array(ordinals, dtype=np.int64), total, key)
        return pd.DataFrame({"shard": slots // PER_SHARD, "slot": slots, "record": records})

    def blocks_of(batches):
        """Whole blocks of the sorted records of one shard; no more than one block is held."""
        held, records = None, []
        for batch in batches:
            for slot, record in zip(batch["slot"].tolist(), batch["record"].tolist(), strict=True):
                if slot // PER_BLOCK != held:
                    if records:
                        yield block(held, records)
                    held, records = slot // PER_BLOCK, []
                records.append(record.ljust(STRIDE, b"\0"))
        if records:
            yield block(held, records)

    def block(number, records):
        return pd.DataFrame({"shard": [number * PER_BLOCK // PER_SHARD], "block": [number], "n": [len(records)], "payload": [b"".join(records)]})

    placed = whole.mapInPandas(place, "shard long, slot long, record binary")
    # the shard's number is its partition's, so every task writes one whole range
    ranges = placed.repartitionById(max(1, -(-total // PER_SHARD)), F.col("shard").cast("int")).sortWithinPartitions("slot")
    blocks = ranges.select("slot", "record").mapInPandas(blocks_of, "shard long, block long, n int, payload binary")
    blocks.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(blocks.schema).parquet(path)


def read_slots(blocks: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, doc_id, start, length, ids (little-endian unsigned 16-bit) of the slots from ``first`` to before ``last``."""
    some = blocks.where((F.col("shard") >= first // PER_SHARD) & (F.col("block") >= first // PER_BLOCK))
    if last is not None:
        some = some.where((F.col("shard") <= (last - 1) // PER_SHARD) & (F.col("block") <= (last - 1) // PER_BLOCK))
    # bound, as each use of a binary column inside a lambda would copy the whole payload
    records = bind(F.col("payload"), lambda p: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(p, i * STRIDE + 1, F.lit(STRIDE))))
    each = some.select("block", F.posexplode(records).alias("i", "r"))
    number = lambda a, n: F.conv(F.hex(F.substring("r", a, n)), 16, -10).cast("long")
    out = each.select(
        (F.col("block") * PER_BLOCK + F.col("i")).alias("slot"),
        F.nullif(number(1, 8), F.lit(NO_KEY)).alias("doc_id"),
        number(9, 4).alias("start"),
        number(13, 4).alias("length"),
        "r",
    ).withColumn("ids", F.substring("r", F.lit(HEAD + 1), (F.col("length") * 2).cast("int"))).drop("r")
    out = out.where(F.col("slot") >= first)
    return out if last is None else out.where(F.col("slot") < last)


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/order-{uuid.uuid4().hex}"
    rows = read_slots(materialise(table(spark, sf_dir, "documents").select("doc_id", "text"), path, fixed=True))
    return rows.select("slot", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"))
