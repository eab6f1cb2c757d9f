"""Vectors of numbers as rows of exact integers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this size are taken as of this size.
LARGEST = 1 << 27


def matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of a binary column as a matrix of ``kind``; rows that are shorter end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return _padded(flat, np.diff(ends) // np.dtype(kind).itemsize)


def _padded(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    widest = int(lengths.max(initial=0))
    if (lengths == widest).all():
        return flat.reshape(len(lengths), widest)
    out = np.zeros((len(lengths), widest), flat.dtype)
    out[np.arange(widest) < lengths[:, None]] = flat
    return out


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False))


def integers(rows: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding", largest: int = LARGEST) -> DataFrame:
    """key, v, mass: floor(scale * x) of each component as 32-bit little-endian integers, and the sum of their squares.

    Rows without a sound vector are left out.
    """
    kept = rows.where(finite(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    kind = kept.schema["key"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            x = batch["x"]
            lengths = np.diff(np.asarray(x.offsets))
            v = np.clip(np.floor(scale * np.asarray(x.flatten())), -largest, largest).astype("<i4")
            ends = np.concatenate([[0], lengths.cumsum()])
            sums = np.concatenate([[0.0], (v.astype(np.float64) ** 2).cumsum()])
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(v)])
            yield pa.RecordBatch.from_arrays([batch["key"], packed, pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["key", "v", "mass"])

    return kept.mapInArrow(cut, f"key {kind}, v binary, mass double")
