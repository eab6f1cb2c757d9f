"""What several operators of this subpackage share: shared scratch tables, tokens, guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"

#: Rows up to which a table may be broadcast. Callers count first; beyond it they leave the join to Spark.
BROADCAST_ROWS = 200_000

#: Items in a block of ``scan``.
SCAN_BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (tests in local mode) a fresh local folder is made once per
    application and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named


_open_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``stored`` writes inside this block are deleted at its end; what is still read from them must be written before."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for name in _open_scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again; cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, fixed: bool = False) -> DataFrame:
    """``docs`` with ``_row``, which tells rows of equal or missing keys apart.

    The number is the rank of the row's file, by path, and the row's place in that file. Neither the cut into splits nor the
    number of cores enters it, so it is the same each time the table is read, on any cluster. Callers that read a table from
    files say so by ``fixed``; any other rows are stored first. The broadcast table has a row for each file, and the driver
    has listed these already.
    """
    rows = docs if fixed else stored(docs, "rows")
    where = rows.metadataColumn("_metadata")
    files = rows.select(where["file_path"].alias("_file")).distinct()
    files = files.withColumn("_rank", F.row_number().over(Window.orderBy("_file")).cast("long") - 1)
    placed = rows.select("*", where["file_path"].alias("_file"), where["row_index"].alias("_index"))
    return placed.join(F.broadcast(files), "_file").select(*docs.columns, (F.shiftleft("_rank", 33) + F.col("_index")).alias("_row"))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, else unchanged (a shuffled join).

    Give a stored table: its exchange then stands right below the join, so that adaptive execution can split a hot key of the other side.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: int, step) -> Column:
    """``step(state, item)`` from ``zero`` on, as an array of the int states after each item.

    States are appended in blocks of ``SCAN_BLOCK``, as each append copies its array.
    """
    last = lambda blocks: F.element_at(F.element_at(blocks, -1), -1)
    block = lambda i: F.slice(items, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))
    inside = lambda at, xs: F.aggregate(xs, F.array(at), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x).cast("int"))))
    firsts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / SCAN_BLOCK).cast("int"), F.lit(0)))
    blocks = F.aggregate(firsts, F.array(F.array(F.lit(zero))), lambda out, i: F.concat(out, F.array(inside(last(out), block(i)))))
    # the first block is the start alone, and each other one begins with the state it got
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(firsts)), lambda b: F.slice(b, 2, F.lit(SCAN_BLOCK))))


def is_held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in the fold; a null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold
