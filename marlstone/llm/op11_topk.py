"""Exact top-k search by columnar branch and bound.

Vectors become rows of integers, stored once with a number for each row. Queries are dealt to blocks of about ``QUERY_BLOCK`` rows,
and every pair of a query block and a group of candidates is one partition: there the queries come first and the candidates
stream past, those of most mass first, so a task holds its queries, their best so far and one batch, however large
the table is. A batch is turned to vertical layout, a row for each dimension, and inner products are summed
dimension block by dimension block. After a block, what the other dimensions can still add is at most the product of
the two remaining masses (Cauchy-Schwarz); pairs whose sum and bound stay below the query's k-th best so far go, and once
few are left the survivors are compacted and finished one by one. Scores are exact integers; the bound alone is rounded, upward.
The k best of each candidate group meet in one ranking for each query.

There are as many candidate groups as are needed to have ``tasks`` partitions (three for each core unless given), and one where query blocks
alone suffice, so what meets in the ranking grows with the queries; the result is the same with any number. No side is broadcast.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as ended by zeros, so an
empty one scores 0 with all; integers beyond 2**27 in size are taken as 2**27; rows without a key are candidates, last among ties, and no queries; rows of
equal keys are each a query and each other's candidates; ties go to the smaller key; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import integers, matrix

K, SCALE = 20, 64
QUERY_BLOCK = 16_384
#: Rows of a tile of the inner-product table, its columns, and the dimensions that are added between two tests.
TILE, WIDTH, DIMS = 1024, 2048, 16
#: Survivors are compacted when they are fewer than this share of a tile.
FEW = 0.05


class Search:
    """The best candidates so far of a block of queries."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.q, self.rows, self.k = queries, rows, k
        self.score = np.full((len(rows), k), np.iinfo(np.int64).min)
        self.key = np.full((len(rows), k), np.iinfo(np.int64).max)

    def offer(self, values: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        """Candidates as a matrix, a row each."""
        width = max(self.q.shape[1], values.shape[1])
        q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.q, values))
        # float32 and float64 hold integers up to 2**24 and 2**53 exactly
        most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        q, columns = q.astype(kind), np.ascontiguousarray(v.T.astype(kind))
        rest_q, rest_c = (np.sqrt(_rest(x)) for x in (q.T, columns))
        for lo in range(0, len(q), TILE):
            for at in range(0, columns.shape[1], WIDTH):
                a, b = slice(lo, lo + TILE), slice(at, at + WIDTH)
                self._tile(lo, q[a], rest_q[:, a], columns[:, b], rest_c[:, b], rows[b], keys[b])

    def _tile(self, lo, q, rest_q, columns, rest_c, rows, keys) -> None:
        floor = self.score[lo : lo + len(q), -1]
        own = self.rows[lo : lo + len(q), None] == rows
        dims, some = len(columns), np.broadcast_to(~own, own.shape)
        if (floor > np.iinfo(np.int64).min).all():
            least = floor[:, None].astype(np.float64)
            sums, done = np.zeros(own.shape, q.dtype), 0
            while done < dims:
                sums += q[:, done : done + DIMS] @ columns[done : done + DIMS]
                done = min(done + DIMS, dims)
                some = (sums + _upward(np.outer(rest_q[done], rest_c[done])) >= least) & ~own
                if some.mean() < FEW:
                    break
            r, c = np.nonzero(some)
            score = sums[r, c].astype(np.int64)
            while done < dims and len(r):  # the survivors, one by one
                to = min(done + DIMS, dims)
                score += np.einsum("ij,ij->i", q[r, done:to], columns[done:to].T[c]).astype(np.int64)
                done = to
                left = score + _upward(rest_q[done][r] * rest_c[done][c]) >= floor[r]
                r, c, score = r[left], c[left], score[left]
        else:
            sums = (q @ columns).astype(np.int64)
            sums[own] = np.iinfo(np.int64).min
            n = sums.shape[1]
            cut = np.partition(sums, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(q), np.iinfo(np.int64).min)
            r, c = np.nonzero((sums >= np.maximum(cut, floor)[:, None]) & ~own)
            score = sums[r, c]
        self._merge(lo, r, score, keys[c])

    def _merge(self, lo, r, score, key) -> None:
        if not len(r):
            return
        met = np.unique(r)
        old = np.repeat(met, self.k)
        r, score, key = np.concatenate([old, r]), np.concatenate([self.score[lo + met].ravel(), score]), np.concatenate([self.key[lo + met].ravel(), key])
        order = np.lexsort((key, ~score, r))  # ~score falls as score grows, the least number included
        r, score, key = r[order], score[order], key[order]
        first = np.searchsorted(r, met)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.score[lo + met], self.key[lo + met] = score[take].reshape(-1, self.k), key[take].reshape(-1, self.k)


def _rest(columns: np.ndarray) -> np.ndarray:
    """At i: the squared mass of each column from dimension i on."""
    squares = columns.astype(np.float64) ** 2
    return np.concatenate([squares[::-1].cumsum(axis=0)[::-1], np.zeros((1, columns.shape[1]))])


def _upward(bound: np.ndarray) -> np.ndarray:
    """A rounded bound made large enough to be one."""
    return bound * (1 + 1e-6) + 1e-6


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, tasks: int | None = None
) -> DataFrame:
    """query_id, rank, key, score: the ``k`` rows of greatest inner product for each row of which ``is_query`` (of the key) holds."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = integers(vectors, scale, key, vector).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("asks", F.coalesce(is_query, F.lit(False)) & F.col("key").isNotNull()), "integers")
    asked = rows.where("asks").count()
    blocks = max(1, -(-asked // query_block))
    groups = max(1, -(-(tasks or 3 * rows.sparkSession.sparkContext.defaultParallelism) // blocks))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    what = ["row", F.col("key").cast("long").alias("key"), "v", "mass"]
    queries = rows.where("asks").select(*what, F.lit(0).alias("side"), deal(1, blocks).alias("b"), every(groups).alias("g"))
    candidates = rows.select(*what, F.lit(1).alias("side"), every(blocks).alias("b"), deal(2, groups).alias("g"))
    pairs = queries.unionByName(candidates) if asked else queries
    place = F.col("b") * groups + F.col("g")
    dealt = pairs.withColumn("place", place).drop("b", "g").repartitionById(blocks * groups, F.col("place")).sortWithinPartitions("side", F.desc("mass"))

    def search(batches):
        kept, found = [], None
        for batch in batches:
            side = np.asarray(batch["side"])
            ahead, after = batch.slice(0, int((side == 0).sum())), batch.slice(int((side == 0).sum()))
            if ahead.num_rows:
                kept.append(ahead)
            if after.num_rows and kept:
                if found is None:
                    asks = pa.Table.from_batches(kept)
                    found = Search(matrix(asks["v"], "<i4"), np.asarray(asks["row"]), k)
                found.offer(matrix(after["v"], "<i4"), np.asarray(after["row"]), np.asarray(after["key"].fill_null(np.iinfo(np.int64).max)))
        if found is not None:
            keys = np.asarray(asks["key"])
            for lo in range(0, len(keys), 2048):
                r, c = np.nonzero(found.score[lo : lo + 2048] > np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (found.rows[lo + r], keys[lo + r], found.key[lo + r, c], found.score[lo + r, c])], ["row", "query_id", "key", "score"]
                )

    best = dealt.mapInArrow(search, "row long, query_id long, key long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    named = F.when(F.col("key") < F.lit(np.iinfo(np.int64).max), F.col("key").cast(kind))
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), "rank", named.alias(key), "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("key") % 20 == 0)


SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(CAST(q.i AS DOUBLE[]), CAST(e.i AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v e ON q.r <> e.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 20"""
