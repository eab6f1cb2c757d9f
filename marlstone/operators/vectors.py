"""Dense search over unit vectors: exact, or by an inverted-file index with oversampling and an exact fallback.

Both run as products of blocks. Candidates lie in lists (one list when the search is exact); a list is cut to parts of about
``PART`` rows and its queries to blocks of about ``BLOCK``, and each pair of a part and a block is a place. Rows of a place
are sorted with the queries first, so a task holds one block of queries and streams the candidates past it in Arrow
batches. A list that holds a third of all rows is thus spread over many places, and no side is broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import shared_folder, stored

PART, BLOCK = 100_000, 16_384
#: Rows that centroids are fitted on, lists at most, and rounds.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 10
#: Candidates that are fetched for each wanted row where a filter follows, and how many at most.
OVERSAMPLE, OVERSAMPLE_LOOK_BACK, MOST_CANDIDATES = 8, 16, 1000
#: Scores are ranked after rounding to six places; so much below the k-th best may still tie with it.
SLACK = 2e-6


def units(rows: DataFrame, key: str, vector: str, name: str = "key") -> DataFrame:
    """name, u: vectors of length one; those without a direction (null, empty, null or non-finite parts, all zero) are left out."""
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = rows.select(F.col(key).alias(name), F.col(vector).alias("_x"), F.sqrt(square).alias("_n")).where((F.col("_n") > 0) & (F.col("_n") < float("inf")))
    return kept.select(name, F.transform("_x", lambda x: x.cast("double") / F.col("_n")).alias("u"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class _Top:
    """The best candidates so far of one block of queries."""

    def __init__(self, ids: list, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.floor = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        for lo in range(0, len(self.ids), 1024):
            scores = self.queries[lo : lo + 1024] @ vectors.T
            if scores.shape[1] >= self.k:
                best = np.partition(scores, -self.k, axis=1)[:, -self.k]
                self.floor[lo : lo + 1024] = np.maximum(self.floor[lo : lo + 1024], best)
            r, c = np.nonzero(scores >= self.floor[lo : lo + 1024, None] - SLACK)
            self.found.append((r + lo, keys[c], scores[r, c]))
            self.held += len(r)
        if self.held > 4 * self.k * len(self.ids) + 1_000_000:
            self.found = [self.best()]
            self.held = len(self.found[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, keys and scores of all that may be among the ``k`` best."""
        if not self.found:
            return np.array([], int), np.array([], object), np.array([])
        r, keys, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((-scores, r))
        r, keys, scores = r[order], keys[order], scores[order]
        first, last = np.searchsorted(r, np.arange(len(self.ids))), np.searchsorted(r, np.arange(len(self.ids)), side="right")
        full = last - first >= self.k
        self.floor[full] = np.maximum(self.floor[full], scores[(first + self.k - 1)[full]])
        near = scores >= self.floor[r] - SLACK
        return r[near], keys[near], scores[near]


def _nearest(candidates: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """query_id, key, score: for each row of ``asks`` (list, query_id, u) what may be among its ``k`` best ``candidates`` (list, key, u) of that list."""
    spark = candidates.sparkSession
    count = lambda df: {r["list"]: r["n"] for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}  # noqa: E731  a row for each list
    sizes, wanted = count(candidates), count(asks)
    layout, places = [], 0
    for i in sorted(sizes.keys() & wanted.keys()):
        parts, blocks = -(-sizes[i] // PART), -(-wanted[i] // BLOCK)
        layout.append((i, places, parts, blocks))
        places += parts * blocks
    plan = F.broadcast(spark.createDataFrame(layout, "list int, first int, parts int, blocks int"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    id_type, key_type = asks.schema["query_id"].dataType, candidates.schema["key"].dataType
    left = asks.join(plan, "list").select("first", "blocks", deal("query_id", "blocks").alias("b"), every("parts").alias("p"), "query_id", F.lit(None).cast(key_type).alias("key"), "u", F.lit(0).alias("side"))
    right = candidates.join(plan, "list").select("first", "blocks", every("blocks").alias("b"), deal("key", "parts").alias("p"), F.lit(None).cast(id_type).alias("query_id"), "key", "u", F.lit(1).alias("side"))
    rows = left.unionByName(right).select((F.col("first") + F.col("p") * F.col("blocks") + F.col("b")).alias("place"), "side", "query_id", "key", "u")
    tasks = max(1, min(places, 3 * spark.sparkContext.defaultParallelism))

    def search(batches):
        place, asking, top = None, [], None

        def finished(top):
            r, keys, scores = top.best() if top is not None else ([], [], [])
            for lo in range(0, len(r), 65_536):
                ids = pa.array([top.ids[i] for i in r[lo : lo + 65_536]], batch.schema.field("query_id").type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys[lo : lo + 65_536], batch.schema.field("key").type), pa.array(scores[lo : lo + 65_536])], ["query_id", "key", "score"])

        for batch in batches:
            spot = np.asarray(batch["place"]).astype(np.int64) * 2 + np.asarray(batch["side"])
            for lo, hi in zip(cuts := [0, *(np.flatnonzero(np.diff(spot)) + 1), len(spot)], cuts[1:], strict=False):
                if lo == hi:
                    continue
                piece = batch.slice(lo, hi - lo)
                if spot[lo] // 2 != place:
                    yield from finished(top)
                    place, asking, top = spot[lo] // 2, [], None
                if spot[lo] % 2 == 0:
                    asking.append((piece["query_id"].to_pylist(), _matrix(piece["u"])))
                    continue
                if top is None and asking:
                    top = _Top([i for ids, _ in asking for i in ids], np.concatenate([u for _, u in asking]), k)
                if top is not None:
                    top.offer(piece["key"].to_numpy(zero_copy_only=False), _matrix(piece["u"]))
        yield from finished(top)

    dealt = rows.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int")).sortWithinPartitions("place", "side")
    return dealt.mapInArrow(search, f"query_id {id_type.simpleString()}, key {key_type.simpleString()}, score double")


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    rows = found.select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: the ``k`` rows of greatest cosine for each row of ``queries`` (query_id, query); ties go to the lesser key."""
    one = F.lit(0).alias("list")
    asks = units(queries, "query_id", "query", "query_id").select(one, "*")
    return _ranked(_nearest(units(vectors, key, vector).select(one, "*"), asks, k), k, key)


@dataclass(frozen=True)
class Index:
    """An inverted-file index: unit centroids, and postings (list, key, u) stored in a folder for each list."""

    centroids: np.ndarray
    path: str
    spark: SparkSession
    schema: object

    def postings(self, lists: list[int] | None = None) -> DataFrame:
        """The postings of the given lists; folders of others are not read."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if lists is None else rows.where(F.col("list").isin(lists))


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the sample by spherical k-means; the first rows start it, and a centroid without rows stays."""
    centroids = sample[:lists].copy()
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def build(vectors: DataFrame, lists: int | None = None, key: str = "vec_id", vector: str = "embedding", path: str | None = None) -> Index:
    """An index of every row with a direction. Centroids are fitted on the ``SAMPLE`` rows of least key hash; there are about as many lists as the
    root of the rows, ``MOST_LISTS`` at most. Postings are dealt by list and part, so a large list is written by several tasks."""
    spark = vectors.sparkSession
    rows = units(vectors, key, vector)
    count = vectors.count()
    lists = lists or max(1, min(MOST_LISTS, round(count**0.5)))
    sample = np.array([r["u"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(max(SAMPLE, lists)).collect()])
    centroids = fitted(sample, lists) if len(sample) else np.zeros((0, 0))
    kind = rows.schema["key"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            own = (_matrix(batch["u"]) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["u"], pa.array(own.astype(np.int32))], ["key", "u", "list"])

    path = path or f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    placed = rows.mapInArrow(assign, f"key {kind}, u array<double>, list int")
    part = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-count // PART)))).cast("int")
    placed.repartition("list", part).write.partitionBy("list").parquet(path)
    return Index(centroids, path, spark, placed.schema)


def probes(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """list, query_id, u: the ``n`` lists whose centroids are nearest to each query."""
    rows = units(queries, "query_id", "query", "query_id")
    kind = rows.schema["query_id"].dataType.simpleString()
    centroids = index.centroids

    def nearest(batches):
        for batch in batches:
            m = min(n, len(centroids))
            if not m:
                continue
            scores = _matrix(batch["u"]) @ centroids.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :m]
            again = np.repeat(np.arange(len(best)), m)
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(again)), batch["u"].take(pa.array(again)), pa.array(best.ravel().astype(np.int32))], ["query_id", "u", "list"])

    return rows.mapInArrow(nearest, f"query_id {kind}, u array<double>, list int")


def search(index: Index, queries: DataFrame, k: int = 20, n_probes: int | None = None, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank: the ``k`` best rows of the probed lists, all lists unless ``n_probes`` says how many."""
    asks = probes(index, queries, n_probes or len(index.centroids))
    asked = [r["list"] for r in asks.select("list").distinct().collect()]  # at most MOST_LISTS
    return _ranked(_nearest(index.postings(asked), asks, k), k, key)


def filtered(
    index: Index, vectors: DataFrame, queries: DataFrame, keep: Column, k: int = 20, n_probes: int | None = None, look_back: bool = False, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, key, score, rank, strategy: the ``k`` best rows for which ``keep`` holds, by the index where its candidates suffice.

    The index gives k * ``OVERSAMPLE`` candidates a query (twice as many with look-back, ``MOST_CANDIDATES`` at most), which are then filtered. Queries left with
    fewer than ``k`` rows are answered again by an exact search over the rows that pass the filter; ``strategy`` tells which it was.
    """
    fetched = min(MOST_CANDIDATES, k * (OVERSAMPLE_LOOK_BACK if look_back else OVERSAMPLE))
    kept = vectors.where(keep)
    near = search(index, queries, fetched, n_probes, key).drop("rank").join(kept.select(key).distinct(), key, "left_semi")
    near = near.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    near = stored(near, "candidates")
    enough = near.where(F.col("n") >= k)
    rest = queries.join(enough.select("query_id").distinct(), "query_id", "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    by_index = enough.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "rank", F.lit("index").alias("strategy"))
    return by_index.unionByName(exact(kept, rest, k, key, vector).withColumn("strategy", F.lit("exact")))
