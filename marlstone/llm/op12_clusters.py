"""Centroid clustering with integer centroids, by progressive search in Walsh-Hadamard coefficients.

Vectors are turned to integers once and stored. A round assigns them in Arrow batches against the centroids, which
are part of the task (40 rows of 64 integers), and gives a sum of vectors for each task and cluster; sums meet in 40 groups and give the new
centroids. The transform H has entries 1 and -1, so coefficients are integers and the sum of squared coefficient
differences is exactly 64 times the squared distance. Coefficients are ordered by their number of sign changes: the first ones tell
coarse differences. A batch sums differences over the first coefficients for all centroids, finishes the most promising one
of each vector, and from then on drops, group by group, every centroid whose sum is strictly above that whole distance;
what survives is finished over all 64, and the least distance wins, the smaller number among equal ones. Rounds end early where centroids no
longer move, as later ones would change nothing.

Defined results: vectors that are null, hold a null or non-finite component or don't have 64 components are left out; integers beyond 2**24 in size are taken
as 2**24, so all sums fit 64 bits; a missing key is hashed and listed as missing; repeated rows are vectors of their own; starting vectors of equal hash come in the
order of their stored bytes; with fewer vectors than centroids each is one; extra columns are ignored; an empty table gives no rows. Sums of a cluster are combined
in each task first, so a cluster of a third of all rows is no hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import integers, matrix

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
LARGEST = 1 << 24
GROUPS = (4, 8, 16, 32, 64)
#: Vectors that are compared at a time.
BATCH = 4096


def transform() -> np.ndarray:
    """The Walsh-Hadamard matrix with its rows by number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < DIMS:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


H = transform()


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and the squared distance."""
    x, c = vectors.astype(np.int64) @ H.T, centroids.astype(np.int64) @ H.T
    n, rows = len(x), np.arange(len(x))
    first = GROUPS[0]
    part = sum((x[:, i, None] - c[:, i]) ** 2 for i in range(first))
    guess = part.argmin(axis=1)
    whole = part[rows, guess] + ((x[:, first:] - c[guess, first:]) ** 2).sum(axis=1)
    r, k = np.nonzero(part <= whole[:, None])
    sums = part[r, k]
    for lo, hi in zip(GROUPS[:-1], GROUPS[1:], strict=True):
        sums = sums + ((x[r, lo:hi] - c[k, lo:hi]) ** 2).sum(axis=1)
        near = sums <= whole[r]
        r, k, sums = r[near], k[near], sums[near]
    order = np.lexsort((k, sums, r))
    best = order[np.searchsorted(r[order], rows)] if n else order
    return k[best], sums[best] // DIMS


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose keys have the least hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    first = rows.select("v", F.sha2(name.cast("binary"), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64).reshape(-1, DIMS)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors; those without vectors stay."""

    def sums(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for batch in batches:
            v = matrix(batch["v"], "<i4")
            for at in range(0, len(v), BATCH):
                own, _ = nearest(v[at : at + BATCH], centroids)
                one = own == np.arange(len(centroids))[:, None]
                count += one.sum(axis=1)
                total += one.astype(np.int64) @ v[at : at + BATCH].astype(np.int64)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    each = rows.select("v").mapInArrow(sums, "cluster long, n long, total array<long>")
    out = centroids.copy()
    for r in each.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(DIMS)]).collect():  # a row for each cluster
        out[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(DIMS)]
    return out


def clusters(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector of 64 sound components."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = stored(integers(vectors.where(F.size(vector) == DIMS), scale, key, vector, LARGEST).drop("mass"), "integers")
    centroids = start(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, moved(rows, centroids)
        if (before == centroids).all():
            break

    def assign(batches):
        for batch in batches:
            v = matrix(batch["v"], "<i4")
            for at in range(0, len(v), BATCH):
                own, distance = nearest(v[at : at + BATCH], centroids)
                yield pa.RecordBatch.from_arrays([batch["key"].slice(at, BATCH), pa.array(own.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    placed = stored(rows.mapInArrow(assign, f"key {kind}, cluster int, distance long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(exact.alias("s")).collect()}  # a row for each cluster
    fit = lambda s: min(s, (1 << 63) - 1)
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(i, fit(sums[i]), fit(sum(sums.values())), name(c)) for i, c in enumerate(centroids) if i in sums]
    per = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    square = " + ".join(f"(v.i[{d}] - c.i[{d}]) * (v.i[{d}] - c.i[{d}])" for d in range(1, DIMS + 1))
    near = "SELECT v.r, arg_min(c.k, row({0}, c.k)) AS k, min({0}) AS distance FROM v, c{1} c GROUP BY 1"
    mean = ", ".join(f"CAST(floor(sum(v.i[{d}]) / count(*)) AS BIGINT)" for d in range(1, DIMS + 1))
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS i FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, i) - 1 AS k, i FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, i FROM v ORDER BY h, i LIMIT {CENTROIDS}))",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(square, n)})")
        if n < ROUNDS:
            parts.append(f"m{n} AS (SELECT k, [{mean}] AS i FROM a{n} JOIN v USING (r) GROUP BY 1)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.i, c.i) AS i FROM c{n} c LEFT JOIN m{n} m USING (k))")
    last = f"SELECT a.*, vec_id, c.i FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c USING (k)"
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(k AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(i, lambda x: x::VARCHAR), ',')) AS centroid_sha256 FROM ({last})"""


SQL = _sql()
