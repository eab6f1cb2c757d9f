"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles (a shorter text is one shingle); two texts link at a Jaccard
similarity of 0.8 or more.

1. Texts of equal words are one class of copies; only its first row goes on, with the number
   of copies. Each class has ``TOKENS`` MinHash values: its embedded set.
2. Chosen path: in each of ``RUNS`` runs a bucket chooses each position of the embedding with
   probability 1 / (0.8 * TOKENS), by a hash of its path, and splits by the value there. Buckets of
   one member end; larger ones split again until they are dense, or until a split no longer pays. Both follow from ``c``, the average
   agreement of a bucket's members with its centre, the commonest values of about ``SAMPLE`` of them. Texts that differ each in its own way agree
   with each other in q = c / (2 - c), and are dense from q = ``MAYBE`` on. A split leaves q / 0.8 of a bucket's pairs, so it takes
   size * (1 - q / 0.8) / 2 pairs off each row; where that is at most what it would take off a bucket of ``LIMIT`` unlike members, and the
   centre holds most values (else q says little), the bucket ends. Nothing else ends a bucket, whatever share of the one before it holds: each split leaves less than
   MAYBE / 0.8 of the pairs, so this ends without a limit of depth. Ended buckets are compared by brute force on their embeddings, in blocks if large.
   A pair at 0.8 meets in a run of up to four splits with
   probability of at least ``RUN_RECALL``, so ``RUNS`` follows from ``RECALL``.
3. Candidate links give connected candidates. Inside each, shingle sets are compared exactly, all
   against all in blocks of bounded size, which yields each text's number of links and its class.

Copies are never expanded: links count them by multiplication. Rows made in 2 are proportional to
the texts; in 3 a connected group of m different near copies is compared in (m / block)^2 block pairs,
since each of its links has to be counted, but pairs leave no task.

Rows are told apart by their place in the input, not by key, so keys may repeat or be missing.

Defined results: null and empty texts have no shingles and link to nothing; repeated rows link to
each other; texts of any length are read whole; extra columns are ignored, whatever their names; the id of a class is
the least key of its members, and -1 less its first row's number if none has a key; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, numbered, small, stored, table, words
from .graph import components

WIDTH, SIMILAR = 5, 0.8
TOKENS = 64
LIMIT, SAMPLE = 200, 32
RECALL, RUN_RECALL = 0.999, 0.31
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - RUN_RECALL))
#: Embeddings that agree in this share may be similar: 0.8 less four standard deviations of 64 trials.
MAYBE = 0.6
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000


def shingles(text: Column) -> Column:
    """Distinct shingle hashes of a text; none for a text without words."""
    firsts = lambda a: F.slice(a, 1, F.greatest(F.size(a) - (WIDTH - 1), F.lit(0)))
    wide = lambda a: F.transform(firsts(a), lambda h, i: F.xxhash64(h, *[F.get(a, i + k) for k in range(1, WIDTH)]))
    whole = lambda a: F.when(F.size(a) >= WIDTH, wide(a)).when(F.size(a) > 0, F.array(F.xxhash64(a))).otherwise(wide(a))
    return F.array_distinct(bind(F.transform(words(text), lambda w: F.xxhash64(w)), whole))


def _embed(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        mixed = values[None, at : at + 2048] * a[:, None] + b[:, None]
        np.minimum(best, mixed.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def embedded(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, same (digest of the words), n (shingles), sig (MinHash values as bytes; null without words)."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
    rows = rows.select(
        F.col("_row").alias("row"),
        F.col(key).cast("long").alias("key"),
        F.md5(F.array_join(words(F.col(text)), " ").cast("binary")).alias("same"),
        shingles(F.col(text)).alias("s"),
    )

    def embed(batches):
        for batch in batches:
            lists = batch.column("s")
            values, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            ends = ends - ends[0]
            sigs = [_embed(values[x:y], a, b).tobytes() if y > x else None for x, y in zip(ends[:-1], ends[1:], strict=True)]
            new = [pa.array(np.diff(ends).astype("int64")), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "same")), *new], ["row", "key", "same", "n", "sig"])

    return rows.mapInArrow(embed, "row long, key long, same string, n long, sig binary")


def classes(rows: DataFrame) -> DataFrame:
    """same, rep (first row), key (the least), copies, n, sig: one for each set of texts of equal words."""
    return rows.where("n > 0").groupBy("same").agg(
        F.min("row").alias("rep"), F.min("key").alias("key"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )


def value_at(sig: Column, i: Column | int) -> Column:
    return F.substring(sig, F.lit(4) * i + 1, F.lit(4))


def agreement(a: Column, b: Column) -> Column:
    """In what share of the values two embeddings agree."""
    every = F.sequence(F.lit(0), F.lit(TOKENS - 1))
    return F.size(F.filter(every, lambda i: value_at(a, i) == value_at(b, i))) / TOKENS


def chosen(path: Column) -> Column:
    """Positions that a bucket splits by."""
    share = round((1 << 20) / (SIMILAR * TOKENS))
    every = F.sequence(F.lit(0), F.lit(TOKENS - 1))
    return F.filter(every, lambda i: F.pmod(F.xxhash64(path, i), F.lit(1 << 20)) < share)


def ended(large: DataFrame) -> DataFrame:
    """bucket, ends: whether buckets of (bucket, rep, size, sig) are dense, or a split wouldn't pay."""
    some = large.where(F.pmod(F.xxhash64("rep", "bucket"), F.col("size")) < SAMPLE)
    commonest = [F.mode(F.hex(value_at(F.col("sig"), i)), True) for i in range(TOKENS)]
    centres = small(stored(some.groupBy("bucket").agg(F.unhex(F.concat(*commonest)).alias("centre")), "centres"))
    near = large.join(centres, "bucket", "left").groupBy("bucket").agg(
        F.avg(F.coalesce(agreement(F.col("sig"), F.col("centre")), F.lit(0))).alias("c"), F.first("size").alias("size")
    )
    each_other = F.col("c") / (2 - F.col("c"))
    spared = (F.col("c") >= 0.5) & (F.col("size") * (1 - each_other / SIMILAR) <= LIMIT)
    return near.select("bucket", ((each_other >= MAYBE) | spared).alias("ends"))


def leaves(reps: DataFrame) -> DataFrame:
    """bucket, rep, size: members of the buckets in which the paths end, those with two or more members."""
    spark = reps.sparkSession
    starts = spark.range(RUNS).select(F.explode(chosen(F.hash("id"))).alias("i"), F.hash("id").alias("path")).collect()
    first = F.array(*[F.xxhash64(F.lit(r["path"]), F.lit(r["i"]), value_at(F.col("sig"), r["i"])) for r in starts])
    nodes = reps.select("rep", F.explode(first).alias("bucket"))
    out = None
    while True:
        sizes = stored(nodes.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        nodes = stored(nodes.join(sizes, "bucket"), "paths")
        large = F.col("size") > LIMIT
        ends = nodes.where(~large).select("bucket", "rep", "size")
        out = ends if out is None else out.unionByName(ends)
        large = nodes.where(large)
        if large.isEmpty():
            return out
        large = stored(large.select("bucket", "rep", "size").join(reps.select("rep", "sig"), "rep"), "large")
        large = large.join(small(stored(ended(large), "ended")), "bucket")
        out = out.unionByName(large.where("ends").select("bucket", "rep", "size"))
        split = large.where("NOT ends").select("rep", "sig", "bucket", F.explode(chosen(F.col("bucket"))).alias("i"))
        # stored, as sizes and paths both read it
        nodes = stored(split.select("rep", F.xxhash64("bucket", "i", F.expr("substring(sig, 4 * i + 1, 4)")).alias("bucket")), "splits")


def in_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Rows with (x, y), the pair of blocks they are compared in, and ``own``, the block they belong to.

    A group of one block gives the pair (0, 0) alone; of k blocks, each row goes to k pairs.
    """
    k = F.greatest(blocks.cast("int"), F.lit(1))
    rows = rows.withColumn("_k", k).withColumn("own", F.pmod(F.xxhash64(F.col("rep"), F.lit(3)), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    return rows.withColumn("_o", other).withColumns({"x": F.least("own", "_o"), "y": F.greatest("own", "_o")}).drop("_o", "_k")


def _roots(n: int, links) -> list[int]:
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def candidate_links(reps: DataFrame) -> DataFrame:
    """a, b: links that keep together all representatives whose embeddings agree enough in some bucket."""
    rows = leaves(reps).join(reps.select("rep", "sig"), "rep")
    rows = in_blocks(rows, "bucket", F.ceil(F.col("size") / BLOCK_ROWS))
    groups = rows.groupBy("bucket", "x", "y").agg(F.collect_list(F.struct("rep", "sig")).alias("m")).where(F.size("m") > 1).select("m")

    def compare(batches):
        for batch in batches:
            out = set()
            for members in batch["m"]:
                members = sorted((m["rep"], bytes(m["sig"])) for m in members)
                reps_ = [m[0] for m in members]
                sig = np.frombuffer(b"".join(m[1] for m in members), "<u4").reshape(len(members), TOKENS)
                free = np.arange(len(members))
                while len(free) > 1:  # breadth first: a member that is reached is not compared again
                    queue, free = [free[0]], free[1:]
                    while queue and len(free):
                        i = queue.pop()
                        near = (sig[free] == sig[i]).mean(axis=1) >= MAYBE
                        out.update((reps_[i], reps_[j]) for j in free[near])
                        queue.extend(free[near])
                        free = free[~near]
            yield pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return groups.mapInPandas(compare, "a long, b long").distinct()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by packed bits over the hashes that two or more sets hold."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    every = np.concatenate(sets)
    _, at, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.diag([len(s) for s in sets])
    width = int(shared[-1]) + 1 if len(shared) else 0
    step = max(8, (64 << 20) // max(1, len(sets)))
    keep = n[at] > 1
    row, col = row[keep], shared[at[keep]]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for first in range(0, width, step):
        some = (col >= first) & (col < first + step)
        bits = np.zeros((len(sets), min(step, width - first)), dtype=bool)
        bits[row[some], col[some] - first] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for i in range(len(sets)):
            total[i, i:] += np.bitwise_count(packed[i] & packed[i:]).sum(axis=1, dtype=np.int64)
    np.fill_diagonal(total, 0)
    return out + total + total.T


def with_blocks(members: DataFrame) -> DataFrame:
    """(component, rep, copies, n) with ``blocks``, into how many its component is split.

    Only components of several blocks are joined, so that no task gets a large component whole.
    """
    # n counts shingles: the blocks of a component hold about as many each
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).alias("blocks"))
    large = small(stored(sizes.where("blocks > 1"), "blocks"))
    return members.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def verified(members: DataFrame) -> DataFrame:
    """rep, links, root: exact comparison of (component, rep, copies, blocks, s) inside each component's block pairs."""
    rows = in_blocks(members, "component", F.col("blocks"))
    groups = rows.groupBy("component", "x", "y").agg(F.collect_list(F.struct("rep", "copies", "own", "s")).alias("m")).select("x", "y", "m")

    def compare(batches):
        for batch in batches:
            out = []
            for x, y, members_ in zip(batch["x"], batch["y"], batch["m"], strict=True):
                ms = sorted(members_, key=lambda m: m["rep"])
                sets = [np.asarray(m["s"], dtype=np.int64) for m in ms]
                if len(sets) < 2:
                    continue
                n = np.array([len(s) for s in sets])
                both = _intersections(sets)
                similar = both * (1 + SIMILAR) >= SIMILAR * (n[:, None] + n[None, :]) - 1e-9
                np.fill_diagonal(similar, False)
                if x != y:  # inside a block it is compared by the pair (x, x)
                    own = np.array([m["own"] for m in ms])
                    similar &= own[:, None] != own[None, :]
                copies = np.array([m["copies"] for m in ms])
                links = similar @ copies
                i, j = np.nonzero(np.triu(similar))
                roots = _roots(len(ms), zip(i.tolist(), j.tolist(), strict=True))
                out += [(m["rep"], int(k), ms[r]["rep"]) for m, k, r in zip(ms, links, roots, strict=True)]
            yield pd.DataFrame(out, columns=["rep", "links", "root"], dtype="int64")

    return groups.mapInPandas(compare, "rep long, links long, root long")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", fixed: bool = False) -> DataFrame:
    """_row, key, class_id, n_links, n_copies, is_first (of its class by row): a row for each document.

    ``fixed`` says that ``docs`` is read from files, else it is stored first; ``_row`` is as ``numbered`` gives it.
    """
    docs = numbered(docs.select(F.col(key).alias(key), F.col(text).alias("_text")), fixed)
    rows = stored(embedded(docs, key, "_text"), "embedded")
    reps = stored(classes(rows), "classes")
    near = stored(components(candidate_links(reps)), "components")
    members = near.join(reps.select("rep", "copies", "n"), near["node"] == F.col("rep")).select("rep", "copies", "n", F.col("root").alias("component"))
    members = with_blocks(stored(members, "members"))
    texts = docs.select(F.col("_row").alias("rep"), "_text")
    whole = texts.join(members.hint("shuffle_hash"), "rep").select("component", "rep", "copies", "blocks", shingles(F.col("_text")).alias("s"))
    exact = stored(verified(whole), "verified")
    counted = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    final = components(exact.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    linked = stored(final.join(reps.select("rep", "key"), "rep"), "final")
    ids = stored(linked.groupBy("root").agg(F.min("key").alias("least")), "ids")
    linked = linked.join(small(ids), "root").select("rep", "root", "least")
    known = reps.select("same", "rep", "key", "copies").join(counted, "rep", "left").join(linked, "rep", "left")
    root = F.coalesce("root", "rep")
    known = known.select(
        "same",
        root.alias("root"),
        F.coalesce(F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("least")), -1 - root).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )
    known = stored(known, "known")
    own = F.coalesce("key", -1 - F.col("row"))
    return rows.join(known, (rows["same"] == known["same"]) & (rows["n"] > 0), "left").select(
        F.col("row").alias("_row"),
        F.col("key").alias(key),
        F.coalesce("class_id", own).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("root") == F.col("row"), F.lit(True)).alias("is_first"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), fixed=True).drop("_row", "is_first")
