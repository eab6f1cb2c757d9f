"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours, which fill a seed's window.

Each text becomes token ids closed by id 0. Stretches of a full window stand alone; what is left of
each text, its tail, is packed. Document frequencies and the mean length are those of all tails. A tail's two
most telling ids that any other tail has name its group; groups are put together to shards of at most about
``SHARD_DOCS`` tails, and larger groups are dealt by the second id, copies beyond that by row. A shard builds a BM25
inverted index over its tails, takes the first unused tail as seed, ranks all unused ones by all of the
seed's ids, and appends them, best first, until the window is full; the last one is cut, and its rest is the next seed.
Only the last window of a shard has padding.

Bound: a seed is held against its own shard, so related tails of which neither telling id leads to
that shard are not reached.

Defined results: a null text is an empty one and gives the single id 0; repeated rows are each
packed; ties in score go to the earlier key; extra columns are ignored; an empty table gives none. A
text of any length is cut, not dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import default_vocabulary, tokenizer

WINDOW = 1024
SHARD_DOCS = 2048
BLOCK = 1024  # texts counted at once
SPENT = 0.125  # share of used texts at which their postings leave the index
IDS = 1 << 16
K1, B = 1.2, 0.75
NO_KEY = -(1 << 63)

PIECES = "doc_id long, row long, salt long, start long, doc_tokens long, ids binary"
ROUTED = "shard int, doc_id long, row long, start long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, id and number of occurrences, for each text and distinct id in order."""
    sizes = [len(d) for d in docs]
    ids = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
    pairs, tf = np.unique((np.repeat(np.arange(len(docs)), sizes) << 16) + ids, return_counts=True)
    return pairs >> 16, pairs & 0xFFFF, tf


class Stats:
    """Number and mean length of all tails, and how many of them have each id."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, max(1.0, mean), df
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.shared = np.where(df > 1, self.idf, 0.0)

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Stats:
        df = np.bincount(counted(docs)[1], minlength=IDS)
        return cls(len(docs), float(np.mean([len(d) for d in docs])) if docs else 1.0, df)

    def weights(self, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / self.mean))

    def telling(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the two ids of greatest weight that another tail has as well, the lesser of equal ones; -1 for none."""
        best = [[], []]
        for at in range(0, len(docs), BLOCK):
            part = docs[at : at + BLOCK]
            sizes = np.array([len(d) for d in part])
            owner, term, tf = counted(part)
            w = self.shared[term] * (tf / (tf + K1 * (1 - B + B * sizes[owner] / self.mean)))
            firsts = np.searchsorted(owner, np.arange(len(part)))
            for out in best:
                top = np.maximum.reduceat(w, firsts)
                hits = np.flatnonzero(w == top[owner])
                hits = hits[np.unique(owner[hits], return_index=True)[1]]
                out.append(np.where(top > 0, term[hits], -1))
                w[hits] = 0
        first, second = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in best)
        return first, second


class Bm25:
    """Inverted index over one shard's token arrays, weighted by the statistics of all tails."""

    def __init__(self, docs: list[np.ndarray], stats: Stats):
        sizes = np.array([len(d) for d in docs], dtype=np.float64)
        doc, term, tf = counted(docs)
        order = np.argsort(term, kind="stable")
        self.live, self.doc, self.term = np.arange(len(docs)), doc[order], term[order]
        self.weight = stats.weights(self.term, tf[order], sizes[self.doc])
        self.bounds()

    def bounds(self) -> None:
        self.terms, first, df = np.unique(self.term, return_index=True, return_counts=True)
        self.spans = [slice(a, b) for a, b in zip(first.tolist(), (first + df).tolist(), strict=True)]

    def keep(self, unused: np.ndarray) -> None:
        """Only postings of unused texts stay; ``live`` lists these texts, and postings name places in it."""
        stay = unused[self.live]
        place, kept = np.cumsum(stay) - 1, stay[self.doc]
        self.live, self.doc, self.term, self.weight = self.live[stay], place[self.doc[kept]], self.term[kept], self.weight[kept]
        self.bounds()

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every live text for all ids of the query."""
        ids = np.unique(query)
        at = np.searchsorted(self.terms, ids)
        ids, at = ids[at < len(self.terms)], at[at < len(self.terms)]
        spans = [self.spans[i] for i in at[self.terms[at] == ids].tolist()]
        if not spans:
            return np.zeros(len(self.live))
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.live))


def fill(docs: list[np.ndarray], window: int = WINDOW, stats: Stats | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (text, from, to), which together hold every id once."""
    index, unused = Bm25(docs, stats or Stats.of(docs)), np.ones(len(docs), dtype=bool)
    out: list[list[tuple[int, int, int]]] = []
    at, rest = 0, None
    while True:
        if rest is None:
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                return out
            unused[at], rest = False, (at, 0)
        seed, start = rest
        taken = min(window, len(docs[seed]) - start)
        parts, room = [(seed, start, start + taken)], window - taken
        rest = (seed, start + taken) if start + taken < len(docs[seed]) else None
        if room:
            left = int(unused.sum())
            if left < len(index.live) * (1 - SPENT):
                index.keep(unused)
            scores = np.where(unused[index.live], index.scores(docs[seed]), -1.0)
            while room and left:
                place = int(scores.argmax())
                i, scores[place], left = int(index.live[place]), -1.0, left - 1
                cut = min(room, len(docs[i]))
                parts.append((i, 0, cut))
                unused[i], room = False, room - cut
                if cut < len(docs[i]):
                    rest = (i, cut)
        out.append(parts)


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Full stretches and tails of the texts."""
    rows = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_KEY)).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id())), F.lit(1 << 30)).alias("salt"),
        "text",
    )

    def cut(batches):
        encode = tokenizer(vocabulary).ids
        for batch in batches:
            out = []
            for doc, row, salt, text in zip(*(batch[c].tolist() for c in ("doc_id", "row", "salt", "text")), strict=True):
                ids = encode(text) + b"\0\0"
                n = len(ids) // 2
                out += [(doc, row, salt, a, n, ids[2 * a : 2 * (a + window)]) for a in range(0, n, window)]
            yield pd.DataFrame(out, columns=["doc_id", "row", "salt", "start", "doc_tokens", "ids"])

    return rows.mapInPandas(cut, PIECES)


def tail_stats(tails: DataFrame) -> Stats:
    """Summed by Spark; at most ``IDS`` + 2 rows reach the driver."""

    def count(batches):
        df, n, total = np.zeros(IDS, dtype=np.int64), 0, 0
        for batch in batches:
            docs = [np.frombuffer(x, "<u2") for x in batch["ids"]]
            for at in range(0, len(docs), BLOCK):
                df += np.bincount(counted(docs[at : at + BLOCK])[1], minlength=IDS)
            n, total = n + len(docs), total + sum(map(len, docs))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": [*at.tolist(), -1, -2], "n": [*df[at].tolist(), n, total]})

    got = {r["term"]: r["n"] for r in tails.select("ids").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total, df = got.pop(-1, 0), got.pop(-2, 0), np.zeros(IDS, dtype=np.int64)
    df[list(got)] = list(got.values())
    return Stats(n, total / n if n else 1.0, df)


class Routes:
    """The shard of each pair of telling ids; ``shards`` in all."""

    def __init__(self, tails: DataFrame, stats: Stats, shard_docs: int):
        def pairs(batches):
            for batch in batches:
                a, b = stats.telling([np.frombuffer(x, "<u2") for x in batch["ids"]])
                yield pd.DataFrame({"a": a, "b": b})

        counted = stored(tails.select("ids").mapInPandas(pairs, "a int, b int").groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
        groups = {r["a"]: r["n"] for r in counted.groupBy("a").agg(F.sum("n").alias("n")).collect()}  # at most IDS + 1
        hot = {(r["a"], r["b"]): r["n"] for r in counted.where(F.col("n") > shard_docs).collect()}  # at most tails / shard_docs
        for (a, _), n in hot.items():
            groups[a] -= n
        self.shards, room = 0, 0
        self.places: dict[int | tuple[int, int], tuple[int, int]] = {}  # first shard, number of shards
        for a, n in sorted(groups.items()):
            if n > shard_docs:
                self.take(a, n, shard_docs)
                room = 0
            else:
                if n > room:
                    self.shards, room = self.shards + 1, shard_docs
                self.places[a], room = (self.shards - 1, 1), room - n
        for key, n in sorted(hot.items()):
            self.take(key, n, shard_docs)
        self.shards = max(1, self.shards)

    def take(self, key, n: int, shard_docs: int) -> None:
        count = -(-n // shard_docs)
        self.places[key], self.shards = (self.shards, count), self.shards + count

    def shard(self, a: int, b: int, salt: int) -> int:
        own = self.places.get((a, b))
        first, count = own or self.places[a]
        return first + (salt if own else b * 0x9E3779B1 >> 7) % count


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit)."""
    cut = stored(pieces(docs, vocabulary or default_vocabulary(), window), "pieces", compression="zstd")
    tails = cut.where(F.octet_length("ids") < 2 * window)
    stats = tail_stats(tails)
    routes = Routes(tails, stats, shard_docs)

    def route(batches):
        for batch in batches:
            shard = (batch["salt"].to_numpy() + batch["start"].to_numpy()) % routes.shards
            ids = [np.frombuffer(x, "<u2") for x in batch["ids"]]
            ends = [i for i, x in enumerate(ids) if len(x) < window]
            a, b = stats.telling([ids[i] for i in ends])
            shard[ends] = [routes.shard(*k) for k in zip(a.tolist(), b.tolist(), batch["salt"].to_numpy()[ends].tolist(), strict=True)]
            yield batch.drop(columns="salt").assign(shard=shard.astype(np.int32))[["shard", "doc_id", "row", "start", "doc_tokens", "ids"]]

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "row", "start"], kind="stable")
        doc, start, total = (shard[c].tolist() for c in ("doc_id", "start", "doc_tokens"))
        ids = [np.frombuffer(x, "<u2") for x in shard["ids"]]
        out, number, base = [], 0, int(shard["shard"].iloc[0]) << 32
        ends = []
        for i, x in enumerate(ids):
            if len(x) == window:
                out.append((doc[i], start[i], window, total[i], base + number, 0, x.astype("<u4").tobytes()))
                number += 1
            else:
                ends.append(i)
        for parts in fill([ids[i] for i in ends], window, stats):
            offset = 0
            for t, a, b in parts:
                i = ends[t]
                out.append((doc[i], start[i] + a, b - a, total[i], base + number, offset, ids[i][a:b].astype("<u4").tobytes()))
                offset += b - a
            number += 1
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    packed = cut.mapInPandas(route, ROUTED).groupBy("shard").applyInPandas(one, PACKED)
    return packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_KEY)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
