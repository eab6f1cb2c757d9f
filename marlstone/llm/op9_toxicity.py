"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts gives the examples. Every term of theirs is kept. A term weighs
(1 + log count) * idf, with document frequencies counted over all documents, times 1 + ``CONTRAST`` * chi-square of its
presence against the labels in the sample: without that factor, what a text is about hides how it speaks.

The examples form a sparse inverted index, cut into blocks of ``BLOCK`` examples. Each list knows its greatest weight in
each block; their sum bounds what any example there can score. The blocks of greatest bound are read first, and others
only where their bound reaches the last place, so skipping changes no result. Neighbours vote by similarity; votes of examples left out of their own vote
are mapped to probabilities by isotonic regression on the sample.

Bound: ``SAMPLE`` texts of each label by order of a hash of their key. Every text is scored whole.

Defined results: null, empty and other texts without any known term score the label's share; rows are
scored alone, so repeated ones score alike; ties among neighbours go to the earlier example; of a key or a text with both labels
1 holds; a text of any length is read whole; extra columns are ignored, whatever their names; without labels of both kinds every score is 0,
or 1 where only label 1 occurs; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_held_out, stored, table

SAMPLE, CONTRAST = 1000, 0.1
NEIGHBOURS, BLOCK = 15, 64
#: Blocks of greatest bound that are read before the others are held against the last place.
FIRST = 2
#: A list of more than one in so many examples is kept in full width; queries in a batch.
FREQUENT, BATCH = 10, 64
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
WORD = re.compile(r"[^\W_]+")


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic: at most ``SAMPLE`` of each label; equal texts once."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"), FOLDS, HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_order", F.xxhash64(F.lit(9), "doc_id"))
    some = [known.where(F.col("toxic") == y).orderBy("_order", "doc_id").limit(SAMPLE) for y in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]).select("doc_id", "toxic"))  # at most 2 * SAMPLE rows
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(picked, "doc_id")
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))


class Vocabulary:
    """Terms with their weights."""

    def __init__(self, places: dict[str, int], weight: np.ndarray):
        self.places, self.weight = places, weight

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places, in order, and weights of unit length."""
        place = self.places.get
        at = np.fromiter((place(t, -1) for t in counts), np.int64, len(counts))
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        at, c = at[order], np.fromiter(counts.values(), np.float64, len(counts))[order]
        raw = (1 + np.log(c)) * self.weight[at]
        return at, raw / (np.sqrt((raw * raw).sum()) or 1.0)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first`` and have ``n`` members, one after the other."""
    ends = n.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


class Index:
    """Block-max inverted index over unit vectors (places, weights) of the examples.

    Lists that hold at least one of ``FREQUENT`` examples are kept in full width, so that a batch of queries reads them
    as one matrix product; the others are sparse, and their blocks are skipped where the bounds allow.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        # examples of alike heaviest terms share blocks, which keeps the bounds of the others low
        heaviest = [(int(at[w.argmax()]), -float(w.max())) if len(at) else (terms, 0.0) for at, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: heaviest[i])
        self.blocks = -(-len(order) // BLOCK)
        self.examples = np.array(order + [-1] * (self.blocks * BLOCK - len(order)), dtype=np.int64).reshape(self.blocks, BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by_term = np.lexsort((row, term))
        term, row, weight = term[by_term], row[by_term], weight[by_term]
        frequent = np.flatnonzero(np.bincount(term, minlength=terms) * FREQUENT >= max(len(order), BLOCK))
        self.wide = np.full(terms, -1)
        self.wide[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK))
        full = self.wide[term] >= 0
        self.dense[self.wide[term[full]], row[full]] = weight[full]
        term, self.row, self.weight = term[~full], row[~full].astype(np.int32), weight[~full]
        # a run is the part of a sparse list in one block
        new = np.flatnonzero(np.diff(term * (self.blocks + 1) + self.row // BLOCK, prepend=-1))
        self.run_first, self.run_n = new, np.diff(new, append=len(term))
        self.run_block = (self.row[new] // BLOCK).astype(np.int32)
        self.run_max = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.list_first = np.searchsorted(term[new], np.arange(terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: range | None = None) -> list[list[tuple[float, int]]]:
        """For each query (cosine, example) of the nearest with a cosine above 0, best first; ``without`` names an example each leaves out."""
        wanted = np.zeros((len(queries), len(self.dense)))
        for i, (at, w) in enumerate(queries):
            full = self.wide[at] >= 0
            wanted[i, self.wide[at[full]]] = w[full]
        known = (wanted @ self.dense).reshape(len(queries), self.blocks, BLOCK)
        return [self.one(at, w, known[i], -1 if without is None else without[i]) for i, (at, w) in enumerate(queries)]

    def one(self, at: np.ndarray, w: np.ndarray, known: np.ndarray, without: int) -> list[tuple[float, int]]:
        n = self.list_first[at + 1] - self.list_first[at]
        runs, by = spread(self.list_first[at], n), np.repeat(w, n)
        block = self.run_block[runs]
        bound = np.bincount(block, by * self.run_max[runs], self.blocks) + (known.max(axis=1) if self.blocks else 0)
        early = np.zeros(self.blocks, dtype=bool)
        early[np.argsort(-bound, kind="stable")[:FIRST]] = True
        near = self.best(*self.read(runs, by, block, known, early), without)
        least = near[-1][0] if len(near) == NEIGHBOURS else 0.0
        more = (bound >= least - 1e-8) & (bound > 0) & ~early
        if not more.any():
            return near
        # read again with the first blocks, so that the last place is found among all
        return self.best(*self.read(runs, by, block, known, early | more), without)

    def read(self, runs: np.ndarray, by: np.ndarray, block: np.ndarray, known: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of some blocks with their whole cosines, rounded so that alike examples tie."""
        keep = some[block]
        runs, by = runs[keep], by[keep]
        n = self.run_n[runs]
        at = spread(self.run_first[runs], n)
        rare = np.bincount(self.row[at], np.repeat(by, n) * self.weight[at], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        return self.examples[some].ravel(), np.round(known[some] + rare[some], 9).ravel()

    def best(self, examples: np.ndarray, scores: np.ndarray, without: int) -> list[tuple[float, int]]:
        held = (scores > 0) & (examples >= 0) & (examples != without)
        examples, scores = examples[held], scores[held]
        if len(scores) > NEIGHBOURS:  # only what reaches the last place, ties included
            top = scores >= np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS]
            examples, scores = examples[top], scores[top]
        order = np.lexsort((examples, -scores))[:NEIGHBOURS]
        return list(zip(scores[order].tolist(), examples[order].tolist(), strict=True))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (upper ends of x, value) of the weighted rising fit, by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    pool: list[list[float]] = []
    for i in order:
        pool.append([x[i], y[i] * w[i], w[i]])
        while len(pool) > 1 and (pool[-2][0] == pool[-1][0] or pool[-2][1] / pool[-2][2] >= pool[-1][1] / pool[-1][2]):
            last = pool.pop()
            pool[-1] = [last[0], pool[-1][1] + last[1], pool[-1][2] + last[2]]
    return np.array([p[0] for p in pool]), np.array([p[1] / p[2] for p in pool])


class Model(NamedTuple):
    """What scoring needs; without ``vocabulary`` every text scores ``base``."""

    base: float
    vocabulary: Vocabulary | None = None
    index: Index | None = None
    keys: np.ndarray | None = None
    toxic: np.ndarray | None = None
    weights: np.ndarray | None = None
    ends: np.ndarray | None = None
    values: np.ndarray | None = None

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s * self.weights[i] for s, i in near)
        return sum(s * self.weights[i] for s, i in near if self.toxic[i]) / total

    def judge(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        """For each text its score, and the three nearest examples as doc_id:label:cosine."""
        if self.vocabulary is None:
            return [(self.base, None)] * len(texts)
        out = []
        for near in self.index.nearest([self.vocabulary.vector(term_counts(t)) for t in texts]):
            rate = float(self.values[min(np.searchsorted(self.ends, self.vote(near)), len(self.values) - 1)]) if near else self.base
            out.append((rate, ",".join(f"{self.keys[i]}:{int(self.toxic[i])}:{s:.3f}" for s, i in near[:3]) or None))
        return out


def term_counts(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def document_frequencies(docs: DataFrame, places: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and how many of them hold each term; counted in the tasks, summed by Spark."""
    known = docs.sparkSession.sparkContext.broadcast(places)

    def count(batches):
        df, n = np.zeros(len(known.value), dtype=np.int64), 0
        for batch in batches:
            place = known.value.get
            for text in batch["text"].tolist():
                got = [p for t in set(WORD.findall((text or "").lower())) if (p := place(t)) is not None]
                df[got] += 1
            n += len(batch)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": [*at.tolist(), -1], "n": [*df[at].tolist(), n]})

    got = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(got["term"].tolist(), got["n"].tolist(), strict=True))
    total, df = counts.pop(-1, 0), np.zeros(len(places))
    df[list(counts)] = list(counts.values())
    return int(total), df


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the sample; what reaches the driver is bounded by it."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    whole = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = stored(labelled_sample(docs, labels), "toxic")

    def count(batches):
        for batch in batches:
            found = [term_counts(t) for t in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "t": [list(x) for x in found], "n": [list(x.values()) for x in found]})

    rows = sorted(sample.mapInPandas(count, "doc_id long, toxic int, t array<string>, n array<int>").collect(), key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] for r in rows], dtype=bool)
    pos, neg = int(toxic.sum()), int((~toxic).sum())
    if not pos or not neg:
        return Model(float(bool(pos)))
    counts = [dict(zip(r["t"], r["n"], strict=True)) for r in rows]
    places = {t: i for i, t in enumerate(sorted({t for x in counts for t in x}))}
    n, df = document_frequencies(docs, places)
    have, among = np.zeros(len(places)), np.zeros(len(places))
    for x, y in zip(counts, toxic, strict=True):
        at = [places[t] for t in x]
        have[at] += 1
        among[at] += y
    every, b = float(len(rows)), have - among
    chi = every * (among * (neg - b) - b * (pos - among)) ** 2 / np.maximum(have * (every - have) * pos * neg, 1)
    vocabulary = Vocabulary(places, np.log(1 + n / (1 + df)) * (1 + CONTRAST * chi))
    vectors = [vocabulary.vector(x) for x in counts]
    weights = np.where(toxic, 1.0, (whole[0] / neg) / (whole[1] / pos))
    base = float(weights[toxic].sum() / weights.sum())
    model = Model(base, vocabulary, Index(vectors, len(places)), np.array([r["doc_id"] for r in rows]), toxic, weights)
    near = [x for i in range(0, len(vectors), BATCH) for x in model.index.nearest(vectors[i : i + BATCH], range(i, i + BATCH))]
    linked = np.array([bool(x) for x in near])
    if not linked.any():
        return Model(base)
    votes = np.array([model.vote(x) for x in near if x])
    ends, values = isotonic(votes, toxic[linked].astype(float), weights[linked])
    return model._replace(ends=ends, values=values)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with score, predicted and evidence (the nearest examples)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def rate(batches):
        for batch in (whole.slice(i, BATCH) for whole in batches for i in range(0, whole.num_rows, BATCH)):
            judged = shared.value.judge(batch.column("_text").to_pylist())
            out = [s for s, _ in judged]
            new = [pa.array(out, pa.float64()), pa.array([int(s >= CUT) for s in out], pa.int32()), pa.array([w for _, w in judged], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, "score", "predicted", "evidence"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(rate, f"{fields}, score double, predicted int, evidence string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", is_held_out(F.col("doc_id"), FOLDS, HELD_OUT))
