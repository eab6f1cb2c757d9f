"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all item terms.

Documents have no index. An item block's distinct terms, each between two boundary characters, make one automaton; a document's
text, with every other character turned into a boundary, runs through it once, and each match is one occurrence of a
term. The first scan sums, in each task, how many documents hold each term, the documents with terms and their terms; a second one
scores: outputs of the automaton map to the items that hold the term, a batch's scores are one table of documents by items, and a
task keeps the best of each item. Those are ranked in two steps, first within salted groups of tasks, so no task sees what all tasks found
for an item.

The automaton is part of the task and bounded: items are dealt to blocks of about ``BLOCK_BYTES`` of terms and ``BLOCK_ITEMS`` items by hash, every block has its
own automaton and scans, and each item is whole in one block.

Defined results: null and empty texts have no terms and count in no statistic; items without terms, and documents that score 0, give no rows;
texts are scanned whole; repeated documents and items each count and are ranked on their own; equal scores go by ascending key, a missing key last;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 50
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 4096
#: Documents whose scores are held at a time, and groups of the first ranking.
BATCH, SALTS = 256, 64
LAST = np.iinfo(np.int64).max

BOUNDARY = "\0"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 0 for c in range(256))


def bounded(text: str | None) -> str:
    """The text in lower case (A-Z alone) with every ASCII character that stands in no term as a boundary, and one at each end."""
    return BOUNDARY + (text or "").encode(errors="surrogatepass").translate(_PLAIN).decode(errors="surrogatepass") + BOUNDARY


def terms(text: str | None) -> list[str]:
    return [t for t in bounded(text).split(BOUNDARY) if t]


def count_terms(text: str) -> int:
    """Terms of a bounded text, by the characters that follow a boundary."""
    inside = np.frombuffer(text.encode(errors="surrogatepass"), np.uint8) != 0
    return int((inside[1:] & ~inside[:-1]).sum())


def automaton(vocabulary: list[str]) -> ahocorasick.Automaton:
    """Gives the number of each term where it stands whole."""
    made = ahocorasick.Automaton()
    for i, t in enumerate(vocabulary):
        made.add_word(BOUNDARY + t + BOUNDARY, i)
    made.make_automaton()
    return made


_number = operator.itemgetter(1)


def found(machine: ahocorasick.Automaton, text: str) -> Counter:
    """How often each term of the automaton stands in a bounded text."""
    return Counter(map(_number, machine.iter(text)))


def statistics(docs: DataFrame, vocabulary: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each term of the vocabulary the documents that hold it."""

    def scan(batches):
        machine, df, n, total = automaton(vocabulary), np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                text = bounded(text)
                size = count_terms(text)
                if size:
                    df[list(found(machine, text))] += 1
                    n, total = n + 1, total + size
        some = np.flatnonzero(df)
        # two counts that stand for no term go first
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, total], df[some]]))], ["term", "n"])

    sums = docs.select("text").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block
    got = {r["term"]: r["n"] for r in sums}
    df = np.zeros(len(vocabulary), np.int64)
    for i, n in got.items():
        if i >= 0:
            df[i] = n
    return got.get(-2, 0), got.get(-1, 0), df


class Best:
    """The best documents so far of each item of a block: score, key and place among the block's items."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.score, self.key = np.zeros((items, k), np.int64), np.full((items, k), LAST)

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` of documents by items."""
        for i in np.flatnonzero((scores >= np.maximum(self.score[:, -1], 1)).any(axis=0)):
            new = np.flatnonzero(scores[:, i] >= max(self.score[i, -1], 1))
            score, key = np.concatenate([self.score[i], scores[new, i]]), np.concatenate([self.key[i], keys[new]])
            order = np.lexsort((key, -score))[: self.k]
            self.score[i], self.key[i] = score[order], key[order]


def best_of_block(docs: DataFrame, items: list[list[str]], k: int) -> DataFrame:
    """item (its place in ``items``), key, score: candidates for the ``k`` best documents of each item, some of each task."""
    vocabulary = sorted({t for ts in items for t in ts})
    place = {t: i for i, t in enumerate(vocabulary)}
    n_docs, n_terms, df = statistics(docs, vocabulary)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    holders: list[list[int]] = [[] for _ in vocabulary]
    for i, ts in enumerate(items):
        for t in ts:
            holders[place[t]].append(i)
    ends = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
    of_term = np.array([i for h in holders for i in h], np.int64)

    def scored(machine: ahocorasick.Automaton, text: str, row: np.ndarray) -> None:
        got = found(machine, text)
        if not got:
            return
        m = 50 + (50 * count_terms(text) * n_docs) // n_terms
        t, tf = np.fromiter(got.keys(), np.int64, len(got)), np.fromiter(got.values(), np.int64, len(got))
        part = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        many = ends[t + 1] - ends[t]
        # the items of all terms in one run: where each term's list begins, and the place within it
        at = np.repeat(ends[t] - np.concatenate([[0], many.cumsum()[:-1]]), many) + np.arange(many.sum())
        np.add.at(row, of_term[at], np.repeat(part, many))

    def search(batches):
        machine, best = automaton(vocabulary), Best(len(items), k)
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), np.asarray(batch["key"].fill_null(LAST))
            for lo in range(0, len(texts), BATCH):
                scores = np.zeros((len(texts[lo : lo + BATCH]), len(items)), np.int64)
                for i, text in enumerate(texts[lo : lo + BATCH]):
                    scored(machine, bounded(text), scores[i])
                best.offer(scores, keys[lo : lo + BATCH])
        i, c = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best.key[i, c]), pa.array(best.score[i, c])], ["item", "key", "score"])

    return docs.mapInArrow(search, "item long, key long, score long")


def item_blocks(items: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """item, block, id, terms (distinct): the items that have terms, stored with a number and a block for each; and how many blocks."""

    def cut(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([sorted(set(terms(t))) for t in batch["text"].to_pylist()], pa.list_(pa.string()))], ["id", "terms"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(cut, f"id {kind}, terms array<string>")
    rows = stored(rows.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))).cast("int")), blocks


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """item_key, rank, key, score: the ``k`` documents of greatest score above 0 for each item."""
    rows, blocks = item_blocks(items, item_key, text)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = []
    for b in range(blocks):
        block = rows.where(F.col("block") == b).orderBy("item").select("item", "terms").collect()  # BLOCK_BYTES or one item's terms
        if not block:
            continue
        number = rows.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(block)], "item long, number long")
        parts.append(best_of_block(docs, [r["terms"] for r in block], k).join(F.broadcast(number), "item").select(F.col("number").alias("item"), "key", "score"))
    if not parts:
        return rows.select(F.col("id").alias(item_key), F.lit(0).alias("rank"), F.lit(None).cast(kind).alias(key), F.lit(0).cast("long").alias("score")).where("false")
    every = reduce(DataFrame.unionByName, parts).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = [F.desc("score"), F.asc("key")]
    some = every.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    named = F.when(F.col("key") < LAST, F.col("key").cast(kind))
    return ranked.join(rows.select("item", "id"), "item").select(F.col("id").alias(item_key), "rank", named.alias(key), "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_SQL_TERMS}) AS t FROM benchmark),
wanted AS (SELECT i, unnest(t) AS term FROM i),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY 1),
m AS (SELECT r, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, total WHERE len(t) > 0),
s AS (SELECT i, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM tf JOIN m USING (r) JOIN w USING (term) JOIN wanted USING (term) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k JOIN i USING (i) WHERE rank <= 50"""
