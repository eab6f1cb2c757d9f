"""The search and clustering operators against brute force on small odd tables, and against their SQL."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import op11_topk as op11
from marlstone.llm import op12_clusters as op12
from marlstone.llm import op13_lexical as op13
from marlstone.llm import queries as llm

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("name", ["op11_topk", "op12_clusters", "op13_lexical"])
def test_sql(spark, sf_dir, name):
    from test_queries import TABLES, duckdb, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    assert rows(llm.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(llm.SQL[name]).df())


def _vectors(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(size=dims) * spread]) for i in range(n)]


def _brute_topk(rows, k):
    sound = [(key, [math.floor(64 * float(np.float32(x))) for x in v]) for key, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (q, a) in enumerate(sound):
        if q is None or q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), key is None, key or 0) for j, (key, b) in enumerate(sound) if j != i)
        out += [(q, r + 1, None if none else key, -s) for r, (s, none, key) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread, block, tasks", [(0.1, 7, 5), (1.0, 16384, 3), (300.0, 16384, 1), (90_000.0, 4, 2)])
def test_topk_equals_brute_force(spark, spread, block, tasks):
    rows = _vectors(120, 37, 5, spread)
    same = rows[0][1]
    rows += [(200 + i, same) for i in range(50)] + [(20, rows[3][1]), (20, rows[3][1]), (None, rows[2][1]), (40, []), (60, rows[5][1][:9])]
    rows += [(80, None), (100, [1.0, None]), (120, [NAN] * 37), (140, [INF] + [0.0] * 36)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], f"{VECTORS}, row string, key int").repartition(4)
    got = op11.top_k(table, F.col("key") % 20 == 0, k=7, query_block=block, tasks=tasks)
    assert sorted(map(tuple, got.collect()), key=str) == _brute_topk(rows, 7) and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_prunes_and_compacts(monkeypatch):
    r = np.random.default_rng(1)
    values = r.normal(size=(5000, 64)) * np.linspace(30, 1, 64)
    values = np.floor(values).astype(np.int64)
    search = op11.Search(values[:40], np.arange(40), 5)
    seen = []
    kept = np.einsum
    monkeypatch.setattr(op11.np, "einsum", lambda how, a, b: seen.append(len(a)) or kept(how, a, b))
    for at in range(0, 5000, 500):
        search.offer(values[at : at + 500], np.arange(at, at + 500), np.arange(at, at + 500))
    whole = values[:40] @ values.T
    whole[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    assert (search.score == np.sort(whole, axis=1)[:, :-6:-1]).all()
    assert seen and max(seen) < 0.06 * 40 * 500  # few pairs are finished one by one


def test_topk_of_few_and_none(spark):
    is_query = F.col("key") % 20 == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [0.5])], VECTORS)
    assert [tuple(r) for r in op11.top_k(two, is_query).collect()] == [(0, 1, 1, 64 * 32)]
    assert op11.top_k(two.where("vec_id = 0"), is_query).count() == 0
    assert op11.top_k(two.where("vec_id = 1"), is_query).count() == 0
    assert op11.top_k(two.where("false"), is_query).count() == 0


def _brute_clusters(rows, k, rounds):
    v = [(key, [math.floor(256 * float(np.float32(x))) for x in e]) for key, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"2:{'' if v[i][0] is None else v[i][0]}".encode()).hexdigest())
    c = [v[i][1] for i in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x: min((square(x, y), i) for i, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in v]
        for i in range(len(c)):
            if some := [x for (_, x), o in zip(v, own, strict=True) if o == i]:
                c[i] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    last = [near(x) for _, x in v]
    per = Counter()
    for d, i in last:
        per[i] += d
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((key, i, d, per[i], sum(per.values()), name[i]) for (key, _), (d, i) in zip(v, last, strict=True)), key=str)


@pytest.mark.parametrize("k, spread", [(12, 0.2), (12, 900.0), (400, 0.2)])
def test_clusters_equal_brute_force(spark, k, spread):
    rows = _vectors(90, 64, 3, spread)
    rows += [(300 + i, rows[4][1]) for i in range(40)] + [(None, rows[1][1]), (500, None), (501, [0.1] * 63), (502, [NAN] * 64), (503, [None] * 64), (504, [-INF] * 64)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{VECTORS}, cluster int, v string").repartition(5)
    got = op12.clusters(table, k=k, rounds=3)
    assert sorted(map(tuple, got.collect()), key=str) == _brute_clusters(rows, k, 3)


def test_clusters_odd(spark):
    none = spark.createDataFrame([], VECTORS)
    assert op12.clusters(none).count() == 0
    far = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], VECTORS)
    assert sorted((r["vec_id"], r["distance"]) for r in op12.clusters(far).collect()) == [(1, 0), (2, 0)]


def test_transform_is_exact():
    assert (op12.H @ op12.H.T == 64 * np.eye(64, dtype=np.int64)).all()
    assert ((np.diff(op12.H, axis=1) != 0).sum(axis=1) == np.arange(64)).all()
    r = np.random.default_rng(2)
    x, c = r.integers(-(1 << 24), 1 << 24, (300, 64)), r.integers(-(1 << 24), 1 << 24, (7, 64))
    c[5] = c[2]
    own, distance = op12.nearest(x, c)
    whole = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (own == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _brute_lexical(docs, items, k):
    bags = [Counter(_terms(t)) for _, t in docs]
    n_docs, total = sum(map(bool, bags)), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (key, _), bag in zip(docs, bags, strict=True):
            s = 0
            for t in set(_terms(text)):
                if bag[t]:
                    m = 50 + 50 * sum(bag.values()) * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if s > 0:
                scored.append((-s, key is None, key or 0))
        out += [(item, r + 1, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ODD_DOCS = [
    (1, "The cat, the CAT; the-cat!"), (2, "cat"), (3, None), (4, ""), (5, " \n\0\0 "), (6, "Ünï cødé ünï Ünï"), (7, "cat"), (7, "cat"), (None, "cat"), (8, "a" * 5000 + " cat " + "dog " * 20_000),
    (9, "concatenate catcat"), (10, "日本 語 cat日本"), (11, "x_y x y_"), (12, "the " * 300),
]
ODD_ITEMS = [(1, "cat dog"), (1, "cat dog"), (2, "The the THE"), (3, None), (4, "..."), (None, "ünï 日本 Ü"), (5, "absent"), (6, "x y x_y a" + " b" * 300)]


@pytest.mark.parametrize("block_items", [4096, 2])
def test_lexical_equals_brute_force(spark, monkeypatch, block_items):
    monkeypatch.setattr(op13, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(op13, "BATCH", 3)
    docs = spark.createDataFrame([(*r, 5) for r in ODD_DOCS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame([(*r, "x") for r in ODD_ITEMS], "item_id long, text string, rank string")
    got = op13.ranked_search(docs, items, k=4)
    assert sorted(map(tuple, got.collect()), key=str) == _brute_lexical(ODD_DOCS, ODD_ITEMS, 4)


def test_lexical_of_nothing(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert op13.ranked_search(docs.where("false"), items).count() == 0 and op13.ranked_search(docs, items.where("false")).count() == 0
    assert op13.ranked_search(docs.where("doc_id IN (3, 4)"), items).count() == 0
    assert op13.ranked_search(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_count_terms():
    for _, text in ODD_DOCS:
        assert op13.count_terms(op13.bounded(text)) == len(_terms(text)) and op13.terms(text) == _terms(text)
