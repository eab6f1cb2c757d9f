"""The channels of one scan against those of postings, and queries that work without a row for each posting or mention."""

import pytest

from marlstone.operators import lexical as lx
from marlstone.operators import retrieval as rt
from marlstone.plans import queries as q

TEXTS = [
    ("b", "the acid and the base and acid"), ("a", "acid base"), ("c", "base acid"), ("é", "Base! acid? heat"), ("d", ""), ("e", None), ("f", "heat flows; heat ACID stays"), ("g", "nothing here"), ("h", "acid base"),
]


@pytest.mark.parametrize("pairs, questions, step", [(100_000, 4096, 1 << 20), (2, 4096, 5), (100_000, 1, 1)])
def test_channels_of_one_scan(spark, monkeypatch, pairs, questions, step):
    monkeypatch.setattr(lx, "QUERY_ROWS", pairs)
    monkeypatch.setattr(lx, "BLOCK_QUERIES", questions)
    monkeypatch.setattr(lx, "STEP", step)
    docs = spark.createDataFrame(TEXTS, "chunk_id string, text string").repartition(3)
    wanted = spark.createDataFrame([(1, "acid"), (1, "base"), (1, "absent"), (2, "heat"), (3, "absent"), (4, "acid"), (4, "heat"), (4, "base")], "query_id long, term string")
    got = lx.channels(docs, wanted, lx.term_counts(docs), "chunk_id", 3)
    for name, want in (("fulltext", rt.bm25(docs, wanted, "chunk_id", 3)), ("coverage", rt.coverage(docs, wanted, "chunk_id", 3))):
        rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
        assert rows(got[name]) == rows(want)
    assert not lx.channels(docs.limit(0), wanted, lx.term_counts(docs.limit(0)), "chunk_id")["fulltext"].count()


GRAPH = (
    "graph_seeds", "chunk_evidence", "trace_diagnostics", "expand_union", "chunk_candidates", "trace_counters", "trace_reasons", "graph_neighbourhood", "trace_nodes", "trace_edges", "graph_traverse", "trace_hubs",
)


@pytest.mark.parametrize("name", GRAPH)
def test_no_row_for_each_posting_or_mention(spark, sf_dir, monkeypatch, name):
    def made(*_, **__):
        raise AssertionError("a row for each posting or mention of the whole table")

    monkeypatch.setattr(rt, "postings", made)
    monkeypatch.setattr(q, "_mentions", made)
    # the smallest tables have no hub
    assert (q.QUERIES[name](spark, sf_dir).count() > 0) == (name != "trace_hubs")
