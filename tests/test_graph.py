"""Seeds, expansion and trace on hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph as gr

CHUNKS = "chunk_id string, section_id string, document_id string, unit_id string, section_title string, chunk_index int"
SEEDS = "query_id long, seed_id string, weight double, seed_rank int"
ROWS = (
    "query_id long, seed_id string, weight double, relation string, chunk_id string, via string, position int, inside boolean, is_primary boolean, detail string, "
    "seq struct<diagnostic:boolean,seed_rank:int,relation_number:int,position:int>"
)


def test_seeds_weigh_their_best_rank(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 4)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "w", 3), (2, "v", 4)], "query_id long, chunk_id string, rank int")
    got = [tuple(r) for r in gr.select_seeds([a, b], limit=3).orderBy("query_id", "seed_rank").collect()]
    assert got == [(1, "x", 1.0, 1), (1, "y", 1.0, 2), (1, "w", 0.333333, 3), (2, "v", 0.25, 1), (2, "z", 0.25, 2)]


@pytest.fixture
def graph(spark):
    chunks = spark.createDataFrame(
        [("a0", "s1", "a", "u", "T", 0), ("a1", "s1", "a", "u", "T", 1), ("a2", "s2", "a", "u", "V", 2), ("b0", "t1", "b", "u", "T", 0), ("c0", "r1", "c", "w", "T", 0), ("d0", "q1", "d", "w", "Z", 0)], CHUNKS
    )
    pages = spark.createDataFrame([("a0", "p1"), ("a1", "p1"), ("a1", "p2"), ("a2", "p2"), ("b0", "p3")], "chunk_id string, page_id string")
    mentions = spark.createDataFrame([("a0", "ion"), ("c0", "ion"), ("d0", "acid"), ("c0", "acid"), ("b0", "ion")], "chunk_id string, concept string")
    return chunks, pages, mentions


def test_expansion_by_relation(spark, graph):
    seeds = spark.createDataFrame([("a0",), ("a0",)], "seed_id string")
    got = [tuple(r)[1:] for r in gr.expand(seeds, *graph).collect()]
    want = [("SAME_SECTION", "a1", None, 1), ("ADJACENT", "a1", None, 1), ("SAME_PAGE", "a1", "p1", 1), ("SHARED_CONCEPT", "b0", "ion", 1), ("SHARED_CONCEPT", "c0", "ion", 2), ("SAME_LESSON", "b0", None, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    near = gr.expand(seeds, *graph, relations=gr.enabled(1))
    assert {r["relation"] for r in near.collect()} == {"SAME_SECTION", "ADJACENT", "SAME_PAGE"}
    assert gr.expand(seeds, *graph, limit=1).where("relation = 'SHARED_CONCEPT'").count() == 1
    left_out = {r["relation"] for r in gr.relation_decisions(spark, 1).where("reason = 'RELATION_DISABLED_BY_DEPTH'").collect()}
    assert left_out == {"SHARED_CONCEPT", "SAME_LESSON"}
    assert [tuple(r)[1:] for r in gr.neighbourhood(gr.expand(seeds, *graph)).collect()] == [("a1", "ADJACENT,SAME_PAGE,SAME_SECTION", 1)]


def test_weights_multiply_level_by_level(spark, graph):
    seeds = spark.createDataFrame([(1, "a0", 0.5, 1)], SEEDS)
    got = {r["chunk_id"]: (r["level"], r["weight"]) for r in gr.traverse(seeds, lambda s: gr.expand(s, *graph)).collect()}
    assert got == {"a0": (0, 0.5), "a1": (1, 0.5), "b0": (1, 0.3), "c0": (1, 0.3), "a2": (2, 0.45), "d0": (2, 0.18)}
    assert {r["chunk_id"] for r in gr.traverse(seeds, lambda s: gr.expand(s, *graph), levels=1, limit=1).collect()} == {"a0", "a1"}


def path(seed, relation, chunk, position=1, via=None, primary=True, inside=True, rank=1, query=1, weight=0.5, detail=""):
    return (query, seed, weight, relation, chunk, via, position, inside, primary, detail, (not primary, rank, gr.RELATION_NUMBER[relation], position))


@pytest.fixture
def traced(spark):
    rows = [
        path("s", "SAME_SECTION", "x"), path("s", "SAME_PAGE", "x", via="p1"), path("s", "SAME_PAGE", "y", 2, via="p1"), path("s", "ADJACENT", "t"), path("s", "ADJACENT", "t", 2), path("s", "SAME_SECTION", "y", 3), path("s", "SAME_SECTION", "y", 3),
        path("s", "SHARED_CONCEPT", "far", 4, via="ion", primary=False, inside=False, detail="grade 9 > 5"), path("s", "SHARED_CONCEPT", "many", 9, via="ion", primary=False), path("s", "SHARED_CONCEPT", "late", 51, via="ion", primary=False),
        path("s", "SAME_LESSON", "x", 1, primary=False),
    ]
    seeds = spark.createDataFrame([(1, "s", 0.5, 1), (1, "t", 0.25, 2)], SEEDS)
    selected = spark.createDataFrame([(1, "x")], "query_id long, chunk_id string")
    return gr.classify(spark.createDataFrame(rows, ROWS), seeds, selected), seeds


def test_reasons_in_their_order(traced):
    rows, _ = traced
    got = [(r["relation"], r["chunk_id"], r["reason"]) for r in rows.orderBy("seq").collect()]
    assert got == [
        ("SAME_SECTION", "x", "SELECTED_GRAPH_CANDIDATE"), *[("SAME_SECTION", "y", r) for r in sorted(r[2] for r in got if r[:2] == ("SAME_SECTION", "y"))[::-1]],
        ("ADJACENT", "t", "SEED_NODE"), ("ADJACENT", "t", "SEED_NODE"), ("SAME_PAGE", "x", "DUPLICATE_PATH"), ("SAME_PAGE", "y", "GRAPH_TOP_K_CUTOFF"),
        ("SHARED_CONCEPT", "far", "METADATA_FILTER_MISMATCH"), ("SHARED_CONCEPT", "many", "PER_RELATION_LIMIT"), ("SHARED_CONCEPT", "late", "TRACE_SAFETY_LIMIT"), ("SAME_LESSON", "x", "DUPLICATE_PATH"),
    ]
    assert sorted(r[2] for r in got if r[:2] == ("SAME_SECTION", "y")) == ["DUPLICATE_PATH", "GRAPH_TOP_K_CUTOFF"]
    assert [(r["detail"], r["contribution"]) for r in rows.where("chunk_id IN ('far', 'late')").orderBy("seq").collect()] == [("grade 9 > 5", 0.3), (None, 0.0)]


def test_nodes_and_edges(spark, traced):
    rows, seeds = traced
    chunk = "query_id long, chunk_id string"
    hubs = spark.createDataFrame([(1, "s", "heat", 900), (1, "t", "heat", 900)], "query_id long, seed_id string, concept string, mention_count long")
    ranked = spark.createDataFrame([(1, "x", 0.95)], f"{chunk}, score double")
    args = (rows, seeds, hubs, ranked, spark.createDataFrame([(1, "x"), (1, "s")], chunk), spark.createDataFrame([(1, "s")], chunk))
    nodes = {r["node_id"]: r for r in gr.trace_nodes(*args).collect()}
    of = lambda n, *fields: tuple(nodes[n][f] for f in fields)
    assert of("x", "kind", "status", "reasons", "graph_score", "n_told", "entered_fusion") == ("candidate", "accepted", "SELECTED_GRAPH_CANDIDATE,DUPLICATE_PATH", 0.95, 3, True)
    assert of("s", "kind", "status", "visual", "seed_weight", "final_evidence") == ("seed", "evidence", "evidence", 0.5, True)
    assert of("t", "kind", "status", "reasons", "seed_weight") == ("seed", "seed", "SEED_NODE", 0.25)
    assert of("far", "status", "visual") == ("ignored", "metadata_mismatch")
    assert of("p1", "label", "kind", "via_for") == ("Page", "context", "SAME_PAGE") and of("concept:ion", "label", "status") == ("Concept", "context")
    assert of("concept:heat", "kind", "status", "reasons", "mention_count") == ("hub", "ignored", "HUB_CONCEPT_EXCLUDED", 900)
    assert {r["node_id"] for r in gr.trace_nodes(*args, most=3).collect()} == {"s", "t", "concept:heat"}
    edges = {(r["source"], r["target"], r["relation"]): (r["physical"], r["accepted"], r["n_paths"]) for r in gr.trace_edges(rows, hubs).collect()}
    assert edges[("s", "x", "SAME_SECTION")] == (True, True, 1) and edges[("s", "x", "SAME_LESSON")] == (False, False, 1)
    assert edges[("s", "p1", "ON_PAGE")] == (True, False, 2) and edges[("p1", "y", "ON_PAGE")] == (True, False, 1)
    assert edges[("s", "concept:ion", "MENTIONS")] == (True, False, 3) and edges[("t", "concept:heat", "MENTIONS")] == (True, False, 1)


def test_scope_of_the_request(spark):
    paths = spark.createDataFrame([("s", "ADJACENT", c, None, i + 1) for i, c in enumerate("abcde")], "seed_id string, relation string, chunk_id string, via string, position int")
    scope = spark.createDataFrame(
        [("a", 5, "science", "student_evidence"), ("b", 6, "science", None), ("c", None, "physics", None), ("d", 4, "mathematics", None), ("e", 5, "science", "evaluation_only")],
        "chunk_id string, grade int, subject string, content_partition string",
    )
    requests = spark.createDataFrame([(1, 5, "science")], "query_id long, q_grade int, q_subject string")
    seeds = spark.createDataFrame([(1, "s", 1.0, 1)], SEEDS)
    got = {r["chunk_id"]: (r["inside"], r["is_primary"], r["detail"]) for r in gr.requested(paths, seeds, scope, requests, per_relation=4).collect()}
    assert got == {
        "a": (True, True, ""), "b": (False, False, "grade 6 > 5"), "c": (False, False, "grade none > 5; subject physics not in lineage science"),
        "d": (False, False, "subject mathematics not in lineage science"), "e": (True, False, ""),
    }
    ranked = gr.graph_ranked(gr.requested(paths, seeds, scope, requests), seeds).collect()
    assert [(r["chunk_id"], r["score"], r["path"]) for r in ranked] == [("a", 0.9, "ADJACENT from s")]
    assert gr.graph_ranked(gr.requested(paths, seeds, scope, requests).where(F.lit(False)), seeds).count() == 0


def test_scores_halfway_round_as_in_sql(spark):
    paths = [path("a", "SHARED_CONCEPT", "x", via="ion", rank=1, weight=1.0), path("b", "SHARED_CONCEPT", "x", via="ion", rank=2, weight=0.5), path("c", "SAME_LESSON", "x", rank=3, weight=0.166667)]
    seeds = spark.createDataFrame([(1, s, 1.0, 1) for s in "abc"], SEEDS)
    for rows in (paths, paths[::-1]):
        # 0.6 + 0.3 + 0.0833335, added in the order of arrival, lies just below the half; added the other way it lies on it
        assert [r["score"] for r in gr.graph_ranked(spark.createDataFrame(rows, ROWS), seeds).collect()] == [0.983333]
    lesson = spark.createDataFrame([("a", "SAME_LESSON", "x")], "seed_id string, relation string, chunk_id string")
    front = spark.createDataFrame([(1, "a", 0.128571, 1)], SEEDS)
    assert [r["weight"] for r in gr.traverse(front, lambda s: lesson.join(s, "seed_id"), levels=1).where("level = 1").collect()] == [0.064285]
