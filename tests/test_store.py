"""The store on hand-made rows, and digest trees on small snapshots."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import digests as dg
from marlstone.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store", buckets=3)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merge_keeps_create_only_fields_and_runs_again_alike(spark, store):
    units = "unit_id string, subject_id string, name string, created int, updated int"
    store.merge("units", spark.createDataFrame([(f"u{i}", "s", f"n{i}", 1, 1) for i in range(9)], units))
    second = spark.createDataFrame([("u3", "s", "other", 2, 2), ("v", "s", "new", 2, 2)], units)
    for _ in range(2):
        store.merge("units", second)
        got = rows(store.read("units"), "unit_id", "name", "created", "updated")
        assert got == sorted([(f"u{i}", f"n{i}", 1, 1) for i in range(9) if i != 3] + [("u3", "other", 1, 2), ("v", "new", 2, 2)])
    # fields that a merge doesn't carry stay
    store.merge("units", spark.createDataFrame([("u4", "short")], "unit_id string, name string"))
    assert rows(store.read("units").where("unit_id = 'u4'"), "name", "created", "updated") == [("short", 1, 1)]


def test_removal_empties_buckets(spark, store):
    store.merge("concepts", spark.createDataFrame([(f"c{i}", 1) for i in range(20)], "concept_id string, created int"))
    store.remove("concepts", spark.createDataFrame([(f"c{i}",) for i in range(19)], "concept_id string"))
    assert rows(store.read("concepts"), "concept_id") == [("c19",)]
    store.remove("concepts", spark.createDataFrame([("absent",)], "concept_id string"))
    store.remove("pages", spark.createDataFrame([("p",)], "page_id string"))  # there is no such table yet
    assert store.read("concepts").count() == 1


def test_orphans_go_level_by_level(spark, store):
    store.merge("grades", spark.createDataFrame([("g1", "x", 1), ("g2", "y", 1)], "grade_id string, name string, created int"))
    store.merge("subjects", spark.createDataFrame([("g1:s", "g1", 1), ("g2:s", "g2", 1)], "subject_id string, grade_id string, created int"))
    store.merge("units", spark.createDataFrame([("u1", "g1:s", 1), ("u2", "g2:s", 1)], "unit_id string, subject_id string, created int"))
    store.merge("documents", spark.createDataFrame([("d1", "u1"), ("d2", "u2")], "document_id string, unit_id string"))
    store.merge("concepts", spark.createDataFrame([("k1", 1), ("k2", 1)], "concept_id string, created int"))
    store.merge("mentions", spark.createDataFrame([("m1", "d1", "k1"), ("m2", "d2", "k2"), ("m3", "d2", "k1")], "mention_id string, document_id string, concept_id string"))
    assert store.sweep() == {}
    store.remove("documents", spark.createDataFrame([("d2",)], "document_id string"))
    assert store.sweep() == {"mentions": 2, "concepts": 1, "units": 1, "subjects": 1, "grades": 1}
    assert [rows(store.read(t), k) for t, k in (("grades", "grade_id"), ("units", "unit_id"), ("mentions", "mention_id"), ("concepts", "concept_id"))] == [[("g1",)], [("u1",)], [("m1",)], [("k1",)]]


def test_only_what_is_not_complete_is_pending(spark, store):
    docs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "document_id string, digest string")
    assert store.pending(docs, "v1").count() == 4
    store.mark_complete(spark.createDataFrame([("a", "1", "v1", 3), ("b", "0", "v1", 3), ("c", "1", "v0", 3), ("d", "1", "v1", 0)], "document_id string, digest string, version string, n_chunks int"))
    assert rows(store.pending(docs, "v1"), "document_id") == [("b",), ("c",), ("d",)]


def test_content_is_replaced_and_provenance_refreshed(spark, store):
    chunks = "chunk_id string, document_id string, source string, text string"
    store.merge("documents", spark.createDataFrame([("a", "u", "old"), ("b", "u", "old")], "document_id string, unit_id string, source string"))
    store.merge("chunks", spark.createDataFrame([("a1", "a", "old", "x"), ("a2", "a", "old", "y"), ("b1", "b", "old", "z")], chunks))
    store.replace_content(spark.createDataFrame([("a",)], "document_id string"), {"chunks": spark.createDataFrame([("a1", "a", "old", "new")], chunks)})
    assert rows(store.read("chunks"), "chunk_id", "text") == [("a1", "new"), ("b1", "z")]
    store.refresh(spark.createDataFrame([("b", "fresh")], "document_id string, source string"), ("source",))
    assert rows(store.read("chunks"), "chunk_id", "source", "text") == [("a1", "old", "new"), ("b1", "fresh", "z")]
    assert rows(store.read("documents"), "document_id", "unit_id", "source") == [("a", "u", "old"), ("b", "u", "fresh")]


CHUNKS = "chunk_id string, chunk_index int, page_start int, document_id string, unit_id string, text string"


def test_changes_are_found_from_the_top_down(spark):
    old = [(f"{d}:c{i}", i, 1 + i // 2, d, u, f"{d}{i}") for d, u in (("d1", "u1"), ("d2", "u1"), ("d3", "u2"), ("d4", "u3")) for i in range(4)]
    new = [r if r[0] != "d2:c3" else (*r[:5], "changed") for r in old if r[3] != "d3"] + [("d5:c0", 0, 1, "d5", "u3", None)]
    a, b = (dg.levels(spark.createDataFrame(r, CHUNKS)) for r in (old, new))
    assert rows(dg.changes(a, b).where("level <> 'chunk' AND level <> 'page'"), "level", "id", "change") == [
        ("document", "d2", "changed"), ("document", "d3", "removed"), ("document", "d5", "added"), ("unit", "u1", "changed"), ("unit", "u2", "removed"), ("unit", "u3", "changed"),
    ]
    assert rows(dg.changes(a, b).where("id LIKE 'd2%'"), "level", "id", "change") == [("chunk", "d2:c3", "changed"), ("document", "d2", "changed"), ("page", "d2:p0002", "changed")]
    assert dg.changes(a, a).count() == 0
    # two chunks that change places make another digest
    swapped = [(*r[:5], {"d10": "d11", "d11": "d10"}.get(r[5], r[5])) for r in old]
    assert dg.changes(a, dg.levels(spark.createDataFrame(swapped, CHUNKS))).where(F.col("level") == "document").count() == 1
