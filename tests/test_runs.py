"""Runs in event time: a stream in several batches, with late, repeated and shuffled events, against the table and by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.streaming import runs

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, hours, user, kind):
    return (i, START + timedelta(hours=hours), user, kind, 1.0, None)


def write(spark, path, batches):
    """One file for each batch, in the order in which the stream takes them."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_stream_of_batches_equals_table(spark, tmp_path):
    batches = [
        [event(2, 3, 1, "click"), event(1, 1, 1, "signup"), event(3, 3, 2, "view"), event(3, 3, 2, "view")],
        [event(5, 30, 1, "purchase"), event(3, 3, 2, "view"), event(4, 29, 1, None), event(6, 30, 3, "error")],
        [event(9, 60, 1, "view"), event(8, 59, 2, "error"), event(8, 59, 2, "error")],
        [event(10, 61, 1, "view"), event(11, 70, 9, "view"), (12, None, 1, "view", 1.0, None), (13, START, None, "view", 1.0, None)],
    ]
    got = sorted(map(tuple, runs.run_to_end(write(spark, tmp_path / "in", batches)).collect()), key=str)
    flat = spark.createDataFrame([e for b in batches for e in b], SCHEMA)
    assert got == sorted(map(tuple, runs.frames(flat).collect()), key=str)
    hour = lambda h: int((START - datetime(1970, 1, 1)).total_seconds() + h * 3600) * 1_000_000
    first = sorted(r for r in got if r[0] == 1)
    assert first == [
        (1, 0, 0, "event", hour(1), "signup"), (1, 0, 1, "event", hour(3), "click"), (1, 0, 2, "keep_alive", hour(15), None), (1, 0, 3, "keep_alive", hour(27), None),
        (1, 0, 4, "event", hour(29), None), (1, 0, 5, "event", hour(30), "purchase"), (1, 0, 6, "completed", hour(30), "signup click  purchase"),
        (1, 1, 0, "event", hour(60), "view"), (1, 1, 1, "event", hour(61), "view"),
    ]
    assert [r[3] for r in sorted(r for r in got if r[0] == 2)] == ["event"] + ["keep_alive"] * 4 + ["event", "failed"]


def test_events_before_the_watermark_change_nothing(spark, tmp_path):
    """A run that was closed stays as it was told."""
    batches = [[event(1, 1, 1, "view"), event(2, 2, 1, "error")], [event(3, 40, 2, "view")], [event(4, 90, 2, "view")], [event(5, 1.5, 1, "view"), event(6, 91, 2, "view")]]
    got = runs.run_to_end(write(spark, tmp_path / "in", batches)).where("user_id = 1").orderBy("run", "seq").collect()
    assert [(r["run"], r["seq"], r["kind"], r["data"]) for r in got] == [(0, 0, "event", "view"), (0, 1, "event", "error"), (0, 2, "failed", "view error")]


def test_empty_table(spark):
    assert runs.frames(spark.createDataFrame([], SCHEMA)).count() == 0
    assert runs.frames(spark.createDataFrame([event(1, 1, 1, "view")], SCHEMA)).where(F.col("kind") != "event").count() == 0
