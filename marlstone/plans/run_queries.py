"""Queries on runs of events in event time, from the table and from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.queries import query
from marlstone.session import table
from marlstone.streaming import runs

_FRAMES = f"""
WITH t AS (SELECT DISTINCT user_id, event_id, event_type, epoch_us(ts) AS us FROM events),
w AS (SELECT (max(us) // 1000 - {runs.DELAY_MS}) * 1000 AS until FROM t),
e AS (SELECT t.*, until, event_type IN ('purchase', 'error') AS ends FROM t, w WHERE us < until),
p AS (SELECT *, CAST(coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run FROM e),
n AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY user_id, run ORDER BY us, event_id), until) AS next FROM p),
f AS (
  SELECT user_id, run, us, event_id, 0 AS k, 'event' AS kind, us AS at_us, event_type AS data FROM n
  UNION ALL SELECT user_id, run, us, event_id, i, 'keep_alive', us + i * {runs.IDLE_US}, NULL FROM (SELECT *, unnest(range(1, (next - us - 1) // {runs.IDLE_US} + 1)) AS i FROM n WHERE NOT ends)
  UNION ALL SELECT user_id, run, max(us), max_by(event_id, (us, event_id)), 1, CASE WHEN max_by(event_type, (us, event_id)) = 'error' THEN 'failed' ELSE 'completed' END, max(us),
    string_agg(event_type, ' ' ORDER BY us, event_id) FROM n GROUP BY user_id, run HAVING bool_or(ends))
SELECT user_id, run, row_number() OVER (PARTITION BY user_id, run ORDER BY us, event_id, k) - 1 AS seq, kind, at_us, data FROM f"""


@query(_FRAMES)
def run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.frames(table(spark, sf_dir, "events"))


@query(_FRAMES)
def stream_run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return runs.run_to_end(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
