"""Runs of events in event time as frames for subscribers: one state machine for a stream, one set of windows for a table.

A run of a user opens with an event and ends with a terminal one, whose frame ``completed`` or ``failed`` carries all tokens of
the run in order; the next event opens the next run. While a run is idle, each full idle interval gives a ``keep_alive``
frame. Frames of a run are numbered without gaps. What lies before the watermark is final: events are taken in order of time and
id, whatever the order they came in; an id seen twice counts once, and events from before the watermark change nothing any more.
State is kept for open runs and for events that the watermark has not passed. Events without user, id or time belong to no run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marlstone.session import shared_folder

TERMINAL = {"purchase": "completed", "error": "failed"}
IDLE_US = 12 * 3_600_000_000
DELAY = "6 hours"
DELAY_MS = 6 * 3_600_000
FRAME = "user_id long, run long, seq long, kind string, at_us long, data string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame) -> DataFrame:
    """user_id, event_id, event_type, us: microseconds since 1970, in no time zone."""
    rows = events.select("user_id", "event_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("us"))
    return rows.where("user_id IS NOT NULL AND event_id IS NOT NULL AND us IS NOT NULL")


class Runs(StatefulProcessor):
    """Open run and waiting events of one user; a timer stands at the next time at which something is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "run long, seq long, last long, tokens string")
        self.waiting = handle.getListState("waiting", "us long, event_id long, event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            fresh = batch[batch["us"] >= passed]
            self.waiting.appendList([(int(u), int(i), t if isinstance(t, str) else None) for u, i, t in zip(fresh["us"], fresh["event_id"], fresh["event_type"], strict=True)])
        self._wait()
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._advance(int(key[0]), timerValues.getCurrentWatermarkInMs() * 1000), columns=[c.split()[0] for c in FRAME.split(", ")])

    def close(self) -> None:
        pass

    def _wait(self) -> None:
        """One timer at the earliest waiting event or the next idle frame."""
        due = [u for u, *_ in self.waiting.get()]
        if self.open.exists():
            _, _, last, tokens = self.open.get()
            due += [last + IDLE_US] if tokens is not None else []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(min(due) // 1000)

    def _advance(self, user: int, until: int) -> list[tuple]:
        """Frames of all that lies before ``until``. ``tokens`` is null between runs; ``last`` is the time of the last frame."""
        waiting = sorted({i: (u, i, t) for u, i, t in self.waiting.get()}.values())
        run, seq, last, tokens = self.open.get() if self.open.exists() else (0, 0, 0, None)
        out: list[tuple] = []

        def idle(to: int) -> None:
            nonlocal seq, last
            while tokens is not None and last + IDLE_US < to:
                last += IDLE_US
                out.append((user, run, seq, "keep_alive", last, None))
                seq += 1

        for us, _, kind in (w for w in waiting if w[0] < until):
            idle(us)
            tokens = (kind or "") if tokens is None else f"{tokens} {kind or ''}"
            out.append((user, run, seq, "event", us, kind))
            seq, last = seq + 1, us
            if kind in TERMINAL:
                out.append((user, run, seq, TERMINAL[kind], us, tokens))
                run, seq, tokens = run + 1, 0, None
        idle(until)
        self.open.update((run, seq, last, tokens))
        later = [w for w in waiting if w[0] >= until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self._wait()
        return out


def frames_stream(events: DataFrame) -> DataFrame:
    """Frames of a stream of events in append mode, each as soon as the watermark passes it."""
    rows = timed(events).withColumn("at", F.timestamp_micros("us")).withWatermark("at", DELAY)
    return rows.groupBy("user_id").transformWithStateInPandas(Runs(), FRAME, "Append", "EventTime")


def frames(events: DataFrame, until_us: int | None = None) -> DataFrame:
    """The same frames of a table; all that lies before ``until_us``, by default the watermark after its last event."""
    rows = timed(events)
    if until_us is None:
        end = rows.agg(F.max("us")).first()[0]
        until_us = 0 if end is None else (end // 1000 - DELAY_MS) * 1000
    rows = rows.where(F.col("us") < until_us).dropDuplicates(["user_id", "event_id"])
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    ends = F.coalesce(F.col("event_type").isin(*TERMINAL), F.lit(False))
    placed = rows.withColumns({"ends": ends, "run": F.coalesce(F.sum(ends.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    inside = Window.partitionBy("user_id", "run").orderBy("us", "event_id")
    closed = F.max("ends").over(Window.partitionBy("user_id", "run"))
    placed = placed.withColumns({"next": F.coalesce(F.lead("us").over(inside), F.lit(until_us)), "closed": closed})
    # only a run that ends has its tokens gathered, in the row of its last frame
    said = F.sort_array(F.collect_list(F.struct("us", "event_id", F.coalesce("event_type", F.lit("")).alias("t"))))
    ended = placed.where("closed").groupBy("user_id", "run").agg(F.max(F.struct("us", "event_id", "event_type")).alias("e"), said.alias("said"))
    name = F.create_map(*[F.lit(x) for pair in TERMINAL.items() for x in pair])
    tokens = F.array_join(F.transform("said", lambda x: x["t"]), " ")
    close = ended.select("user_id", "run", "e.event_id", "e.us", F.lit(1).alias("k"), F.try_element_at(name, F.col("e.event_type")).alias("kind"), F.col("e.us").alias("at_us"), tokens.alias("data"))
    n_idle = F.when(F.col("ends"), 0).otherwise(F.floor((F.col("next") - F.col("us") - 1) / IDLE_US))
    k = F.explode(F.sequence(F.lit(0), F.greatest(n_idle, F.lit(0)).cast("int"))).alias("k")
    kind, data = F.when(F.col("k") == 0, "event").otherwise("keep_alive"), F.when(F.col("k") == 0, F.col("event_type"))
    own = placed.select("user_id", "run", "event_id", "us", "event_type", k)
    own = own.select("user_id", "run", "event_id", "us", "k", kind.alias("kind"), (F.col("us") + F.col("k") * IDLE_US).alias("at_us"), data.alias("data"))
    each = own.unionByName(close)
    seq = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("us", "event_id", "k")).cast("long") - 1
    return each.select("user_id", "run", seq.alias("seq"), "kind", "at_us", "data")


def run_to_end(events: DataFrame) -> DataFrame:
    """All frames of a finite stream. Each batch replaces its own folder, so a batch that is run again leaves no frame twice."""
    spark: SparkSession = events.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/frames/batch={number}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _STORE)
    try:
        run = frames_stream(events).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(FRAME).parquet(f"{base}/frames").select(*[c.split()[0] for c in FRAME.split(", ")])
