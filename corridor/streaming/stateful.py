"""Keyed state variables: what the stateful operators share, J5 and J8.

The operators hold lists, maps and values per key in the state store, which
loads a key's variables only when the key has rows or a timer.  They run on
``transformWithStateInPandas`` and need the RocksDB state store
(``state_store_conf``; ``corridor.session`` sets it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import decisions as D
from ..session import SESSION_DEFAULTS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def state_store_conf(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, SESSION_DEFAULTS[_PROVIDER])


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stopped or running query, as of its last
    committed batch: one row per key and list or map entry."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def hold(variable, rows: list[tuple]) -> None:
    """Let a list variable hold these rows (it can't be set to an empty list)."""
    if rows:
        variable.put(rows)
    else:
        variable.clear()


class Waking(StatefulProcessor):
    """A processor whose key wakes at one time at most, which it may move."""

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms long")

    def wake_at(self, ms: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(int(ms))
            self.timer.update((int(ms),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return iter(self.advance(key, list(rows), timerValues.getCurrentWatermarkInMs(), False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        return iter(self.advance(key, [], timerValues.getCurrentWatermarkInMs(), True))

    def advance(self, key, frames: list[pd.DataFrame], passed: int, woken: bool) -> list[pd.DataFrame]:
        """The output of a key's new rows, or of its timer, at watermark ``passed``."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def whole(df: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have all of ``cols``, the others): rows without a key, an id
    or a time can't be placed and belong into quarantine."""
    there = F.lit(True)
    for c in cols:
        there = there & F.col(c).isNotNull()
    return df.where(there), df.where(~there)


# --- J5 [E4, E5] -----------------------------------------------------------

INCIDENT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("reading_id", T.LongType()),
    T.StructField("timestamp", T.LongType()), T.StructField("drop_kmph", T.DoubleType()),
])
MIN_READINGS = 5
IDLE_SECONDS = 30 * 24 * 3600


class Incidents(Waking):
    """One location: readings wait until the watermark passes them, then they
    are taken in order of time, however they arrived.  ``last``: the last
    three speeds, the number of readings and their latest time; ``early``:
    slowdowns of a location that has not had five readings yet."""

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "ts long, reading_id long, speed double")
        self.early = handle.getListState("early", "ts long, reading_id long, drop double")
        self.last = handle.getValueState("last", "speeds array<double>, n_seen long, ts long")

    def advance(self, key, frames, passed, woken):
        new = [(int(t), int(i), math.nan if s is None else float(s)) for f in frames
               for t, i, s in zip(f["timestamp"], f["reading_id"], f["average_speed_kmph"])]
        waiting = sorted([tuple(w) for w in self.waiting.get()] + new)
        early = [tuple(e) for e in self.early.get()]
        speeds, n_seen, last_ts = self.last.get() if self.last.exists() else ([], 0, 0)
        speeds, passed_s = list(speeds), passed // 1000
        n_early, out = len(early), []

        def slowdown(ts, rid, drop):
            out.append(("sudden_slowdown", "high" if drop > 40 else "medium", key[0], int(rid), int(ts), float(drop)))

        n_ready = 0
        for ts, rid, speed in waiting:
            if ts >= passed_s:
                break
            n_ready += 1
            if speeds and speed - speeds[-1] < -20:
                if n_seen + 1 >= MIN_READINGS:
                    slowdown(ts, rid, speeds[-1] - speed)
                else:
                    early.append((ts, rid, speeds[-1] - speed))
            speeds = (speeds + [speed])[-3:]
            n_seen, last_ts = n_seen + 1, max(last_ts, ts)
            if n_seen >= MIN_READINGS and early:
                for e in early:
                    slowdown(*e)
                early = []
            if len(speeds) == 3 and all(s < 15 for s in speeds):
                out.append(("persistent_congestion", "medium", key[0], rid, ts, None))
        waiting = waiting[n_ready:]
        if not waiting and passed_s > last_ts + IDLE_SECONDS:
            for s in (self.waiting, self.early, self.last):
                s.clear()
            self.wake_at(None)
        else:
            if n_ready or len(early) != n_early:
                hold(self.waiting, waiting)
                hold(self.early, early)
                self.last.update((speeds, n_seen, last_ts))
            elif new:
                self.waiting.appendList(new)
            wake = (waiting[0][0] if waiting else last_ts + IDLE_SECONDS) + 1
            self.wake_at(max(wake * 1000, passed + 1))
        return [pd.DataFrame(out, columns=INCIDENT_SCHEMA.names)] if out else []


READING_KEYS = ("location", "reading_id", "timestamp", "event_ts")


def stateful_incidents(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Slowdown and low-run detection with per-location state: the last
    three speeds, a count, and the readings of the watermark's delay, so state
    is bounded by time.  Readings that arrive within the delay are taken in
    order of time whatever the micro-batches; a location's slowdowns are held
    until it has five readings; a location idle for ``IDLE_SECONDS`` of event
    time is forgotten.  Readings without location, id or time take no part:
    ``whole(stream, *READING_KEYS)`` has them for the quarantine."""
    state_store_conf(stream.sparkSession)
    sound, _ = whole(stream, *READING_KEYS)
    rows = sound.select("location", "timestamp", "reading_id", "average_speed_kmph", "event_ts").withWatermark("event_ts", watermark)
    return rows.groupBy("location").transformWithStateInPandas(Incidents(), INCIDENT_SCHEMA, "Append", "EventTime")


# --- J8 [B17] --------------------------------------------------------------

class LateRows(StatefulProcessor):
    """Marks rows that come more than ``delay_ms`` behind the latest event time
    that their key had shown before this micro-batch.  Rows of one batch do not
    make one another late, in whatever order or chunks they come; a replayed
    batch has its old batch time and marks the same rows."""

    def __init__(self, delay_ms: int, time_col: str):
        self.delay_ms, self.time_col = delay_ms, time_col

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "before long, now long, batch long")

    def handleInputRows(self, key, rows, timerValues):
        batch = timerValues.getCurrentProcessingTimeInMs()
        before, now, at = self.seen.get() if self.seen.exists() else (None, None, None)
        if at != batch:
            before = now
        out = []
        for f in rows:
            ms = f[self.time_col].astype("datetime64[us]").astype("int64") // 1000
            out.append(f.assign(late=False if before is None else ms < before - self.delay_ms))
            now = max(int(ms.max()), now if now is not None else int(ms.max()))
        self.seen.update((before, now, batch))
        return iter(out)

    def close(self) -> None:
        pass


NEVER_LATE = "36500 days"
ROUTES = ("clean", "late", "quarantine")


def routed(stream: DataFrame, now, delay_seconds: int = 3600, key: str = "location") -> DataFrame:
    """Each row of ``stream`` once, with ``route`` clean, late or
    quarantine.  Quarantine: the integrity rules fail against ``now``, or key,
    id or time is missing.  Late: sound, but more than the delay behind what
    its key had shown before.  The operator holds its own mark per key; Spark's
    watermark, which drops late rows, is set so far back that it drops none."""
    state_store_conf(stream.sparkSession)
    checked = D.integrity_check(stream, F.lit(now)).drop("issues")
    there = F.col(key).isNotNull() & F.col("reading_id").isNotNull() & F.col("event_ts").isNotNull()
    sound = F.coalesce(there & ~F.col("has_issues"), F.lit(False))
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])
    marked = (checked.where(sound).select(*columns).withWatermark("event_ts", NEVER_LATE).groupBy(key)
              .transformWithStateInPandas(LateRows(delay_seconds * 1000, "event_ts"), schema, "Append", "EventTime"))
    good = marked.select(*columns, F.when(F.col("late"), "late").otherwise("clean").alias("route"))
    return good.unionByName(checked.where(~sound).select(*columns, F.lit("quarantine").alias("route")))


def write_routes(path: str):
    """``foreachBatch`` writer of ``routed``: a folder per route and batch id,
    so a replayed batch replaces its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("route", "batch_id").parquet(path))
    return write


def read_route(spark: SparkSession, path: str, route: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("route") == route).drop("route", "batch_id")
