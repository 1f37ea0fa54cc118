"""Structured Streaming forms of the batch operators.

J5 and the routing of late rows (J8) hold keyed state: ``streaming.stateful``.

Event time is ``event_ts`` = TIMESTAMP of the Unix-second ``timestamp``
column; the default watermark is one hour (the reference's staleness rule).
Every function takes and returns a streaming DataFrame (or starts a query)
and shares its column logic with the batch operator named in its docstring.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import anomaly as A
from ..operators import decisions as D
from ..operators import isolation as IF
from ..operators import sensors as SN
from .latest_table import latest_version, upsert_latest  # noqa: F401  (J10)

WATERMARK = "1 hour"
READING_SCHEMA = T.StructType([
    T.StructField("reading_id", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("location", T.StringType()),
    T.StructField("weather", T.StringType()),
    T.StructField("vehicle_count", T.IntegerType()),
    T.StructField("average_speed_kmph", T.DoubleType()),
])


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                  schema: T.StructType = READING_SCHEMA) -> DataFrame:
    """A directory of reading files as a stream (explicit schema)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "csv":
        r = r.option("header", "true").option("mode", "PERMISSIVE")
    return with_event_time(r.load(path))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_ts", F.timestamp_seconds("timestamp"))


def deduplicated(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """J1 [D4]: drop repeated reading ids within the watermark."""
    return stream.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["reading_id"])


def tumbling_metrics(stream: DataFrame, size: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """J2 [D10]: per location and tumbling window: count, mean speed and volume."""
    return (stream.withWatermark("event_ts", watermark)
            .groupBy(F.window("event_ts", size).alias("w"), "location")
            .agg(F.count(F.lit(1)).alias("n_readings"), F.avg("average_speed_kmph").alias("avg_speed"),
                 F.avg("vehicle_count").alias("avg_vehicle_count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "location",
                    "n_readings", "avg_speed", "avg_vehicle_count"))


def sliding_metrics(stream: DataFrame, size: str = "1 hour", slide: str = "5 minutes",
                    watermark: str = WATERMARK) -> DataFrame:
    """J3 [E2]: time-based sliding mean and sample std of speed per location."""
    return (stream.withWatermark("event_ts", watermark)
            .groupBy(F.window("event_ts", size, slide).alias("w"), "location")
            .agg(F.avg("average_speed_kmph").alias("mean_speed"),
                 F.stddev_samp("average_speed_kmph").alias("std_speed"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "location", "mean_speed", "std_speed", "n"))


def congestion_sessions(stream: DataFrame, gap: str = "30 minutes", low_speed: float = 15.0, min_readings: int = 3,
                        watermark: str = WATERMARK) -> DataFrame:
    """J4 [E5]: sessions of low-speed readings per location with >= 3 readings."""
    return (stream.where(F.col("average_speed_kmph") < low_speed).withWatermark("event_ts", watermark)
            .groupBy(F.session_window("event_ts", gap).alias("s"), "location")
            .agg(F.count(F.lit(1)).alias("n_low"), F.min("average_speed_kmph").alias("min_speed"))
            .where(F.col("n_low") >= min_readings)
            .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "location",
                    "n_low", "min_speed"))


def scored(stream: DataFrame, baseline: DataFrame, z_threshold: float = A.Z_THRESHOLD) -> DataFrame:
    """J6 [C1]: stream-static join with the (<= 24-row) hourly baseline."""
    return A.score_anomalies(stream, baseline, z_threshold=z_threshold)


def scored_by_forest(stream: DataFrame, detector: dict) -> DataFrame:
    """J6 [G12]: a stream scored by a fitted or loaded isolation forest; a row
    gets the score and flag that it gets in a table."""
    return IF.flag(stream, detector)


def split_quarantine(batch: DataFrame, now, good_path: str, bad_path: str, batch_id: int) -> None:
    """J8 [B17]: route each micro-batch by the integrity rules into a clean
    and a quarantine table; one folder per batch id keeps replays idempotent."""
    checked = D.integrity_check(batch, F.lit(now))
    checked = checked.persist()
    checked.where(~F.col("has_issues")).drop("issues").write.mode("overwrite").parquet(
        os.path.join(good_path, f"batch_id={batch_id}"))
    checked.where(F.col("has_issues")).write.mode("overwrite").parquet(os.path.join(bad_path, f"batch_id={batch_id}"))
    checked.unpersist()


def fused_stream(sensor_stream: DataFrame, sensors: DataFrame, size: str = "1 hour",
                 watermark: str = WATERMARK) -> DataFrame:
    """J9 [D36-D38]: windowed sensor fusion on a stream of sensor payloads
    (requires ``event_ts``), in append mode: first each sensor's latest payload
    in a window, then the fusion over the sensors of the window."""
    s = sensor_stream.withWatermark("event_ts", watermark)
    payload = [c for c in s.columns if c not in ("sensor_key", "hour_bucket", "event_ts", "ts", "event_id")]
    last = (s.groupBy(F.window("event_ts", size).alias("w"), "sensor_key")
            .agg(F.max_by(F.struct(*payload), F.struct("event_ts", "event_id")).alias("p")).select("w", "sensor_key", "p.*"))
    return SN.fuse_latest(SN.with_category(last, sensors), F.window("w", size).alias("win"))


def latest_per_location(stream: DataFrame) -> DataFrame:
    """J10 [C8]: latest reading per location (update mode)."""
    return stream.groupBy("location").agg(
        F.max_by(F.struct("timestamp", "reading_id", "vehicle_count", "average_speed_kmph"),
                 F.struct("timestamp", "reading_id")).alias("latest"))


def idempotent_sink(path: str):
    """``foreachBatch`` writer that overwrites the folder of its
    batch id, so a replayed batch replaces rather than duplicates."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write
