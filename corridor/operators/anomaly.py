"""Baselines and statistical anomaly scoring.

The baseline is an aggregate keyed by hour of day (at most 24 rows) or by
(day of week, hour) (at most 168 rows): its size is bounded by the key
domain, never by the data, so it is always safe to broadcast.  Scoring is
then a map-side broadcast hash join plus column arithmetic — one pass over
the readings with no shuffle of the fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import event_time

# Z-test and severity constants.
Z_THRESHOLD = 2.5
Z_EPSILON = 1e-8
SEVERITY_HIGH_Z = 4.0
SEVERITY_MEDIUM_Z = 3.0
CONFIDENCE_CAP = 0.95
CONFIDENCE_Z_SCALE = 5.0

HOURS_PER_DAY = 24          # baseline-by-hour row bound
HOURS_PER_WEEK = 7 * 24     # baseline-by-(dow, hour) row bound


def with_hour(readings: DataFrame, seconds: str = "timestamp") -> DataFrame:
    return readings.withColumn("hour", F.hour(event_time(seconds)))


def hourly_baseline(readings: DataFrame, seconds: str = "timestamp") -> DataFrame:
    """Mean and sample std of speed and volume per hour of day."""
    return (with_hour(readings, seconds).where(F.col("hour").isNotNull())
            .groupBy("hour")
            .agg(F.avg("average_speed_kmph").alias("speed_mean"),
                 F.stddev_samp("average_speed_kmph").alias("speed_std"),
                 F.avg("vehicle_count").alias("volume_mean"),
                 F.stddev_samp("vehicle_count").alias("volume_std"),
                 F.count(F.lit(1)).alias("n_readings")))


def daily_hour_baseline(readings: DataFrame, seconds: str = "timestamp") -> DataFrame:
    """The same statistics per (day of week Monday=0, hour)."""
    t = event_time(seconds)
    return (readings.withColumns({"day_of_week": F.weekday(t), "hour": F.hour(t)})
            .groupBy("day_of_week", "hour")
            .agg(F.avg("average_speed_kmph").alias("speed_mean"),
                 F.stddev_samp("average_speed_kmph").alias("speed_std"),
                 F.avg("vehicle_count").alias("volume_mean"),
                 F.stddev_samp("vehicle_count").alias("volume_std"),
                 F.count(F.lit(1)).alias("n_readings")))


def _z(value: Column, mean: Column, std: Column) -> Column:
    # Null std (an hour with one reading) gives a null z that never fires.
    return F.abs(value - mean) / (std + Z_EPSILON)


def score_anomalies(readings: DataFrame, baseline: DataFrame, *, z_threshold: float = Z_THRESHOLD,
                    seconds: str = "timestamp") -> DataFrame:
    """Left lookup of each reading's hour in the baseline, then z tests.

    Adds ``speed_z``, ``volume_z``, ``max_z``, ``anomaly_types`` (array of
    'speed_anomaly' / 'volume_anomaly'), ``anomaly_detected``, ``severity``
    (high > 4, medium > 3, else low — set even when nothing fires),
    ``confidence`` = min(.95, max_z / 5) and ``recommendations`` (codes).
    """
    b = baseline.select("hour", "speed_mean", "speed_std", "volume_mean", "volume_std")
    # The baseline has at most 24 rows (hour of day): bounded, so broadcast.
    scored = (with_hour(readings, seconds)
              .join(F.broadcast(b), "hour", "left")
              .withColumns({
                  "speed_z": _z(F.col("average_speed_kmph"), F.col("speed_mean"), F.col("speed_std")),
                  "volume_z": _z(F.col("vehicle_count"), F.col("volume_mean"), F.col("volume_std")),
              }))
    speed_hit = F.coalesce(F.col("speed_z") > z_threshold, F.lit(False))
    volume_hit = F.coalesce(F.col("volume_z") > z_threshold, F.lit(False))
    max_z = F.greatest("speed_z", "volume_z")
    return scored.withColumns({
        "max_z": max_z,
        "anomaly_types": F.array_compact(F.array(
            F.when(speed_hit, F.lit("speed_anomaly")),
            F.when(volume_hit, F.lit("volume_anomaly")))),
        "anomaly_detected": speed_hit | volume_hit,
        "severity": (F.when(max_z > SEVERITY_HIGH_Z, "high")
                      .when(max_z > SEVERITY_MEDIUM_Z, "medium").otherwise("low")),
        "confidence": F.least(F.lit(CONFIDENCE_CAP), max_z / CONFIDENCE_Z_SCALE),
        "recommendations": F.array_compact(F.array(
            F.when(speed_hit & (F.col("average_speed_kmph") < F.col("speed_mean")), F.lit("speed_drop_check_incident"))
             .when(speed_hit, F.lit("speed_high_check_compliance")),
            F.when(volume_hit & (F.col("vehicle_count") > F.col("volume_mean")), F.lit("volume_high_prepare"))
             .when(volume_hit, F.lit("volume_low_investigate")))),
    })


def anomaly_counts(scored: DataFrame) -> DataFrame:
    """Readings and anomalies per (hour, severity) of scored readings."""
    return (scored.groupBy("hour", "severity")
            .agg(F.count(F.lit(1)).alias("n_readings"),
                 F.count_if(F.col("anomaly_detected")).alias("n_anomalies"),
                 F.count_if(F.array_contains("anomaly_types", "speed_anomaly")).alias("n_speed"),
                 F.count_if(F.array_contains("anomaly_types", "volume_anomaly")).alias("n_volume")))


FOREST_FEATURES = ("average_speed_kmph", "vehicle_count", "hour", "weather_encoded", "is_weekend")


def score_with_forest(readings: DataFrame, baseline: DataFrame, *, z_threshold: float = Z_THRESHOLD,
                      **forest_kw) -> DataFrame:
    """C1 + G12: the z tests plus the isolation-forest verdict on the scaled
    [speed, volume, hour, weather code, weekend] vector, which adds
    'ml_pattern_anomaly' to the types (and a review recommendation).  The
    forest columns are computed on the same rows, so no join is needed."""
    from . import isolation
    from .features import model_features
    f = model_features(readings)
    s = score_anomalies(f, baseline, z_threshold=z_threshold)
    d = isolation.detect(s, FOREST_FEATURES, "reading_id", **forest_kw)
    ml = F.col("is_ml_anomaly")
    return d.withColumns({
        "anomaly_types": F.when(ml, F.array_append("anomaly_types", F.lit("ml_pattern_anomaly")))
                          .otherwise(F.col("anomaly_types")),
        "anomaly_detected": F.col("anomaly_detected") | ml,
        "recommendations": F.when(ml, F.array_append("recommendations", F.lit("ml_pattern_review")))
                            .otherwise(F.col("recommendations")),
    })


def save_baseline(baseline: DataFrame, path: str) -> None:
    """D22 as a saved table: fit once over the history, score many times
    (streams, later batches) without re-reading the history."""
    baseline.coalesce(1).write.mode("overwrite").parquet(path)   # <= 24 (or 168) rows


def load_baseline(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
