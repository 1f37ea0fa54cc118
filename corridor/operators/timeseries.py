"""Per-location series features and incident detectors.

All row-ordered windows go through ``series.series_frame`` so a hot location
never lands in one task.  Series order is (timestamp, reading_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.time import event_time
from .anomaly import hourly_baseline
from .series import POS, DEFAULT_CHUNK_ROWS, drop_halo, series_frame, series_window

# Lags, rolling windows and detector thresholds.
LAGS = (1, 2, 3, 6, 12, 24)
ROLLING = (3, 6, 12)
SLOWDOWN_DROP = -20.0
SLOWDOWN_HIGH_DROP = -40.0
SLOWDOWN_MIN_READINGS = 5
LOW_SPEED = 15.0
LOW_RUN = 3
TREND_POINTS = 10
TREND_STEPS_AHEAD = 3
TREND_MIN_POINTS = 3
TREND_SPEED_GAP = 30.0
TREND_VOLUME_GAP = 50.0
TREND_CONFIDENCE = 0.7
TREND_HORIZON = "15_minutes"
PEAK_QUANTILE = 0.75
PEAK_HIGH = 0.8
PEAK_MEDIUM = 0.6
# The peaks assumed without readings (start, end, intensity, number).
DEFAULT_PEAKS = [(7, 9, None, None, None, "High", 1), (12, 13, None, None, None, "Medium", 2),
                 (17, 19, None, None, None, "High", 3)]

ORDER = ("timestamp", "reading_id")


def lag_features(readings: DataFrame, target: str = "average_speed_kmph", key: Sequence[str] = ("location",),
                 lags: Sequence[int] = LAGS, windows: Sequence[int] = ROLLING,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """E1 + E2: lags of ``target`` and rolling mean / sample std over the last
    w rows (null until w rows exist)."""
    look = max(max(lags), max(windows) - 1)
    f = series_frame(readings, key, ORDER, look, chunk_rows)
    w = series_window(key)
    cols = {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        full = F.count(target).over(frame) == n
        cols[f"{target}_rolling_mean_{n}"] = F.when(full, F.avg(target).over(frame))
        cols[f"{target}_rolling_std_{n}"] = F.when(full, F.stddev_samp(target).over(frame))
    return drop_halo(f.withColumns(cols))


def complete_rows(features: DataFrame, target: str = "average_speed_kmph") -> DataFrame:
    """Keep rows whose lag and rolling columns are all present."""
    cols = [c for c in features.columns if c.startswith(f"{target}_lag_") or c.startswith(f"{target}_rolling_")]
    return features.na.drop(subset=cols)


def speed_changes(readings: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Speed change from the previous reading of the same location, the
    position in the series and the series length."""
    narrow = readings.select("location", *ORDER, "average_speed_kmph")
    f = series_frame(narrow, ["location"], ORDER, LOW_RUN - 1, chunk_rows)
    w = series_window(["location"])
    f = f.withColumns({
        "speed_change": F.col("average_speed_kmph") - F.lag("average_speed_kmph", 1).over(w),
        "max_speed_last_3": F.max("average_speed_kmph").over(w.rowsBetween(-(LOW_RUN - 1), 0)),
    })
    return drop_halo(f)


def sudden_slowdowns(changes: DataFrame) -> DataFrame:
    """Drop below -20 km/h between consecutive readings of a location with
    at least 5 readings; severity high below -40."""
    c = F.col("speed_change")
    return (changes.where((c < SLOWDOWN_DROP) & (F.col("series_len") >= SLOWDOWN_MIN_READINGS))
            .select(F.lit("sudden_slowdown").alias("type"),
                    F.when(c < SLOWDOWN_HIGH_DROP, "high").otherwise("medium").alias("severity"),
                    "location", "reading_id", "timestamp",
                    F.abs(c).alias("drop_kmph")))


def persistent_congestion(changes: DataFrame) -> DataFrame:
    """E5: readings closing a run of three readings below 15 km/h."""
    cond = (F.col(POS) >= LOW_RUN - 1) & (F.col("max_speed_last_3") < LOW_SPEED)
    return _congested(changes.where(cond))


def _congested(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("persistent_congestion").alias("type"), F.lit("medium").alias("severity"),
                       "location", "reading_id", "timestamp", F.lit(None).cast("double").alias("drop_kmph"))


def last_readings(readings: DataFrame, n: int) -> DataFrame:
    """Each location's last ``n`` readings with ``back`` = 1 for the latest.
    Spark keeps n rows per location and task before the shuffle, so the
    history is neither sorted nor moved."""
    w = Window.partitionBy("location").orderBy(*[F.desc(c) for c in ORDER])
    return readings.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def persistent_congestion_latest(readings: DataFrame) -> DataFrame:
    """E5 on each location's latest readings only (the "last three readings" test)."""
    last = last_readings(readings.select("location", *ORDER, "average_speed_kmph"), LOW_RUN)
    g = last.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.max("average_speed_kmph").alias("top"),
                                     F.min_by(F.struct("reading_id", "timestamp"), "back").alias("last"))
    return _congested(g.where((F.col("n") == LOW_RUN) & (F.col("top") < LOW_SPEED)).select("location", "last.*"))


def incidents(readings: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """H4: both detectors' incidents as one table."""
    ch = speed_changes(readings, chunk_rows)
    return sudden_slowdowns(ch).unionByName(persistent_congestion(ch))


def _trend(readings: DataFrame, points: int) -> DataFrame:
    """Slopes per location over its last ``points`` readings (a slope does not
    depend on where positions are counted from)."""
    last = last_readings(readings.select("location", *ORDER, "average_speed_kmph", "vehicle_count"), points)
    x = -F.col("back").cast("double")
    return last.groupBy("location").agg(
        F.regr_slope("average_speed_kmph", x).alias("speed_slope"),
        F.regr_slope(F.col("vehicle_count").cast("double"), x).alias("volume_slope"),
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(F.struct("average_speed_kmph", "vehicle_count", "timestamp"), "back").alias("last"))


def trend_forecast(readings: DataFrame, baseline: DataFrame | None = None, points: int = TREND_POINTS) -> DataFrame:
    """Least-squares slope over each location's last ``points`` readings,
    projected 3 steps ahead and compared with the hourly baseline mean of the
    last reading's hour; emits 0-2 prediction rows per location."""
    baseline = baseline if baseline is not None else hourly_baseline(readings)
    g = _trend(readings, points).where(F.col("n_points") >= TREND_MIN_POINTS)
    g = g.select("location", "speed_slope", "volume_slope",
                 (F.col("last.average_speed_kmph") + F.col("speed_slope") * TREND_STEPS_AHEAD).alias("future_speed"),
                 (F.col("last.vehicle_count") + F.col("volume_slope") * TREND_STEPS_AHEAD).alias("future_volume"),
                 F.hour(event_time(F.col("last.timestamp"))).alias("hour"))
    # baseline: <= 24 rows, bounded by the hour domain
    g = g.join(F.broadcast(baseline.select("hour", "speed_mean", "volume_mean")), "hour", "left")
    preds = F.array(
        F.when(F.abs(F.col("future_speed") - F.col("speed_mean")) > TREND_SPEED_GAP,
               F.struct(F.lit("speed_anomaly_predicted").alias("type"),
                        F.col("future_speed").alias("predicted_value"), F.col("speed_mean").alias("normal_value"))),
        F.when(F.abs(F.col("future_volume") - F.col("volume_mean")) > TREND_VOLUME_GAP,
               F.struct(F.lit("volume_anomaly_predicted").alias("type"),
                        F.col("future_volume").cast("double").alias("predicted_value"),
                        F.col("volume_mean").alias("normal_value"))))
    return (g.select("location", "speed_slope", "volume_slope", F.explode(F.array_compact(preds)).alias("p"))
             .select("location", "speed_slope", "volume_slope", "p.*",
                     F.lit(TREND_HORIZON).alias("time_horizon"), F.lit(TREND_CONFIDENCE).alias("confidence")))


def trend_slopes(readings: DataFrame, points: int = TREND_POINTS) -> DataFrame:
    """Slope of speed and volume over the last ``points`` readings per location."""
    return _trend(readings, points).drop("last")


def peak_hours(readings: DataFrame) -> DataFrame:
    """Hours whose intensity reaches the 75th percentile, grouped into
    runs of consecutive hours (gaps and islands).  Every window here runs over
    the <= 24-row hourly aggregate."""
    h = (readings.withColumn("hour", F.hour(event_time("timestamp"))).groupBy("hour")
         .agg(round_half_up(F.avg("vehicle_count"), 2).alias("vc"),
              round_half_up(F.avg("average_speed_kmph"), 2).alias("sp")))
    all_hours = Window.partitionBy()
    # no traffic at all: no share of the busiest hour either
    share = F.coalesce(F.try_divide(F.col("vc"), F.max("vc").over(all_hours)), F.lit(0.0))
    h = h.withColumn("intensity", share * 0.6 + (100 - F.col("sp")) / 100 * 0.4)
    h = h.withColumn("threshold", F.percentile("intensity", PEAK_QUANTILE).over(all_hours))
    p = h.where(F.col("intensity") >= F.col("threshold"))
    p = p.withColumn("island", F.col("hour") - F.row_number().over(Window.orderBy("hour")))
    g = p.groupBy("island").agg(F.min("hour").alias("start"), F.max("hour").alias("end"),
                                F.avg("intensity").alias("mean_intensity"),
                                F.avg("vc").alias("avg_vehicles"), F.avg("sp").alias("avg_speed"))
    found = (g.withColumn("intensity", F.when(F.col("mean_intensity") > PEAK_HIGH, "High")
                         .when(F.col("mean_intensity") > PEAK_MEDIUM, "Medium").otherwise("Low"))
             .withColumn("period", F.row_number().over(Window.orderBy("start")))
             .drop("island"))
    # without readings: the usual peaks
    usual = found.sparkSession.createDataFrame(
        DEFAULT_PEAKS, "start int, end int, mean_intensity double, avg_vehicles double, avg_speed double, "
        "intensity string, period int")
    none = readings.select(F.count(F.lit(1))).scalar() == 0
    return found.unionByName(usual.where(none))


def max_normalised(agg: DataFrame, value: str, out: str | None = None) -> DataFrame:
    """Value / max(value) of an aggregated table (max as a scalar subquery)."""
    return agg.withColumn(out or f"{value}_norm", F.try_divide(F.col(value), agg.select(F.max(value)).scalar()))
