"""Short-term forecast, demand matrix and latest state.

Re-aimed from random numbers to data: the forecast is seasonal-naive — the
mean speed and volume of the same (location, weather, hour of day) in the
history, falling back to (location, hour) — projected over a fixed number
of future steps after each location's latest reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import event_time

# Forecast shape and clips.
FORECAST_STEPS = 20
STEP_SECONDS = {"15 minutes": 1800, "1 hour": 1800, "4 hours": 1800, "24 hours": 1800, "7 days": 6 * 3600}
SPEED_CLIP = (10.0, 90.0)
VOLUME_CLIP = (10.0, 200.0)
BAND = 10.0


def latest_per_location(readings: DataFrame) -> DataFrame:
    """Latest reading per location (max by (timestamp, reading_id))."""
    m = readings.groupBy("location").agg(F.max_by(
        F.struct("timestamp", "reading_id", "weather", "vehicle_count", "average_speed_kmph"),
        F.struct("timestamp", "reading_id")).alias("latest"))
    return m.select("location", "latest.*")


def forecast(readings: DataFrame, horizon: str = "4 hours", steps: int = FORECAST_STEPS,
             weather: str | None = None) -> DataFrame:
    """``steps`` future points per location; ``weather`` None means the
    weather of the location's latest reading ("Current")."""
    step = STEP_SECONDS[horizon]
    h = readings.withColumn("hour", F.hour(event_time("timestamp")))
    by_lwh = h.groupBy("location", "weather", "hour").agg(F.avg("average_speed_kmph").alias("s1"),
                                                          F.avg("vehicle_count").alias("v1"))
    by_lh = h.groupBy("location", "hour").agg(F.avg("average_speed_kmph").alias("s2"),
                                              F.avg("vehicle_count").alias("v2"))
    last = latest_per_location(readings).select("location", F.col("timestamp").alias("t0"),
                                                F.col("weather").alias("current_weather"))
    w = F.lit(weather) if weather else F.col("current_weather")
    pts = (last.select("location", w.alias("weather"),
                       F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "t0")
           .withColumn("timestamp", F.col("t0") + F.col("step") * step)
           .withColumn("hour", F.hour(event_time("timestamp"))))
    f = (pts.join(by_lwh, ["location", "weather", "hour"], "left").join(by_lh, ["location", "hour"], "left")
         .withColumns({"predicted_speed": F.least(F.greatest(F.coalesce("s1", "s2"), F.lit(SPEED_CLIP[0])),
                                                   F.lit(SPEED_CLIP[1])),
                       "predicted_volume": F.least(F.greatest(F.coalesce("v1", "v2"), F.lit(VOLUME_CLIP[0])),
                                                    F.lit(VOLUME_CLIP[1]))}))
    return f.select("location", "weather", "step", "timestamp", "hour", "predicted_speed", "predicted_volume",
                    (F.col("predicted_speed") + BAND).alias("upper"),
                    F.greatest(F.lit(0.0), F.col("predicted_speed") - BAND).alias("lower"))


def forecast_slice(fc: DataFrame, location: str | None = None, weather: str | None = None) -> DataFrame:
    """One location / weather slice of a forecast."""
    if location:
        fc = fc.where(F.col("location") == location)
    if weather:
        fc = fc.where(F.col("weather") == weather)
    return fc


def demand_matrix(readings: DataFrame) -> DataFrame:
    """Mean vehicle count per (location, hour) divided by the largest
    cell, so demand lies in (0, 1] (the max is a scalar subquery)."""
    a = (readings.withColumn("hour", F.hour(event_time("timestamp"))).groupBy("location", "hour")
         .agg(F.avg("vehicle_count").alias("mean_vehicle_count")))
    return a.withColumn("demand", F.try_divide(F.col("mean_vehicle_count"), a.select(F.max("mean_vehicle_count")).scalar()))


def rows_of_type(typed: DataFrame, kind: str) -> DataFrame:
    """Rows of one type (Proposed / Existing)."""
    return typed.where(F.col("type") == kind)
