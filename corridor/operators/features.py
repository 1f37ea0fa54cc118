"""Table enrichments: calendar features, encoders, congestion definitions,
model features and the reproducible train/test split (B1-B9, G1, G2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.congestion import (congestion_class, congestion_score, level_from_speed,
                                    speed_band, speed_band_code)
from ..functions.time import add_calendar_names, add_time_features, rush_period

# The payload/UI weather code (differs from the alphabetical
# label encoding on purpose); unknown weather -> 0.
WEATHER_CODES = {"Sunny": 0, "Cloudy": 1, "Rainy": 2, "Snowy": 3, "Foggy": 4}

FEATURE_COLUMNS = ("vehicle_count", "location_encoded", "weather_encoded", "hour",
                   "day_of_week", "month", "is_weekend", "is_rush_hour")


def time_features(readings: DataFrame) -> DataFrame:
    """B1."""
    return add_time_features(readings)


def calendar_names(readings: DataFrame) -> DataFrame:
    """B2."""
    return add_calendar_names(readings)


def with_rush_period(readings: DataFrame) -> DataFrame:
    """B3."""
    return add_time_features(readings).withColumn("rush_period", rush_period("hour"))


def label_encoder(df: DataFrame, col: str, code_col: str | None = None) -> DataFrame:
    """B4 fit: alphabetical 0-based code per distinct non-null label.

    The distinct labels are ranked with the distributed sort, so even a
    large label set never passes through one task.  The encoder is stored, so
    the planner knows its true size: a small one is broadcast under the usual
    threshold and the readings are not shuffled by label.
    """
    from ..session import stored
    from .ordering import with_group_rank
    code_col = code_col or f"{col}_encoded"
    labels = df.select(col).where(F.col(col).isNotNull()).distinct()
    # distinct labels: the 0-based position in sorted order is the code
    return stored(with_group_rank(labels, [], [col], code_col), "labels")


def apply_label_encoder(df: DataFrame, encoder: DataFrame, col: str,
                        code_col: str | None = None) -> DataFrame:
    """B4 apply: left lookup, unknown label -> 0.  The join strategy is left to
    AQE (broadcast when the encoder's runtime size is under the threshold)."""
    code_col = code_col or f"{col}_encoded"
    return (df.join(encoder.withColumnRenamed(code_col, "_code"), col, "left")
              .withColumn(code_col, F.coalesce("_code", F.lit(0)))
              .drop("_code"))


def weather_code(weather: str | Column = "weather") -> Column:
    """Fixed weather code map, unknown -> 0."""
    w = F.col(weather) if isinstance(weather, str) else weather
    pairs = [x for name, code in WEATHER_CODES.items() for x in (F.lit(name), F.lit(code))]
    return F.coalesce(F.create_map(*pairs)[w], F.lit(0))


def max_vehicle_count(readings: DataFrame) -> Column:
    """Global maximum as an uncorrelated scalar subquery (one aggregate job)."""
    return readings.select(F.max("vehicle_count")).scalar()


def with_congestion(readings: DataFrame) -> DataFrame:
    """B6-B9 side by side: score, class of the score, level from speed,
    speed band (text) and speed band code."""
    score = congestion_score("vehicle_count", "average_speed_kmph", max_vehicle_count(readings))
    return (readings.withColumn("congestion_score", score)
            .withColumns({"congestion_class": congestion_class("congestion_score"),
                          "congestion_level": level_from_speed("average_speed_kmph"),
                          "speed_band": speed_band("average_speed_kmph"),
                          "speed_band_code": speed_band_code("average_speed_kmph")}))


def model_features(readings: DataFrame) -> DataFrame:
    """G1: the eight model features plus both targets (speed and score class)."""
    t = add_time_features(readings)
    loc = label_encoder(readings, "location")
    wea = label_encoder(readings, "weather")
    t = apply_label_encoder(apply_label_encoder(t, loc, "location"), wea, "weather")
    score = congestion_score("vehicle_count", "average_speed_kmph", max_vehicle_count(readings))
    return t.withColumns({"congestion_score": score,
                          "congestion_class": congestion_class(score),
                          "speed_band_code": speed_band_code("average_speed_kmph")})


def hash_bucket(id_col: str | Column) -> Column:
    """Reproducible 0..99 bucket from the md5 of the row id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % 100


def train_test_split(df: DataFrame, id_col: str = "reading_id", test_percent: int = 20) -> DataFrame:
    """``is_test`` for rows whose hash bucket is below ``test_percent``."""
    return df.withColumn("is_test", hash_bucket(id_col) < test_percent)
