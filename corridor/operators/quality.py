"""Data-quality report (D1-D8) as single-pass aggregates.

Each statistic is one aggregate expression; the report pieces share a scan
where they can and never collect rows to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_half_up
from ..functions.time import event_time
from .ordering import exact_quantiles

# The columns of the reference's readings table (ids and derived columns
# are not part of the quality report).
READING_COLUMNS = ("timestamp", "location", "weather", "vehicle_count", "average_speed_kmph")
NUMERIC_COLUMNS = ("timestamp", "vehicle_count", "average_speed_kmph")
QUALITY_GOOD_ABOVE = 80.0
IQR_FACTOR = 1.5


def dataset_summary(readings: DataFrame) -> DataFrame:
    """Count, means, sample stds and number of locations."""
    return readings.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg("average_speed_kmph").alias("avg_speed"),
        F.avg("vehicle_count").alias("avg_vehicle_count"),
        F.stddev_samp("average_speed_kmph").alias("speed_std"),
        F.stddev_samp("vehicle_count").alias("vehicle_count_std"),
        F.countDistinct("location").alias("unique_locations"))


def date_range(readings: DataFrame) -> DataFrame:
    """First and last reading time and whole days between them."""
    r = readings.agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return r.select(F.date_format(event_time("_lo"), fmt).alias("start"),
                    F.date_format(event_time("_hi"), fmt).alias("end"),
                    F.floor((F.col("_hi") - F.col("_lo")) / 86400).alias("days"))


def _unpivot_row(one_row: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate with columns ``<field>__<name>`` into rows."""
    structs = [F.struct(F.lit(n).alias("column_name"),
                        *[F.col(f"{f}__{n}").alias(f) for f in fields]) for n in names]
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_values(readings: DataFrame, columns: Sequence[str] = READING_COLUMNS) -> DataFrame:
    """D3: null count and percentage (2 dp) per column, one scan."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"n_missing__{c}") for c in columns]
    one = readings.agg(*aggs)
    for c in columns:
        one = one.withColumn(f"pct_missing__{c}",
                             round_half_up(F.try_divide(F.col(f"n_missing__{c}"), F.col("_n")) * 100, 2))
    return _unpivot_row(one, columns, ("n_missing", "pct_missing"))


def duplicate_rows(readings: DataFrame, columns: Sequence[str] = READING_COLUMNS) -> DataFrame:
    """Rows beyond the first occurrence over all columns (nulls equal).
    The group-by is partial-aggregated map side before the shuffle."""
    return (readings.groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows")))


def value_ranges(readings: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Min, max, mean, sample std per numeric column (one scan)."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"),
                 F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}")]
    return _unpivot_row(readings.agg(*aggs), columns, ("min", "max", "mean", "std"))


def _long_numeric(readings: DataFrame, columns: Sequence[str], id_col: str | None) -> DataFrame:
    keep = [id_col] if id_col else []
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    return readings.select(*keep, F.explode(F.array(*structs)).alias("s")).select(*keep, "s.*")


def iqr_bounds(readings: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS,
               id_col: str | None = "reading_id", approx_accuracy: int | None = None) -> DataFrame:
    """Q1, Q3 and the 1.5 IQR fences per column (exact and distributed by
    default; ``approx_accuracy`` switches to one-pass sketches)."""
    long = _long_numeric(readings, columns, None)
    q = exact_quantiles(long, ["column_name"], "value", [0.25, 0.75], approx_accuracy=approx_accuracy)
    return (q.groupBy("column_name")
             .agg(F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
                  F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
             .withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumns({"lower_bound": F.col("q1") - IQR_FACTOR * F.col("iqr"),
                           "upper_bound": F.col("q3") + IQR_FACTOR * F.col("iqr")}))


def iqr_outliers(readings: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS,
                 id_col: str | None = "reading_id", approx_accuracy: int | None = None) -> DataFrame:
    """Number of values outside the IQR fences per numeric column.
    The bounds table has one row per column: broadcast is bounded."""
    bounds = iqr_bounds(readings, columns, id_col, approx_accuracy)
    long = _long_numeric(readings, columns, None)
    return (long.join(F.broadcast(bounds), "column_name")
            .groupBy("column_name", "q1", "q3", "lower_bound", "upper_bound")
            .agg(F.count_if((F.col("value") < F.col("lower_bound"))
                            | (F.col("value") > F.col("upper_bound"))).alias("outliers")))


def quality_score(readings: DataFrame, columns: Sequence[str] = READING_COLUMNS,
                  numeric: Sequence[str] = NUMERIC_COLUMNS, id_col: str | None = "reading_id") -> DataFrame:
    """``clamp(100 - issues / n * 100, 0, 100)``, status good above 80."""
    # row count and all null counts in one pass
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    n = readings.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_values"))
    dup = duplicate_rows(readings, columns)
    out = iqr_outliers(readings, numeric, id_col).agg(F.sum("outliers").alias("outliers"))
    # the other inputs are one-row aggregates: combine them as scalar subqueries
    r = n.select("n_rows", "missing_values",
                 dup.select("duplicate_rows").scalar().alias("duplicate_rows"),
                 out.select("outliers").scalar().alias("outliers"))
    issues = F.col("missing_values") + F.col("duplicate_rows") + F.col("outliers")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.try_divide(issues, F.col("n_rows")) * 100))
    return (r.withColumn("quality_score", score)
             .withColumn("status", F.when(F.col("quality_score") > QUALITY_GOOD_ABOVE, "good")
                         .otherwise("needs_attention")))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """Column name -> type (schema metadata, no job)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def column_types_frame(spark, df: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("column_name", T.StringType()),
                           T.StructField("data_type", T.StringType())])
    return spark.createDataFrame(column_types(df), schema)
