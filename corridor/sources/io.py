"""Readers and writers.

Readers use explicit schemas (no inference pass over the data); writers
produce splittable, partitioned output and are safe to re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS_CSV_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("location", T.StringType()),
    T.StructField("weather", T.StringType()),
    T.StructField("vehicle_count", T.IntegerType()),
    T.StructField("average_speed_kmph", T.DoubleType()),
    T.StructField("_corrupt_record", T.StringType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("mse", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1_score", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("predictions", T.ArrayType(T.DoubleType())),
])


def load_readings_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A1: header CSV of readings; malformed lines are kept in
    ``_corrupt_record`` (PERMISSIVE) instead of failing the job.  A missing
    path gives ``None``, like the reference's loader."""
    from pyspark.errors import AnalysisException
    try:
        return (spark.read.schema(READINGS_CSV_SCHEMA).option("header", "true").option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    except AnalysisException:
        return None


def save_results_json(results: DataFrame, path: str) -> None:
    """A3 save: model results as JSON lines (model objects are not data)."""
    results.write.mode("overwrite").json(path)


def load_results_json(spark: SparkSession, path: str, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    """A3 load: the same results back, arrays intact."""
    return spark.read.schema(schema).json(path)


def export_results_csv(results: DataFrame, path: str) -> None:
    """A4: one row per model, nested columns (arrays, maps, structs) dropped."""
    flat = [f.name for f in results.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    results.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def append_history(df: DataFrame, path: str, partition_col: str = "run_date", run_id: str | None = None, files_per_date: int = 8) -> None:
    """A9 (batch): add a run's alerts / results, partitioned by date.  A date's
    rows are spread over at most ``files_per_date`` tasks, each with one file.
    With a ``run_id`` the run has a folder of its own below its dates, so
    replaying it replaces its rows instead of adding them again."""
    if partition_col not in df.columns:
        df = df.withColumn(partition_col, F.current_date())
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed), F.lit(files_per_date))
    w = df.repartition(partition_col, part)
    if run_id is None:
        w.write.mode("append").partitionBy(partition_col).parquet(path)
    else:
        (w.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", partition_col).parquet(path))


def write_readings_by_date(readings: DataFrame, path: str, seconds: str = "timestamp", files_per_date: int = 8) -> None:
    """Write readings partitioned by UTC date, so date filters prune whole
    directories (partition pruning) before any file is opened.  A date's rows
    are spread over at most ``files_per_date`` tasks, each with one file."""
    part = F.pmod(F.xxhash64(seconds), F.lit(files_per_date))
    dated = readings.withColumn("date", F.to_date(F.timestamp_seconds(seconds)))
    dated.repartition("date", part).write.mode("overwrite").partitionBy("date").parquet(path)


def read_readings_by_date(spark: SparkSession, path: str, start: str | None = None,
                          end: str | None = None) -> DataFrame:
    """Read a date-partitioned readings table; the date range becomes a
    partition filter."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df
