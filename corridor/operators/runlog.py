"""Run-log statistics (D45), re-aimed at real run logs.

The reference times a simulated workflow; here the run log is what Spark
itself records: one row per micro-batch of a streaming query, appended to a
table by a listener, or one per job run appended by a scheduler.
Input columns: ``run_id`` and ``duration_ms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

IDEAL_MS = 100.0   # fixed value: the reference's ideal end-to-end time


def efficiency(duration_ms) -> F.Column:
    """``min(100, ideal / duration * 100)`` rounded to 2 dp."""
    d = F.col(duration_ms) if isinstance(duration_ms, str) else duration_ms
    return F.round(F.least(F.lit(100.0), F.try_divide(F.lit(IDEAL_MS), d) * 100), 2)


RUN_LOG_SCHEMA = "query string, run_id long, duration_ms double, input_rows long, late_rows long"


class RunLog(StreamingQueryListener):
    """Appends one row per micro-batch of the session's streaming queries to a
    table, however long they run (``recentProgress`` forgets all but the last
    batches), with the number of rows that came too late for the watermark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.runId), int(p.batchId), float(p.durationMs.get("triggerExecution", 0)), int(p.numInputRows),
               sum(int(o.numRowsDroppedByWatermark) for o in p.stateOperators))
        self.spark.createDataFrame([row], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The appended table; a batch that was reported again counts once."""
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path).dropDuplicates(["query", "run_id"])


def run_log_stats(log: DataFrame) -> DataFrame:
    """Mean / min / max duration, mean / best / range of efficiency and
    the score ``(mean eff / 100) * (100 / max(mean duration, 1)) * 100``."""
    e = log.withColumn("efficiency", efficiency("duration_ms"))
    a = e.agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_ms").alias("avg_duration_ms"),
              F.min("duration_ms").alias("min_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
              F.avg("efficiency").alias("avg_efficiency"), F.max("efficiency").alias("best_efficiency"),
              (F.max("efficiency") - F.min("efficiency")).alias("efficiency_range"))
    score = (F.col("avg_efficiency") / 100) * (100 / F.greatest(F.col("avg_duration_ms"), F.lit(1.0))) * 100
    return a.withColumn("performance_score", score).withColumn(
        "performance_band", F.when(F.col("performance_score") > 80, "excellent")
        .when(F.col("performance_score") > 60, "good").otherwise("poor"))
