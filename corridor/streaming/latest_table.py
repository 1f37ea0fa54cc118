"""One row per key, the latest, as a log-structured table.

A micro-batch writes its own latest rows alone, hashed into buckets by key,
into the folder of its batch id (``delta``).  Reading merges these files with
the newest complete ``base``, which holds all batches up to its number.  When
the files since the base have grown to its size, they are merged into a new
base, so each row is rewritten a bounded number of times per doubling of the
table.  A base and files that it made superfluous stay until the base after
it, for readers that have listed them.

A batch that is replayed writes the same file again, or nothing if a base
already holds it, so replays change nothing; a base that was not finished is
not seen and is written anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folders ``n=<number>`` below ``path``."""
    hadoop, root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)
                  if "=" in s.getPath().getName() and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def _bytes(spark: SparkSession, path: str) -> int:
    _, root, fs = _folder(spark, path)
    return fs.getContentSummary(root).getLength() if fs.exists(root) else 0


def _drop(spark: SparkSession, path: str) -> None:
    _, root, fs = _folder(spark, path)
    fs.delete(root, True)


class LatestTable:
    """The table below ``path``: rows with the greatest ``order`` per ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "location", order: Sequence[str] = ("timestamp", "reading_id"),
                 buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, list(order), buckets

    def _top(self, rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c != "bucket"]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("bucket")
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*cols), F.struct(*self.order)).alias("r")).select("r.*").select("*", bucket)

    def _write(self, rows: DataFrame, kind: str, n: int) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/n={n}")

    def _parts(self) -> tuple[int, list[str]]:
        """The newest base's number (-1: none) and the folders that make the table."""
        base = max(_numbers(self.spark, f"{self.path}/base"), default=-1)
        later = [f"{self.path}/delta/n={n}" for n in _numbers(self.spark, f"{self.path}/delta") if n > base]
        return base, ([f"{self.path}/base/n={base}"] if base >= 0 else []) + later

    def read(self, key=None) -> DataFrame | None:
        """The table, or None before the first batch; with ``key`` only that
        key's row, from the files of its bucket."""
        _, parts = self._parts()
        rows = None
        for p in parts:
            part = self.spark.read.parquet(p)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return None
        if key is not None:
            k = F.lit(key).cast(rows.schema[self.key].dataType)
            rows = rows.where((F.col("bucket") == F.pmod(F.xxhash64(k), F.lit(self.buckets))) & (F.col(self.key) == k))
        return self._top(rows).drop("bucket")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in, and merge when the files have grown enough."""
        base, _ = self._parts()
        if batch_id <= base:
            return
        self._write(self._top(batch), "delta", batch_id)
        if self.grown() >= max(1, _bytes(self.spark, f"{self.path}/base/n={base}") if base >= 0 else 0) and base < batch_id - 1:
            self.compact(batch_id)

    def grown(self) -> int:
        """Bytes of the files since the base."""
        _, parts = self._parts()
        return sum(_bytes(self.spark, p) for p in parts if "/delta/" in p)

    def compact(self, upto: int) -> None:
        """Merge all batches up to ``upto`` into a new base."""
        before, _ = self._parts()
        rows = self.read()
        self._write(self._top(rows), "base", upto)
        for kind in ("base", "delta"):
            for n in _numbers(self.spark, f"{self.path}/{kind}"):
                if n < before or (kind == "delta" and n <= before):
                    _drop(self.spark, f"{self.path}/{kind}/n={n}")


def upsert_latest(spark: SparkSession, path: str, key: str = "location", order: Sequence[str] = ("timestamp", "reading_id"),
                  buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps one row per key, the latest."""
    return LatestTable(spark, path, key, order, buckets).add


def latest_version(spark: SparkSession, path: str, key: str = "location", order: Sequence[str] = ("timestamp", "reading_id")) -> DataFrame | None:
    """The table that ``upsert_latest`` keeps (None before its first batch)."""
    return LatestTable(spark, path, key, order).read()
