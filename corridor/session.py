"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every corridor job relies on: UTC wall clock (all timestamps are
# Unix seconds), adaptive execution so join strategy, partition coalescing
# and skewed-partition splitting are decided on runtime statistics.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed state variables (lists, maps, timers) live in this state store
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    # delete checkpoint files once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "corridor",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return a session with corridor's required settings.

    ``master`` is only for local runs; on a cluster leave it ``None`` so the
    launcher decides.  The shuffle partition count should follow the data
    size (roughly input bytes / 128 MB) — AQE coalesces small partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  Only a ``local[...]``
    master may leave it unset (tests): it then gets a fresh scratch folder.
    Elsewhere this raises, because executors would write where the others
    cannot read."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        require_local(sc.master)
        path = tempfile.mkdtemp(prefix="corridor-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def require_local(master: str) -> None:
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.  Lineage ends
    there, and the planner sees the file's true size, so a small table is
    broadcast under the usual threshold and a large one is not."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cpu_partitions(spark: SparkSession) -> int:
    """Partition count for Python-heavy stages (grouped pandas work, key
    derivation): at least one per core.  Used with an explicit
    ``repartition(n, keys)``, which adaptive execution keeps as asked instead
    of coalescing small-but-CPU-heavy partitions into one task."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spark.sparkContext.defaultParallelism, shuffle)
