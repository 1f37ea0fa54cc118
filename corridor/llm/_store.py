"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a scratch
    folder is set for a ``local[...]`` master only; elsewhere this raises,
    because executors would not see one another's files."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corridor-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder, in folders of the
    values of ``by``, and read it back: lineage ends there, several readers
    share one computation, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
