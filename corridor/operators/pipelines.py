"""Saved pipelines and the uncertainty of any model.

A fitted pipeline takes raw readings, or records that lack some fields, to a
speed: defaults, calendar features, label codes, assembler and model are its
stages, and all that was learned is written below one path.  Label codes are
a table of their own, written as Parquet beside the stage's metadata, so a
large label set passes through no driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.congestion import level_from_speed
from ..functions.time import add_time_features
from ..session import cpu_partitions, stored
from . import models as M
from .features import apply_label_encoder, label_encoder


CALENDAR = ("hour", "day_of_week", "month", "is_weekend", "is_rush_hour")


class ReadingFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """G1: calendar features of a reading with a time; fields that a record
    lacks, or has as null, take the defaults of ``models.RECORD_DEFAULTS``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        if "timestamp" in df.columns:
            # a field that a record has of its own stays
            own = [c for c in CALENDAR if c in df.columns]
            df = add_time_features(df.withColumnsRenamed({c: f"_own_{c}" for c in own}))
            for c in own:
                df = df.withColumn(c, F.coalesce(F.col(f"_own_{c}").cast("int"), c)).drop(f"_own_{c}")
        for c, v in M.RECORD_DEFAULTS.items():
            there = F.col(c) if c in df.columns else F.lit(None)
            df = df.withColumn(c, F.coalesce(there.cast("string" if isinstance(v, str) else "int"), F.lit(v)))
        return df


class LabelCoder(Estimator, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """B4 as a stage: alphabetical codes of a column's labels."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> LabelCoderModel:
        model = LabelCoderModel(label_encoder(df, self.getInputCol()))
        return model._set(inputCol=self.getInputCol())


class LabelCoderModel(Model, HasInputCol, MLReadable, MLWritable):
    """The codes (label, code); a label that they lack has code 0."""

    def __init__(self, codes: DataFrame | None = None):
        super().__init__()
        self.codes = codes

    def _transform(self, df: DataFrame) -> DataFrame:
        return apply_label_encoder(df, self.codes, self.getInputCol())

    def write(self) -> MLWriter:
        return _CoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CoderReader()


class _CoderWriter(MLWriter):
    def __init__(self, instance: LabelCoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.codes.write.parquet(f"{path}/codes")


class _CoderReader(MLReader):
    def load(self, path: str) -> LabelCoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LabelCoderModel(self.sparkSession.read.parquet(f"{path}/codes"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def reading_pipeline(name: str, **how) -> Pipeline:
    """Raw readings to the speed of model ``name``, as one pipeline."""
    return Pipeline(stages=[ReadingFeatures(), LabelCoder(inputCol="location"), LabelCoder(inputCol="weather"),
                            *M.MODEL_BUILDERS[name](**how).getStages()])


def fit_readings(readings: DataFrame, names: Sequence[str]) -> dict[str, PipelineModel]:
    """G6 on raw readings: one pipeline per model."""
    rows = stored(readings, "pipeline-readings")
    return {n: reading_pipeline(n).fit(rows) for n in names}


def score_readings(models: dict[str, PipelineModel], readings: DataFrame) -> DataFrame:
    """One row per (reading, model) with the predicted speed and its
    congestion level, from readings or partial records as they come."""
    out = None
    for name, m in models.items():
        p = m.transform(readings).select(*[F.col(c) for c in readings.columns if c != "prediction"], F.lit(name).alias("model"),
                                         F.col("prediction").alias("speed"), level_from_speed("prediction").alias("congestion"))
        out = p if out is None else out.unionByName(p)
    return out


# --- G10 -------------------------------------------------------------------

def poisson_weight(id_col: str, member: int, seed: int = M.SEED) -> Column:
    """A Poisson(1) number from a hash of row id, member and seed: how often a
    bootstrap sample of this member has the row."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(member), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    steps, p, upto = [], 0.36787944117144233, 0.0  # exp(-1)
    for k in range(1, 18):
        upto += p
        steps.append(F.when(u > upto, 1.0).otherwise(0.0))
        p /= k
    return sum(steps, F.lit(0.0))


def bootstrap(name: str, train: DataFrame, members: int = 10, id_col: str = "reading_id", seed: int = M.SEED, **how) -> list[PipelineModel]:
    """``members`` fits of model ``name``, each on a bootstrap sample of
    ``train`` (model features) that row weights express, so no row is copied.
    Weights depend on row ids alone, and rows are dealt and ordered by id, so
    reruns and other file layouts give equal members."""
    rows = train.repartition(cpu_partitions(train.sparkSession), id_col).sortWithinPartitions(id_col)
    rows = stored(rows, "bootstrap-rows").repartition(cpu_partitions(train.sparkSession), id_col).sortWithinPartitions(id_col)
    fitted = []
    for b in range(members):
        pipe = M.MODEL_BUILDERS[name](**how)
        pipe.getStages()[-1].setWeightCol("_weight")
        fitted.append(pipe.fit(rows.withColumn("_weight", poisson_weight(id_col, b, seed)).where("_weight > 0")))
    return fitted


def with_uncertainty(fitted: list[PipelineModel], df: DataFrame) -> DataFrame:
    """``df`` with the mean and population standard deviation of the members'
    predictions (``prediction_mean``, ``prediction_std``), in one pass."""
    own, names = df.columns, []
    for i, m in enumerate(fitted):
        df = m.transform(df).withColumnRenamed("prediction", f"_member{i}")
        names.append(f"_member{i}")
        df = df.select(*own, *names)
    each = F.array(*names)
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(names)
    df = df.withColumn("prediction_mean", mean)
    spread = F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - F.col("prediction_mean")) * (x - F.col("prediction_mean"))) / len(names)
    return df.withColumn("prediction_std", F.sqrt(spread)).drop(*names)
