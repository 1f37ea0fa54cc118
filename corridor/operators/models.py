"""Models: fit and score with Spark ML, evaluation and ensembles in SQL
(G3-G11, G13, C7, D42-D44, H1, H3, A5).

Evaluation works on a long prediction table ``(reading_id, model, actual,
predicted)``: every metric is a grouped aggregate, the confusion matrix is a
``groupBy(model, actual_band, predicted_band)``, and the inverse-MSE
ensemble is a join of the per-model weights (one row per model) back to the
predictions — no per-model driver loops over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.congestion import level_from_speed, speed_band_code
from ..session import stored
from .features import FEATURE_COLUMNS, apply_label_encoder

ENSEMBLE_EPS = 1e-8
DEFAULT_CONFIDENCE = 0.85  # of a model whose accuracy is unknown
SHIFT = 50.0  # sums of squares are taken about it, so that the variance keeps its digits
SEED = 42


def _assembler(cols: Sequence[str] = FEATURE_COLUMNS) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def random_forest(num_trees: int = 50, seed: int = SEED) -> Pipeline:
    """50 regression trees on the unscaled features."""
    return Pipeline(stages=[_assembler(), RandomForestRegressor(
        featuresCol="features", labelCol="average_speed_kmph", numTrees=num_trees, seed=seed)])


def gradient_boosting(max_iter: int = 50, seed: int = SEED) -> Pipeline:
    """50 boosting rounds."""
    return Pipeline(stages=[_assembler(), GBTRegressor(
        featuresCol="features", labelCol="average_speed_kmph", maxIter=max_iter, seed=seed)])


def linear_fallback() -> Pipeline:
    """G4 fall-back: linear regression on standardised features."""
    return Pipeline(stages=[_assembler(), StandardScaler(inputCol="features", outputCol="scaled",
                                                          withMean=True, withStd=True),
                            LinearRegression(featuresCol="scaled", labelCol="average_speed_kmph")])


def polynomial_regression(degree: int = 2) -> Pipeline:
    """Degree-2 expansion of standardised features + linear regression."""
    return Pipeline(stages=[_assembler(), StandardScaler(inputCol="features", outputCol="scaled",
                                                          withMean=True, withStd=True),
                            PolynomialExpansion(degree=degree, inputCol="scaled", outputCol="poly"),
                            LinearRegression(featuresCol="poly", labelCol="average_speed_kmph", regParam=1e-6)])


MODEL_BUILDERS = {"random_forest": random_forest, "gradient_boosting": gradient_boosting,
                  "polynomial_regression": polynomial_regression, "linear_regression": linear_fallback}


def train_models(features: DataFrame, names: Sequence[str]) -> dict[str, PipelineModel]:
    """G6 driver: fit each selected pipeline on the training rows.  A fit reads
    them many times, so they are stored once, with no other columns, in files
    of equal size, one per core, whatever the input's row groups are."""
    spark = features.sparkSession
    train = features.where(~F.col("is_test")).select(*FEATURE_COLUMNS, "average_speed_kmph")
    train = stored(train.repartition(spark.sparkContext.defaultParallelism), "training-rows")
    return {n: MODEL_BUILDERS[n]().fit(train) for n in names}


def predictions(models: dict[str, PipelineModel], features: DataFrame,
                id_col: str = "reading_id") -> DataFrame:
    """Long prediction table over the test rows, one row per (row, model)."""
    test = features.where(F.col("is_test"))
    out = None
    for name, m in models.items():
        p = m.transform(test).select(id_col, F.lit(name).alias("model"),
                                     F.col("average_speed_kmph").alias("actual"),
                                     F.col("prediction").alias("predicted"))
        out = p if out is None else out.unionByName(p)
    return out


def prediction_summary(preds: DataFrame) -> DataFrame:
    """The one pass over the predictions that evaluation needs: per (model,
    actual band, predicted band) the count and sums of the actual values,
    their squares and the squared errors; at most nine rows per model, stored
    so that all metrics are read from them."""
    a, e = F.col("actual"), F.col("actual") - F.col("predicted")
    shifted = a - SHIFT
    g = preds.groupBy("model", speed_band_code("actual").alias("actual_band"), speed_band_code("predicted").alias("predicted_band")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(e * e).alias("sq_error"), F.sum(shifted).alias("sum_actual"), F.sum(shifted * shifted).alias("sum_sq_actual"))
    return stored(g, "prediction-summary")


# What a field that a record lacks counts as.
RECORD_DEFAULTS = {"vehicle_count": 0, "location": "Location_A", "weather": "Sunny", "hour": 12, "day_of_week": 0, "month": 1,
                   "is_weekend": 0, "is_rush_hour": 0}


def score_records(records: DataFrame, models: dict[str, PipelineModel], encoders: dict[str, DataFrame],
                  accuracies: dict[str, float] | None = None) -> DataFrame:
    """Every model's speed for partly filled records, one row per (record,
    model) with the congestion level and the model's confidence (its accuracy,
    ``DEFAULT_CONFIDENCE`` where unknown).  Missing or null fields take
    ``RECORD_DEFAULTS``, labels that an encoder does not know the code 0."""
    filled = records
    for c, v in RECORD_DEFAULTS.items():
        given = F.col(c) if c in records.columns else F.lit(None)
        filled = filled.withColumn(c, F.coalesce(given.cast("string" if isinstance(v, str) else "int"), F.lit(v)))
    for c in ("location", "weather"):
        filled = apply_label_encoder(filled, encoders[c], c)
    out = None
    for name, m in models.items():
        p = m.transform(filled.withColumn("average_speed_kmph", F.lit(None).cast("double"))).select(
            *records.columns, F.lit(name).alias("model"), F.col("prediction").alias("speed"),
            level_from_speed("prediction").alias("congestion"),
            F.lit(float((accuracies or {}).get(name, DEFAULT_CONFIDENCE))).alias("confidence"))
        out = p if out is None else out.unionByName(p)
    return out


def evaluate(preds: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Mse, r2, and weighted precision/recall/F1 plus accuracy on the
    speed bands (0/1/2, out of range -> 1) of actual vs predicted."""
    cm = prediction_summary(preds) if summary is None else summary
    hit = F.col("actual_band") == F.col("predicted_band")
    reg = cm.groupBy("model").agg(
        F.sum("count").alias("n"), F.sum("sq_error").alias("_res"), F.sum("sum_actual").alias("_s"),
        F.sum("sum_sq_actual").alias("_ss"), F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("_hits"))
    reg = reg.withColumns({"mse": F.try_divide("_res", "n"), "accuracy": F.try_divide("_hits", "n"),
                           "r2": 1 - F.try_divide(F.col("_res"), F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n"))})
    # per-class support, true positives and predicted counts
    act = cm.groupBy("model", F.col("actual_band").alias("cls")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy("model", F.col("predicted_band").alias("cls")).agg(F.sum("count").alias("predicted_n"))
    tp = cm.where(hit).select("model", F.col("actual_band").alias("cls"), F.col("count").alias("tp"))
    per = (act.join(prd, ["model", "cls"], "full").join(tp, ["model", "cls"], "left")
           .na.fill(0, ["support", "predicted_n", "tp"])
           .withColumns({"prec": F.coalesce(F.try_divide(F.col("tp"), F.col("predicted_n")), F.lit(0.0)),
                         "rec": F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))})
           .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")),
                                        F.lit(0.0))))
    w = per.groupBy("model").agg(
        F.try_divide(F.sum(F.col("prec") * F.col("support")), F.sum("support")).alias("precision"),
        F.try_divide(F.sum(F.col("rec") * F.col("support")), F.sum("support")).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_score"))
    return reg.join(w, "model").select("model", "n", "mse", "r2", "accuracy", "precision", "recall", "f1_score")


def confusion_matrix(preds: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """3 x 3 counts in long form (model, actual_band, predicted_band, count)."""
    counts = prediction_summary(preds) if summary is None else summary
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(3) for b in range(3)])
    cells = counts.select("model").distinct().select("model", F.explode(grid).alias("g")) \
        .select("model", F.col("g.a").alias("actual_band"), F.col("g.b").alias("predicted_band"))
    return (cells.join(counts.select("model", "actual_band", "predicted_band", "count"), ["model", "actual_band", "predicted_band"], "left")
            .na.fill(0, ["count"]))


def ensemble_weights(preds: DataFrame) -> DataFrame:
    """weight = (1 / (mse + 1e-8)) / sum over models (one row per model)."""
    m = preds.groupBy("model").agg(F.avg((F.col("actual") - F.col("predicted")) ** 2).alias("mse"))
    m = m.withColumn("inv", 1.0 / (F.col("mse") + ENSEMBLE_EPS))
    return m.withColumn("weight", F.col("inv") / F.sum("inv").over(Window.partitionBy())).drop("inv")


def ensemble_predictions(preds: DataFrame, id_col: str = "reading_id", min_models: int = 2) -> DataFrame:
    """Inverse-MSE weighted sum per row; only with >= ``min_models``
    models (the weights table has one row per model: broadcast is bounded by
    the model count)."""
    w = ensemble_weights(preds).select("model", "weight")
    n_models = w.select(F.count(F.lit(1))).scalar()
    j = preds.join(F.broadcast(w), "model")
    return (j.groupBy(id_col).agg(F.first("actual").alias("actual"),
                                  F.sum(F.col("predicted") * F.col("weight")).alias("predicted"))
            .where(n_models >= min_models)
            .withColumn("model", F.lit("ensemble")))


def mean_prediction(preds: DataFrame, id_col: str = "reading_id") -> DataFrame:
    """Mean predicted speed over models per row -> congestion decisions."""
    from .decisions import light_timing, route_advice
    m = preds.groupBy(id_col).agg(F.avg("predicted").alias("mean_predicted_speed"))
    return m.withColumns({"congestion_level": level_from_speed("mean_predicted_speed"),
                          "timing": light_timing("mean_predicted_speed"),
                          "route": route_advice("mean_predicted_speed")})


def alignment(preds: DataFrame) -> DataFrame:
    """Actual vs predicted with error and the identity-line range per model."""
    rng = preds.groupBy("model").agg(F.least(F.min("actual"), F.min("predicted")).alias("line_min"),
                                     F.greatest(F.max("actual"), F.max("predicted")).alias("line_max"))
    return (preds.withColumn("error", F.col("predicted") - F.col("actual"))
            .join(rng, "model"))


def model_comparison(evaluation: DataFrame,
                     metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1_score")) -> DataFrame:
    """Per metric best, worst, mean, population std and best model
    (ties: first model name)."""
    long = evaluation.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")) \
        .select("model", "x.*")
    return long.groupBy("metric").agg(
        F.max("value").alias("best"), F.min("value").alias("worst"), F.avg("value").alias("average"),
        F.stddev_pop("value").alias("std"),
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"))


def proposed_vs_existing(evaluation: DataFrame, existing: Sequence[str]) -> DataFrame:
    """D44 + H1: mean accuracy and error (1 - accuracy) of the proposed vs the
    existing models (unionByName of the two groups), with the improvement."""
    typed = evaluation.withColumn("type", F.when(F.col("model").isin(*existing), "Existing").otherwise("Proposed"))
    g = typed.groupBy().agg(
        F.avg(F.when(F.col("type") == "Proposed", F.col("accuracy"))).alias("proposed_accuracy"),
        F.avg(F.when(F.col("type") == "Existing", F.col("accuracy"))).alias("existing_accuracy"))
    return g.withColumns({
        "accuracy_improvement_pct": F.try_divide(F.col("proposed_accuracy") - F.col("existing_accuracy"),
                                                 F.col("existing_accuracy")) * 100,
        "error_reduction_pct": F.try_divide((1 - F.col("existing_accuracy")) - (1 - F.col("proposed_accuracy")),
                                            1 - F.col("existing_accuracy")) * 100})


def latest_results(results: DataFrame, key: str = "model", order: str = "run_id") -> DataFrame:
    """H3: last-writer-wins merge of result sets (latest run per model)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def forest_uncertainty(model: PipelineModel, df: DataFrame) -> DataFrame:
    """G10 (re-aimed): mean and population std of the individual trees'
    predictions of a fitted random forest, per row.

    The trees (a fixed number of bounded size) travel to the workers as flat
    node arrays; one Arrow-batched function walks all of them for a whole
    batch, so the plan has one step however many trees there are."""
    forest = model.stages[-1]
    nodes = _flat_trees(forest)

    def walk(x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(nodes["root"], (len(x), len(nodes["root"]))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(nodes["depth"]):
            go_left = x[rows, nodes["feature"][at]] <= nodes["threshold"][at]
            at = np.where(go_left, nodes["left"][at], nodes["right"][at])
        return nodes["value"][at]

    @F.pandas_udf("prediction_mean double, prediction_std double")
    def spread(v: pd.Series) -> pd.DataFrame:
        p = walk(np.stack(v.to_numpy())) if len(v) else np.empty((0, len(nodes["root"])))
        return pd.DataFrame({"prediction_mean": p.mean(axis=1), "prediction_std": p.std(axis=1)})

    out = model.stages[0].transform(df).withColumn("_s", spread(vector_to_array("features")))
    return out.select("*", "_s.prediction_mean", "_s.prediction_std").drop("_s")


def _flat_trees(forest) -> dict:
    """All trees of a fitted forest as one node array; a leaf points to itself."""
    feature, threshold, left, right, value, root, depth = [], [], [], [], [], [], 0

    def add(node) -> int:
        i = len(feature)
        leaf = node.subtreeDepth() == 0
        feature.append(0 if leaf else node.split().featureIndex())
        threshold.append(0.0 if leaf else node.split().threshold())
        value.append(node.prediction())
        left.append(i)
        right.append(i)
        if not leaf:
            left[i] = add(node.leftChild())
            right[i] = add(node.rightChild())
        return i

    for tree in forest.trees:
        top = tree._call_java("rootNode")
        depth = max(depth, top.subtreeDepth())
        root.append(add(top))
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right),
            "value": np.array(value), "root": np.array(root), "depth": depth}


def feature_importance(spark, model: PipelineModel, names: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Importances of a fitted tree ensemble, sorted descending (the
    vector has one entry per feature, so this is bounded metadata)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    if len(imp) != len(names):
        return spark.createDataFrame([], "feature string, importance double")
    rows = sorted(zip(names, imp), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def save_models(models: dict[str, PipelineModel], prefix: str) -> None:
    """A5: one path per model name (the same name is used to load)."""
    for name, m in models.items():
        m.write().overwrite().save(f"{prefix}/{name}")


def load_models(prefix: str, names: Sequence[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{prefix}/{n}") for n in names}
