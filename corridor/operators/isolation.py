"""Isolation forest (G12; Liu, Ting & Zhou, ICDM 2008) on Spark.

MLlib has no isolation forest, so:

* fit: every row joins each tree with the same probability, decided by
  hashes of (tree, row id) alone, so the forest depends neither on the
  table's size nor on its files; each tree keeps at most ``sample_size``
  of its rows and is grown by ``groupBy(tree_id).applyInPandas`` with numpy — one
  task per tree, each holding <= 256 rows;
* the forest (trees x at most 2 * sample_size - 1 nodes: bounded by the
  parameters, not the data) is collected and broadcast;
* scoring is an Arrow-batched ``pandas_udf`` that walks all trees for a
  whole batch of rows with vectorised numpy;
* the anomaly threshold is the exact (distributed) (1 - contamination)
  quantile of the training scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import exact_quantiles

N_TREES = 200
SAMPLE_SIZE = 256
CONTAMINATION = 0.1
SEED = 42
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(tree_id: int, x: np.ndarray, seed: int):
    rng = np.random.default_rng(seed * 1_000_003 + tree_id)
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    nodes = []

    def build(idx, depth):
        node_id = len(nodes)
        nodes.append(None)
        pts = x[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[node_id] = (tree_id, node_id, -1, 0.0, -1, -1, len(idx), depth)
            return node_id
        spread = pts.max(axis=0) - pts.min(axis=0)
        cand = np.flatnonzero(spread > 0)
        if len(cand) == 0:
            nodes[node_id] = (tree_id, node_id, -1, 0.0, -1, -1, len(idx), depth)
            return node_id
        f = int(rng.choice(cand))
        thr = float(rng.uniform(pts[:, f].min(), pts[:, f].max()))
        go_left = pts[:, f] < thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[node_id] = (tree_id, node_id, f, thr, left, right, len(idx), depth)
        return node_id

    build(np.arange(len(x)), 0)
    return nodes


def _scaled(df: DataFrame, features: Sequence[str], stats) -> list:
    """Standardise with population std (1 where the std is 0)."""
    cols = []
    for i, c in enumerate(features):
        mean, std = stats[2 * i], stats[2 * i + 1]
        std = std if std else 1.0
        cols.append(((F.col(c).cast("double") - F.lit(mean)) / F.lit(std)).alias(f"_f{i}"))
    return cols


def fit(df: DataFrame, features: Sequence[str], id_col: str, n_trees: int = N_TREES,
        sample_size: int = SAMPLE_SIZE, seed: int = SEED) -> dict:
    """Grow the forest; returns the (bounded) model: scaling stats, nodes, sizes."""
    aggs = []
    for c in features:
        aggs += [F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double"))]
    head = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    n, stats = head[0], list(head[1:])
    # Each row is in each tree with probability p, whatever the table's size.
    # A row's first tree is geometric, drawn from one hash; most rows have
    # none and stop there, and only the others try the trees after it.
    p = min(1.0 - 1e-9, 1.5 * sample_size / max(n, 1))
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    start = F.floor(F.log(1 - u) / math.log1p(-p))
    last = F.lit(n_trees - 1).cast("long")
    cols = _scaled(df, features, stats)
    trees = F.filter(
        F.transform(F.sequence(F.col("_start"), last),
                    lambda t: F.struct(t.alias("t"), F.xxhash64(t, F.col(id_col), F.lit(seed)).alias("h"))),
        lambda s: (s["t"] == F.col("_start")) | (F.pmod(s["h"], F.lit(1 << 30)) < F.lit(int(p * (1 << 30)))))
    cand = (df.select(id_col, *cols, start.alias("_start")).where(F.col("_start") <= last)
            .select(*[f"_f{i}" for i in range(len(features))], F.explode(trees).alias("m")).select("*", "m.t", "m.h").drop("m"))
    from pyspark.sql import Window
    from ..session import cpu_partitions
    # One explicit hash partitioning by tree serves both the top-k window and
    # the grouped fit, and is not coalesced away: trees grow on all cores.
    cand = cand.repartition(min(n_trees, cpu_partitions(df.sparkSession)), "t")
    cand = (cand.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy("h")))
            .where(F.col("_r") <= sample_size).drop("_r", "h"))
    k = len(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["t"].iloc[0])
        x = pdf[[f"_f{i}" for i in range(k)]].to_numpy(dtype=float)
        return pd.DataFrame(_grow(tid, x, seed),
                            columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "size", "depth"])

    nodes = cand.groupBy("t").applyInPandas(grow, NODE_SCHEMA).toPandas()
    sizes = nodes[nodes["node_id"] == 0].set_index("tree_id")["size"].to_dict()
    return {"features": list(features), "stats": stats, "nodes": nodes, "sizes": sizes}


def _compile(nodes: pd.DataFrame) -> dict:
    """All trees as one flat node array (child indices made global) plus the
    path length credited at each node when it is a leaf: depth + c(size)."""
    t = nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    base = np.arange(len(t)) - t["node_id"].to_numpy()   # row of each tree's root
    leaf = t["feature"].to_numpy() < 0
    left = np.where(leaf, np.arange(len(t)), t["left"].to_numpy() + base)
    right = np.where(leaf, np.arange(len(t)), t["right"].to_numpy() + base)
    roots = np.flatnonzero(t["node_id"].to_numpy() == 0)
    credit = t["depth"].to_numpy() + np.array([_c(float(n)) for n in t["size"].to_numpy()])
    return {"feature": np.where(leaf, 0, t["feature"].to_numpy()), "threshold": t["threshold"].to_numpy(),
            "left": left, "right": right, "credit": credit, "roots": roots,
            "max_depth": int(t["depth"].max())}


def _path_lengths(forest: dict, x: np.ndarray) -> np.ndarray:
    """Walk every tree for every row at once: ``idx`` is (rows x trees);
    leaves point to themselves, so extra steps are no-ops."""
    idx = np.broadcast_to(forest["roots"], (len(x), len(forest["roots"]))).copy()
    rows = np.arange(len(x))[:, None]
    feat, thr, left, right = forest["feature"], forest["threshold"], forest["left"], forest["right"]
    for _ in range(forest["max_depth"]):
        go_left = x[rows, feat[idx]] < thr[idx]
        idx = np.where(go_left, left[idx], right[idx])
    return forest["credit"][idx].mean(axis=1)


def score(df: DataFrame, model: dict, out: str = "if_score") -> DataFrame:
    """Anomaly score ``2 ** (-E[h(x)] / c(sample size))`` per row (higher =
    more anomalous), computed in Arrow batches."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(_compile(model["nodes"]))
    c_n = _c(float(np.mean(list(model["sizes"].values()))))

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        h = _path_lengths(bc.value, x)
        return pd.Series(np.power(2.0, -h / c_n))

    cols = _scaled(df, model["features"], model["stats"])
    return df.withColumn(out, _score(*[c for c in cols]))


def fit_detector(df: DataFrame, features: Sequence[str], id_col: str, contamination: float = CONTAMINATION, **kw) -> tuple[dict, DataFrame]:
    """(forest with its ``threshold``, the scored training rows).  The
    threshold is the exact (1 - contamination) quantile of their scores."""
    from ..session import cpu_partitions, stored
    # The input is read twice for the fit and once for the scores, which feed
    # both the threshold and the output: each is written once.  Scoring is CPU
    # work, so rows are dealt over the cores whatever files they come in.
    df = stored(df.repartition(cpu_partitions(df.sparkSession), id_col), "forest-input")
    model = fit(df, features, id_col, **kw)
    s = stored(score(df, model), "forest-scores")
    thr = exact_quantiles(s.select("if_score"), [], "if_score", [1.0 - contamination])
    return model | {"threshold": float(thr.select("quantile").first()[0])}, s   # a single number


def flag(df: DataFrame, model: dict) -> DataFrame:
    """Score and flag rows of a table or stream with a fitted detector."""
    return score(df, model).withColumn("is_ml_anomaly", F.col("if_score") > F.lit(model["threshold"]))


def detect(df: DataFrame, features: Sequence[str], id_col: str, contamination: float = CONTAMINATION,
           **kw) -> DataFrame:
    """Fit, score and flag the top ``contamination`` share as
    ``ml_pattern_anomaly``."""
    model, s = fit_detector(df, features, id_col, contamination, **kw)
    return s.withColumn("is_ml_anomaly", F.col("if_score") > F.lit(model["threshold"]))


def save_detector(spark: SparkSession, model: dict, path: str, version: int) -> None:
    """A5: a detector as two tables, its nodes and one row of the rest, in the
    folder of its version; a version that is written again is replaced."""
    at = f"{path}/version={version}"
    spark.createDataFrame(model["nodes"], NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{at}/nodes")
    rest = [(model["features"], [float(x) for x in model["stats"]], float(model["threshold"]))]
    spark.createDataFrame(rest, "features array<string>, stats array<double>, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{at}/model")


def load_detector(spark: SparkSession, path: str, version: int) -> dict:
    """A saved detector (its nodes are bounded by the fit's parameters)."""
    at = f"{path}/version={version}"
    nodes, rest = spark.read.parquet(f"{at}/nodes").toPandas(), spark.read.parquet(f"{at}/model").first()
    sizes = nodes[nodes["node_id"] == 0].set_index("tree_id")["size"].to_dict()
    return {"features": list(rest["features"]), "stats": list(rest["stats"]), "nodes": nodes, "sizes": sizes, "threshold": rest["threshold"]}
