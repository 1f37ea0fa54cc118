"""Null keys, empty input, border cases and deployment of the core operators."""

import os
import subprocess
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corridor import session
from corridor.operators import decisions as D
from corridor.operators import detections as DT
from corridor.operators import isolation as IF
from corridor.operators import models as M
from corridor.operators import ordering as O
from corridor.operators import quality as Q
from corridor.operators import timeseries as TS
from corridor.sources import fixtures as V

SF = "/root/testdata/sf0.001"


def test_rank_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 4), ("a", 3, 3), ("a", 4, 2)], "location string, reading_id long, timestamp long")
    got = {r.reading_id: r["rank"] for r in O.with_group_rank(df, ["location"], ["timestamp"], "rank").collect()}
    assert got == {2: 0, 1: 1, 4: 0, 3: 1}


def test_series_features_keep_null_locations(spark):
    r = V.readings(spark, SF).withColumn("location", F.when(F.col("reading_id") % 3 != 0, F.col("location")))
    f = TS.lag_features(r.select("reading_id", "location", "timestamp", "average_speed_kmph"), chunk_rows=64)
    assert f.count() == r.count()
    pdf = r.select("reading_id", "location", "timestamp", "average_speed_kmph").toPandas().sort_values(["timestamp", "reading_id"])
    pdf["want"] = pdf.groupby(pdf.location.fillna("?"))["average_speed_kmph"].shift(3)
    got = f.select("reading_id", "average_speed_kmph_lag_3").toPandas().merge(pdf, on="reading_id")
    assert np.allclose(got.average_speed_kmph_lag_3.astype(float), got.want, equal_nan=True)


@pytest.mark.parametrize("n,accuracy", [(1, 10000), (2, 10000), (49, 10000), (1000, 100), (20000, 100)])
def test_bracketed_quantiles_are_exact(spark, n, accuracy):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": rng.choice(["a", None], n, p=[0.3, 0.7]), "v": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))})
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.quantile for r in O.exact_quantiles(spark.createDataFrame(pdf, "g string, v double"), ["g"], "v", probs, bracket_accuracy=accuracy).collect()}
    for g, part in pdf.groupby(pdf.g.fillna("?")):
        for p in probs:
            assert got[None if g == "?" else g, p] == pytest.approx(np.quantile(part.v, p), abs=1e-12)


def test_forest_does_not_depend_on_files(spark):
    r = V.readings(spark, SF).select("reading_id", "average_speed_kmph", "vehicle_count")
    one = IF.fit(r.coalesce(1), ["average_speed_kmph", "vehicle_count"], "reading_id", n_trees=20)
    many = IF.fit(r.repartition(8), ["average_speed_kmph", "vehicle_count"], "reading_id", n_trees=20)
    a, b = (m["nodes"].sort_values(["tree_id", "node_id"]).reset_index(drop=True) for m in (one, many))
    assert (a[["tree_id", "node_id", "feature", "size", "depth"]] == b[["tree_id", "node_id", "feature", "size", "depth"]]).all().all()
    assert np.allclose(a.threshold, b.threshold)


def test_forest_uses_rows_of_large_tables_alike(spark):
    big = spark.range(200000).select(F.col("id").alias("reading_id"), (F.xxhash64("id") % 1000 / 10.0).alias("v"))
    m = IF.fit(big, ["v"], "reading_id", n_trees=30)
    assert len(m["sizes"]) == 30 and min(m["sizes"].values()) > 200


def test_empty_input(spark):
    none = V.readings(spark, SF).limit(0)
    assert [(r.start, r.end, r.intensity) for r in TS.peak_hours(none).orderBy("period").collect()] == [
        (7, 9, "High"), (12, 13, "Medium"), (17, 19, "High")]
    t = D.adaptive_timing(none).collect()
    assert [(r.green, r.yellow, r.red) for r in t] == [(30, 5, 25)]
    assert all(r.pct_missing is None and r.n_missing == 0 for r in Q.missing_values(none).collect())
    assert TS.peak_hours(V.readings(spark, SF).withColumn("vehicle_count", F.lit(0))).count() > 0


@pytest.mark.parametrize("text,want", [("0", "1970-01-01 00:00:00"), ("1700000000.9", "2023-11-14 22:13:20"), ("1e30", "Invalid timestamp"),
                                       ("inf", "Invalid timestamp"), ("nan", "Invalid timestamp"), ("x", "Invalid timestamp"), (None, "Invalid timestamp")])
def test_format_timestamp(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(D.format_timestamp(F.col("t")).alias("f")).first().f == want


def test_smoothing_against_dense_convolution(spark):
    cells = [(0, 0, 3.0), (1, 0, 1.0), (127, 71, 2.0), (64, 30, 5.0), (126, 1, 1.5)]
    grid = spark.createDataFrame([(0, 0, x, y, w) for x, y, w in cells], "camera_id long, frame_id long, gx int, gy int, weight double")
    dense = np.zeros((72, 128))
    for x, y, w in cells:
        dense[y, x] = w
    padded = np.pad(dense, 2, mode="reflect")
    k = np.array([1, 4, 6, 4, 1]) / 16
    want = sum(k[i] * k[j] * padded[j:j + 72, i:i + 128] for i in range(5) for j in range(5))
    got = np.zeros_like(dense)
    for r in DT.smoothed_grid(grid).collect():
        got[r.gy, r.gx] = r.weight
    assert np.allclose(got, want)


def test_zero_area_and_small_gates(spark):
    v = spark.createDataFrame([(0, 0, 1, 5, 10, 10, 0), (0, 1, 2, 5, 10, 10, 0)],
                              "camera_id long, frame_id long, det_id long, track_id long, cx int, cy int, area int")
    assert all(r.density == 0.0 for r in DT.density_grid(v).collect())
    assert [(r.det_id, r.prev_det_id) for r in DT.track_matches(v, gate=0.5).collect()] == [(2, 1)]


def test_record_defaults(spark):
    assert M.RECORD_DEFAULTS["hour"] == 12 and M.DEFAULT_CONFIDENCE == 0.85


def test_shared_folder_is_required_off_local_masters():
    for master in ("local", "local[4]", "local[*]"):
        session.require_local(master)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            session.require_local(master)


def test_workers_without_the_package():
    """Python stages run where only the driver can import the package."""
    code = """
import os, sys
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
q = e.queries()
for name in ("g12_isolation_forest_scores", "b25_payload_roundtrip", "d34_congestion_hotspots"):
    q[name](spark, "/root/testdata/sf0.001").collect()
print("done")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code, root], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=240)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
