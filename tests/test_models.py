"""Saved pipelines, bootstrap uncertainty, saved forests, the latest-row table
and small guards."""

import hashlib
import hmac
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from corridor.operators import features as FE
from corridor.operators import isolation as IF
from corridor.operators import models as M
from corridor.operators import pipelines as PL
from corridor.operators import security as SEC
from corridor.operators import sensors as SN
from corridor.sources import fixtures as V
from corridor.sources import io as IO
from corridor.streaming import readings_stream as RS
from corridor.streaming.latest_table import LatestTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def readings(spark):
    return V.readings(spark, SF)


def _speeds(df, by="reading_id"):
    return {(r[by], r.model): r.speed for r in df.collect()}


def test_saved_pipelines_score_raw_readings(spark, readings):
    """A loaded pipeline scores what the fitted one scores: raw readings,
    labels it has not seen, records that lack fields."""
    train = readings.where("reading_id % 5 <> 0")
    names = ["linear_regression", "polynomial_regression", "random_forest"]
    fitted = PL.fit_readings(train, names)
    d = tempfile.mkdtemp(prefix="corridor-pipe-")
    M.save_models(fitted, d)
    M.save_models(fitted, d)                       # saving again replaces
    back = {n: PipelineModel.load(f"{d}/{n}") for n in names}
    test = readings.where("reading_id % 5 = 0").withColumn("location", F.when(F.col("reading_id") % 2 == 0, "Nowhere").otherwise(F.col("location")))
    a, b = _speeds(PL.score_readings(fitted, test)), _speeds(PL.score_readings(back, test))
    assert a == b and len(a) == 3 * test.count() and None not in a.values()
    # an unknown label counts as the first one, as without a pipeline
    as_first = _speeds(PL.score_readings(back, test.withColumn("location", F.when(F.col("location") == "Nowhere", "Location_A").otherwise(F.col("location")))))
    assert as_first == b
    # the same speeds as on features made by hand
    f = FE.train_test_split(FE.model_features(train)).withColumn("is_test", F.lit(False))
    by_hand = M.train_models(f, ["linear_regression"])["linear_regression"]
    rest = by_hand.transform(FE.model_features(train)).select("reading_id", "prediction")
    got = _speeds(PL.score_readings({"linear_regression": back["linear_regression"]}, train))
    for r in rest.collect():
        assert got[(r.reading_id, "linear_regression")] == pytest.approx(r.prediction, abs=1e-6)
    # records without fields take the defaults
    part = spark.createDataFrame([(1, 30, None), (2, None, "Rainy")], "reading_id long, vehicle_count int, weather string")
    full = spark.createDataFrame([(1, 30, "Sunny"), (2, 0, "Rainy")], "reading_id long, vehicle_count int, weather string").withColumns(
        {c: F.lit(v) for c, v in M.RECORD_DEFAULTS.items() if c not in ("vehicle_count", "weather")})
    assert _speeds(PL.score_readings(back, part)) == _speeds(PL.score_readings(back, full))


def test_saved_pipeline_in_a_new_process(spark, readings):
    d = tempfile.mkdtemp(prefix="corridor-pipe-")
    M.save_models(PL.fit_readings(readings, ["linear_regression"]), d)
    rows = readings.where("reading_id < 40")
    rows.write.parquet(f"{d}/rows")
    here = _speeds(PL.score_readings({"linear_regression": PipelineModel.load(f"{d}/linear_regression")}, rows))
    code = (f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
            "from corridor.session import build_session\n"
            "s = build_session('local[1]', shuffle_partitions=2)\n"
            "from pyspark.ml import PipelineModel\n"
            "from corridor.operators import pipelines as PL\n"
            f"m = {{'linear_regression': PipelineModel.load({d!r} + '/linear_regression')}}\n"
            f"PL.score_readings(m, s.read.parquet({d!r} + '/rows')).select('reading_id', 'model', 'speed').write.parquet({d!r} + '/out')\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    assert _speeds(spark.read.parquet(f"{d}/out")) == here


@pytest.mark.parametrize("name,how", [("polynomial_regression", {}), ("gradient_boosting", {"max_iter": 2})])
def test_bootstrap_uncertainty(spark, readings, name, how):
    """Members differ, and neither a rerun nor another file layout changes them."""
    f = FE.train_test_split(FE.model_features(readings))
    f = f.withColumn("average_speed_kmph", 80 - F.col("vehicle_count") * 0.25 - F.col("is_rush_hour") * 8 + F.col("reading_id") % 7)
    d = tempfile.mkdtemp(prefix="corridor-boot-")
    f.where("not is_test").repartition(3).write.parquet(f"{d}/a")
    f.where("not is_test").orderBy(F.desc("vehicle_count")).coalesce(1).write.parquet(f"{d}/b")
    test = f.where("is_test")
    spread = []
    for layout in ("a", "b"):
        members = PL.bootstrap(name, spark.read.parquet(f"{d}/{layout}"), members=2, **how)
        u = PL.with_uncertainty(members, test)
        assert u.columns == [*test.columns, "prediction_mean", "prediction_std"]
        spread.append({r.reading_id: (r.prediction_mean, r.prediction_std) for r in u.collect()})
    assert spread[0].keys() == spread[1].keys() and len(spread[0]) == test.count()
    assert max(s for _, s in spread[0].values()) > 0
    for k, (m, s) in spread[0].items():
        assert spread[1][k] == (pytest.approx(m, rel=1e-6), pytest.approx(s, rel=1e-6, abs=1e-6))
    each = [{r.reading_id: r.prediction for r in m.transform(test).collect()} for m in members]
    for k, (m, s) in spread[1].items():
        x = [e[k] for e in each]
        assert m == pytest.approx(sum(x) / 2) and s == pytest.approx((sum((v - m) ** 2 for v in x) / 2) ** 0.5, abs=1e-6)


def test_poisson_weights(spark):
    """Mean and variance one, members independent."""
    df = spark.range(40000).withColumnRenamed("id", "reading_id")
    r = df.select(PL.poisson_weight("reading_id", 0).alias("a"), PL.poisson_weight("reading_id", 1).alias("b")).agg(
        F.avg("a").alias("m"), F.var_pop("a").alias("v"), F.corr("a", "b").alias("c"), F.avg((F.col("a") == 0).cast("int")).alias("z")).first()
    assert abs(r.m - 1) < 0.03 and abs(r.v - 1) < 0.05 and abs(r.c) < 0.02 and abs(r.z - 0.3679) < 0.01


def test_saved_forest_scores_tables_and_streams(spark, readings):
    """A loaded detector equals the fitted one, on a table and on a stream."""
    features = ["vehicle_count", "average_speed_kmph"]
    model, scored = IF.fit_detector(readings, features, "reading_id", n_trees=30)
    d = tempfile.mkdtemp(prefix="corridor-forest-")
    IF.save_detector(spark, model, d, 1)
    IF.save_detector(spark, model | {"threshold": 0.0}, d, 2)
    IF.save_detector(spark, model, d, 1)
    back = IF.load_detector(spark, d, 1)
    assert back["threshold"] == model["threshold"] and IF.load_detector(spark, d, 2)["threshold"] == 0.0
    want = {r.reading_id: r.if_score for r in scored.collect()}
    got = {r.reading_id: (r.if_score, r.is_ml_anomaly) for r in IF.flag(readings, back).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    assert sum(v[1] for v in got.values()) == IF.detect(readings, features, "reading_id", n_trees=30).where("is_ml_anomaly").count()
    readings.select([f.name for f in RS.READING_SCHEMA.fields]).repartition(3).write.parquet(f"{d}/in")
    s = RS.scored_by_forest(RS.read_readings(spark, f"{d}/in", max_files_per_trigger=1), back)
    s.writeStream.format("memory").queryName("j6_forest").trigger(availableNow=True).start().awaitTermination()
    assert {r.reading_id: (r.if_score, r.is_ml_anomaly) for r in spark.table("j6_forest").collect()} == got


# --- J10 ---------------------------------------------------------------------

def _latest(rows):
    out = {}
    for r in rows:
        if r[0] not in out or r[1:3] > out[r[0]][1:3]:
            out[r[0]] = r
    return sorted(out.values(), key=str)


SCHEMA = "location string, timestamp long, reading_id long, speed double"


def test_latest_table_follows_its_batches(spark):
    """Any order and replay of batches gives the latest rows; a batch writes
    what it holds, and merging is rare."""
    import random
    rng = random.Random(6)
    d = tempfile.mkdtemp(prefix="corridor-latest-")
    t, seen, merges, sizes = LatestTable(spark, d, buckets=4), [], 0, []
    assert t.read() is None
    first = [(f"L{i}", 1000, i, 1.0) for i in range(3000)] + [(None, 5, 7, 1.0)]
    for n in range(9):
        batch = first if n == 0 else [(f"L{rng.randrange(3000)}", rng.randrange(2000), 10 ** 6 + 100 * n + k, float(n)) for k in range(20)]
        df = spark.createDataFrame(batch, SCHEMA)
        before = t._parts()[0]
        t.add(df, n)
        if n in (2, 5):
            state = sorted(map(str, t.read().collect()))
            t.add(df, n)                            # a replay
            assert sorted(map(str, t.read().collect())) == state
        seen += batch
        merges += t._parts()[0] != before
        sizes.append(sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(f"{d}/delta/n={n}") for f in fs if f.startswith("part")))
    assert sorted((tuple(r) for r in t.read().collect()), key=str) == _latest(seen)
    assert merges <= 2 and max(sizes[1:]) < sizes[0] / 2
    one = t.read("L5").collect()
    assert [tuple(r) for r in one] == [r for r in _latest(seen) if r[0] == "L5"] and t.read("none").isEmpty()
    t.compact(8)
    assert sorted((tuple(r) for r in t.read().collect()), key=str) == _latest(seen)
    t.add(spark.createDataFrame([("L5", 10 ** 6, 1, 9.0)], SCHEMA), 8)    # a batch that the base holds
    assert sorted((tuple(r) for r in t.read().collect()), key=str) == _latest(seen)
    t.compact(8)
    assert sorted(os.listdir(f"{d}/base")) == ["n=8"] or len(os.listdir(f"{d}/base")) <= 2


def test_latest_table_survives_a_broken_merge(spark):
    d = tempfile.mkdtemp(prefix="corridor-latest-")
    t = LatestTable(spark, d)
    t.add(spark.createDataFrame([("A", 1, 1, 1.0)], SCHEMA), 0)
    os.makedirs(f"{d}/base/n=0/bucket=1")            # a merge that did not finish
    t.add(spark.createDataFrame([("A", 2, 2, 2.0), ("B", 1, 3, 1.0)], SCHEMA), 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [("A", 2, 2, 2.0), ("B", 1, 3, 1.0)]


# --- guards ------------------------------------------------------------------

def test_history_spreads_a_date(spark):
    d = tempfile.mkdtemp(prefix="corridor-history-")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # as if the date were large
    IO.append_history(spark.range(20000).repartition(8), f"{d}/h")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for p, _, fs in os.walk(f"{d}/h") for f in fs if f.startswith("part")]
    assert 1 < len(files) <= 8 and spark.read.parquet(f"{d}/h").count() == 20000


def test_edge_node_of_an_empty_message(spark):
    df = spark.createDataFrame([(0,), (None,), (100,)], "payload_bytes long")
    assert [r.node_id is not None and r.node_score is not None for r in SN.choose_edge_node(df).collect()] == [True] * 3


def test_key_by_its_definition():
    """PBKDF2-HMAC-SHA256 written out, block by block."""
    secret, bucket, seed, rounds = "s3cret", 5678, "pepper", 40
    salt = hashlib.sha256(f"{seed}:{bucket}".encode()).digest()[:16]
    u = hmac.new(f"{secret}_{bucket}".encode(), salt + (1).to_bytes(4, "big"), "sha256").digest()
    key = int.from_bytes(u, "big")
    for _ in range(rounds - 1):
        u = hmac.new(f"{secret}_{bucket}".encode(), u, "sha256").digest()
        key ^= int.from_bytes(u, "big")
    assert SEC.derive_key(secret, bucket, seed, rounds) == key.to_bytes(32, "big")


def test_key_table_known_answers(spark):
    df = spark.createDataFrame([(0,), (299,), (300,)], "timestamp long")
    got = {r.rotation_bucket: (bytes(r.key), r.key_fingerprint) for r in SEC.key_table(df, "s", "salt", rounds=10).collect()}
    assert set(got) == {0, 1}
    for b, (key, fingerprint) in got.items():
        assert key == SEC.derive_key("s", b, "salt", 10) and fingerprint == hashlib.sha256(key).hexdigest()[:16]


def test_entry_hides_only_what_is_missing(tmp_path):
    """Without the subpackage or the pipeline the core queries stand; a broken
    module is an error, not a silent absence."""
    import shutil
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for case in ("no folder", "empty folder", "no pipeline", "broken"):
        at = tmp_path / case.replace(" ", "-")
        shutil.copytree(os.path.join(root, "corridor"), at / "corridor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), at)
        if case == "empty folder":
            (at / "corridor/llm").mkdir()
        if case in ("no pipeline", "broken"):
            (at / "corridor/llm").mkdir()
            (at / "corridor/llm/__init__.py").write_text("")
            (at / "corridor/llm/registry.py").write_text("from . import gone\nQUERIES = ORACLE = {}\n")
        if case == "broken":
            (at / "corpus_pipeline.py").write_text("")
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q), len(q)"
        r = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(at)}, timeout=120)
        assert (r.returncode == 0) == (case != "broken"), (case, r.stderr[-500:])
        assert case != "broken" or "gone" in r.stderr


def test_training_rows_are_stored_evenly(spark, sf_small, monkeypatch):
    """A fit reads rows dealt over all cores, also where the input is one row group."""
    from corridor.operators import features as FE
    from corridor.operators import models as MO
    from corridor.sources import fixtures as V
    f = FE.train_test_split(FE.model_features(V.readings(spark, sf_small))).coalesce(1)

    class Kept:
        def fit(self, df):
            return df

    monkeypatch.setitem(MO.MODEL_BUILDERS, "kept", Kept)
    train = MO.train_models(f, ["kept"])["kept"]
    sizes = [n for n in train.rdd.glom().map(len).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= len(sizes)
    want = f.where("not is_test").select(*train.columns)
    assert sorted(map(tuple, train.collect())) == sorted(map(tuple, want.collect())) and len(train.columns) == 9
