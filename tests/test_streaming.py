"""Stream parity: streaming operators over reading files equal the batch
operators over the same rows (file source, availableNow trigger)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corridor.operators import anomaly as A
from corridor.operators import timeseries as TS
from corridor.sources import fixtures as V
from corridor.streaming import readings_stream as RS
from corridor.streaming import stateful as SF_

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream_dir(spark):
    d = tempfile.mkdtemp(prefix="corridor-stream-")
    src = os.path.join(d, "readings")
    r = V.readings(spark, SF).select([f.name for f in RS.READING_SCHEMA.fields])
    # four files in time order, so micro-batches arrive in event-time order
    r.repartitionByRange(4, "timestamp", "reading_id").sortWithinPartitions("timestamp", "reading_id") \
        .write.parquet(src)
    return d, src


def _run(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_tumbling_metrics_match_batch(spark, stream_dir):
    _, src = stream_dir
    _run(RS.tumbling_metrics(RS.read_readings(spark, src, max_files_per_trigger=1)), "j2_out")
    got = spark.table("j2_out")
    r = RS.with_event_time(V.readings(spark, SF))
    exp = (r.groupBy(F.window("event_ts", "5 minutes").alias("w"), "location")
           .agg(F.count(F.lit(1)).alias("n_readings"), F.avg("average_speed_kmph").alias("avg_speed")))
    assert got.count() == exp.count()
    j = got.join(exp.select(F.col("w.start").alias("window_start"), "location",
                            F.col("n_readings").alias("n2"), F.col("avg_speed").alias("s2")),
                 ["window_start", "location"])
    assert j.where((F.col("n_readings") != F.col("n2")) | (F.abs(F.col("avg_speed") - F.col("s2")) > 1e-9)).count() == 0
    assert j.count() == exp.count()


def test_dedup_within_watermark(spark, stream_dir):
    d, src = stream_dir
    dup_dir = os.path.join(d, "with_dups")
    base = spark.read.parquet(src)
    base.write.parquet(os.path.join(dup_dir, "a"))
    base.limit(50).write.parquet(os.path.join(dup_dir, "b"))  # repeated ids in a later file
    s = RS.read_readings(spark, os.path.join(dup_dir, "*"), max_files_per_trigger=2)
    _run(RS.deduplicated(s), "j1_out", mode="append")
    assert spark.table("j1_out").count() == base.count()


@pytest.mark.parametrize("files,rows", [(1, 10000), (2, 20), (5, 20)])
def test_stateful_incidents_match_batch(spark, files, rows):
    """Any number of micro-batches and any Arrow chunk, with readings shuffled
    among them within the watermark's delay."""
    d = tempfile.mkdtemp(prefix="corridor-incidents-")
    r = V.readings(spark, SF).select([f.name for f in RS.READING_SCHEMA.fields])
    r.repartition(files, F.rand(3)).write.parquet(os.path.join(d, "in"))
    # a later reading moves the watermark past all others
    top = r.agg(F.max("timestamp")).first()[0]
    after = [(-1 - i, top + 10 ** 8, f"Location_{c}", "Sunny", 1, 50.0) for i, c in enumerate("ABCDEF")]
    spark.createDataFrame(after, RS.READING_SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    name = f"j5_out_{files}"
    s = RS.read_readings(spark, os.path.join(d, "in"), max_files_per_trigger=1)
    _run(SF_.stateful_incidents(s, watermark="90 days"), name, mode="append")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    got = spark.table(name).where("reading_id >= 0")
    exp = TS.incidents(V.readings(spark, SF), chunk_rows=64)
    key = ["type", "severity", "reading_id"]
    assert got.select(key).exceptAll(exp.select(key)).count() == 0
    assert exp.select(key).exceptAll(got.select(key)).count() == 0


class Variables:
    """State variables of one key in memory, with its timers."""

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = tuple(v)

        def clear(self):
            self.v = None

    class List(Value):
        def get(self):
            return iter(self.v or [])

        def put(self, v):
            self.v = [tuple(x) for x in v]

        def appendList(self, v):
            self.v = [*(self.v or []), *map(tuple, v)]

    class Map(Value):
        def iterator(self):
            return iter((self.v or {}).items())

        def updateValue(self, k, v):
            self.v = {**(self.v or {}), tuple(k): tuple(v)}

        def removeKey(self, k):
            del self.v[tuple(k)]

    def __init__(self):
        self.made, self.timers = {}, set()
        self.getValueState = lambda name, schema: self.made.setdefault(name, self.Value())
        self.getListState = lambda name, schema: self.made.setdefault(name, self.List())
        self.getMapState = lambda name, key, schema: self.made.setdefault(name, self.Map())
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def empty(self):
        return not any(v.v for v in self.made.values()) and not self.timers


def _advance(p, handle, key, pdfs, mark):
    """One micro-batch at a watermark: rows, then the timers that are due."""
    class At:
        def getCurrentWatermarkInMs(self):
            return mark

    out = [tuple(r) for f in p.handleInputRows(key, iter(pdfs), At()) for r in f.itertuples(index=False)] if pdfs else []
    for t in [t for t in handle.timers if t <= mark]:
        handle.timers.discard(t)
        out += [tuple(r) for f in p.handleExpiredTimer(key, At(), None) for r in f.itertuples(index=False)]
    assert all(t > mark for t in handle.timers) and len(handle.timers) <= 1
    return out


def test_incidents_wait_for_five_readings():
    import pandas as pd
    p, h, out = SF_.Incidents(), Variables(), []
    p.init(h)
    for i, speed in enumerate([80.0, 50.0, 55.0, 56.0, 57.0]):
        pdf = pd.DataFrame({"timestamp": [i], "reading_id": [i], "average_speed_kmph": [speed]})
        out.append(len(_advance(p, h, ("x",), [pdf], (i + 1) * 1000)))
    assert out == [0, 0, 0, 0, 1]
    _advance(p, h, ("x",), [], (SF_.IDLE_SECONDS + 100) * 1000)
    assert h.empty()


def test_incidents_without_key_id_or_time(spark, stream_dir):
    """Such readings go to quarantine; the others give what they give alone."""
    d = os.path.join(tempfile.mkdtemp(prefix="corridor-nulls-"), "in")
    good = [(i, 10 ** 9 + 60 * i, "A", "Sunny", 1, s) for i, s in enumerate([80.0, 82.0, None, 81.0, 83.0, 50.0, 14.0, 13.0, 12.0])]
    bad = [(None, 10 ** 9 + 30, "A", "Sunny", 1, 1.0), (70, None, "A", "Sunny", 1, 1.0), (71, 10 ** 9 + 31, None, "Sunny", 1, 1.0)]
    spark.createDataFrame(good + bad, RS.READING_SCHEMA).coalesce(1).write.parquet(d)
    spark.createDataFrame([(99, 2 * 10 ** 9, "Z", "Sunny", 1, 50.0)], RS.READING_SCHEMA).coalesce(1).write.mode("append").parquet(d)
    s = RS.read_readings(spark, d, max_files_per_trigger=1)
    _run(SF_.stateful_incidents(s), "j5_nulls", mode="append")
    assert sorted((r.type, r.reading_id) for r in spark.table("j5_nulls").collect()) == [
        ("persistent_congestion", 8), ("sudden_slowdown", 5), ("sudden_slowdown", 6)]
    sound, rest = SF_.whole(RS.with_event_time(spark.read.schema(RS.READING_SCHEMA).parquet(d)), *SF_.READING_KEYS)
    assert rest.count() == 3 and sound.count() == len(good) + 1


@pytest.mark.parametrize("order", [0, 1, 2])
def test_every_row_takes_one_route(spark, order):
    """Clean, late and quarantine hold each row once, in any order of files;
    late are those that lie more than the delay behind an earlier file."""
    import random
    rng = random.Random(order)
    t0 = 1_700_000_000
    files = [[(100 * f + k, t0 + 1200 * f + rng.randrange(1200), rng.choice("AB"), "Sunny", 5, 40.0) for k in range(20)] for f in range(6)]
    for f in files:
        f[0] = (None, *f[0][1:])
        f[1] = (f[1][0], None, *f[1][2:])
        f[2] = (*f[2][:2], None, *f[2][3:])
        f[3] = (*f[3][:5], 900.0)
    rng.shuffle(files)
    top = tempfile.mkdtemp(prefix="corridor-routes-")
    src, out = os.path.join(top, "in"), os.path.join(top, "out")
    import time
    for f in files:
        spark.createDataFrame(f, RS.READING_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # the source takes files by their time
    s = RS.read_readings(spark, src, max_files_per_trigger=1)
    (SF_.routed(s, t0 + 3600, delay_seconds=1800).writeStream.foreachBatch(SF_.write_routes(out))
     .option("checkpointLocation", os.path.join(top, "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {r: sorted(map(str, SF_.read_route(spark, out, r).drop("event_ts").collect())) for r in SF_.ROUTES}
    everything = spark.createDataFrame(sum(files, []), RS.READING_SCHEMA)
    assert sorted(sum(got.values(), [])) == sorted(map(str, everything.collect()))
    late, seen = set(), {}
    for f in files:
        sound = [r for r in f if None not in r and r[5] <= 200 and abs(r[1] - t0 - 3600) <= 3600]
        late |= {r[0] for r in sound if r[2] in seen and r[1] < seen[r[2]] - 1800}
        for r in sound:
            seen[r[2]] = max(seen.get(r[2], 0), r[1])
    quarantined = {r.reading_id for r in SF_.read_route(spark, out, "quarantine").collect()}
    assert {r.reading_id for r in SF_.read_route(spark, out, "late").collect()} == late and not late & quarantined


def test_stream_static_scoring(spark, stream_dir):
    _, src = stream_dir
    batch = V.readings(spark, SF)
    base = A.hourly_baseline(batch)
    _run(RS.scored(RS.read_readings(spark, src), base).select("reading_id", "severity", "anomaly_detected"),
         "j6_out", mode="append")
    exp = A.score_anomalies(batch, base).select("reading_id", "severity", "anomaly_detected")
    got = spark.table("j6_out")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0


def test_idempotent_sink_replay(spark, stream_dir):
    d, src = stream_dir
    out = os.path.join(d, "alerts")
    sink = RS.idempotent_sink(out)
    df = spark.read.parquet(src)
    sink(df, 7)
    sink(df, 7)  # replay of the same batch id
    assert spark.read.parquet(out).count() == df.count()


def test_congestion_sessions(spark):
    """Runs of low speeds less than 30 minutes apart, three readings at least."""
    t0 = 1_700_000_000
    times = {"A": [0, 600, 1200, 5000], "B": [0, 600], "C": [0, 1700, 3400, 9000, 9600, 10200, 10800]}
    rows = [(i, t0 + t, loc, "Sunny", 1, 10.0 + t / 1e6) for loc, ts in times.items() for i, t in enumerate(ts)]
    rows.append((99, t0 + 10 ** 7, "Z", "Sunny", 1, 5.0))  # moves the watermark on
    d = tempfile.mkdtemp(prefix="corridor-sessions-")
    spark.createDataFrame(rows[:-1], RS.READING_SCHEMA).coalesce(1).write.parquet(os.path.join(d, "in"))
    spark.createDataFrame(rows[-1:], RS.READING_SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    s = RS.read_readings(spark, os.path.join(d, "in"), max_files_per_trigger=1)
    _run(RS.congestion_sessions(s).select("location", F.unix_timestamp("session_start").alias("s"), "n_low"), "j4_out", mode="append")
    assert sorted((r.location, r.s - t0, r.n_low) for r in spark.table("j4_out").collect()) == [("A", 0, 3), ("C", 0, 3), ("C", 9000, 4)]


def test_quarantine_latest_fusion_and_run_log(spark, stream_dir):
    from corridor.operators import runlog as RL
    from corridor.sources import fixtures as VV
    d, src = stream_dir
    good, bad = os.path.join(d, "good"), os.path.join(d, "bad")
    now = V.readings(spark, SF).agg(F.max("timestamp")).first()[0]
    s = RS.read_readings(spark, src, max_files_per_trigger=2)
    log_path = os.path.join(d, "runs")
    listener = RL.RunLog(spark, log_path)
    spark.streams.addListener(listener)
    q = (s.writeStream.foreachBatch(lambda b, i: RS.split_quarantine(b, now, good, bad, i))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    n_good, n_bad = spark.read.parquet(good).count(), spark.read.parquet(bad).count()
    assert n_good + n_bad == V.readings(spark, SF).count() and n_bad > 0
    # D45 over the stream's own run log
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20000)
    import time
    for _ in range(100):
        if os.path.isdir(log_path) and RL.run_log(spark, log_path).where(F.col("query") == str(q.runId)).count() >= len(q.recentProgress):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    log = RL.run_log(spark, log_path).where(F.col("query") == str(q.runId))
    st = RL.run_log_stats(log).first()
    assert log.agg(F.sum("input_rows")).first()[0] == V.readings(spark, SF).count() and log.where("late_rows <> 0").isEmpty()
    assert st.runs >= 2 and st.min_duration_ms <= st.avg_duration_ms <= st.max_duration_ms
    # J10 latest per location equals the batch answer
    _run(RS.latest_per_location(RS.read_readings(spark, src)), "j10_out", mode="update")
    got = {r.location: r.latest.reading_id for r in spark.table("j10_out").collect()}
    from corridor.operators.forecast import latest_per_location
    exp = {r.location: r.reading_id for r in latest_per_location(V.readings(spark, SF)).collect()}
    assert got == exp
    # J10 as a table: one row per location, a replayed batch changes nothing
    state = os.path.join(d, "latest")
    q = (RS.read_readings(spark, src, max_files_per_trigger=1).drop("event_ts").writeStream
         .foreachBatch(RS.upsert_latest(spark, state)).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.location: r.reading_id for r in RS.latest_version(spark, state).collect()}
    assert got == exp


def test_stream_fusion_matches_batch(spark):
    """Values, not counts; a later payload closes the windows."""
    from corridor.operators import sensors as SN
    from corridor.sources import fixtures as VV
    d = os.path.join(tempfile.mkdtemp(prefix="corridor-fusion-"), "in")
    p = VV.sensor_readings(spark, SF)
    p.coalesce(1).write.parquet(d)
    p.limit(1).withColumn("ts", F.col("ts") + F.expr("interval 1000 days")).coalesce(1).write.mode("append").parquet(d)
    ss = (spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(d)
          .withColumn("event_ts", F.col("ts").cast("timestamp")))
    values = ["average_speed", "total_volume", "weather_impact_score", "noise_impact_score", "traffic_health_score"]
    _run(RS.fused_stream(ss, VV.sensors(spark, SF)).select((F.unix_timestamp("win.start") / 3600).cast("long").alias("hour_bucket"), *values),
         "j9_out", mode="append")
    want = SN.fuse(p, VV.sensors(spark, SF)).select("hour_bucket", *values)
    got = {r.hour_bucket: r for r in spark.table("j9_out").collect()}
    exp = {r.hour_bucket: r for r in want.collect()}
    assert set(got) == set(exp)
    for k, r in exp.items():
        for c in values:
            assert (r[c] is None and got[k][c] is None) or abs(r[c] - got[k][c]) < 1e-9


def test_fusion_counts_a_sensor_once(spark):
    """A sensor that repeats its payload changes nothing."""
    from corridor.operators import sensors as SN
    from corridor.sources import fixtures as VV
    p = VV.sensor_readings(spark, SF)
    again = p.withColumn("event_id", F.col("event_id") + 10 ** 9)
    a = SN.fuse(p, VV.sensors(spark, SF)).orderBy("hour_bucket").collect()
    b = SN.fuse(p.unionByName(again), VV.sensors(spark, SF)).orderBy("hour_bucket").collect()
    assert [r.traffic_health_score for r in a] == pytest.approx([r.traffic_health_score for r in b])


def test_model_persistence_round_trip(spark):
    from corridor.operators import features as FE
    from corridor.operators import models as M
    f = FE.train_test_split(FE.model_features(V.readings(spark, SF)))
    ms = M.train_models(f, ["linear_regression"])
    d = tempfile.mkdtemp(prefix="corridor-models-")
    M.save_models(ms, d)
    back = M.load_models(d, ["linear_regression"])
    a = M.predictions(ms, f).orderBy("reading_id").collect()
    b = M.predictions(back, f).orderBy("reading_id").collect()
    assert [r.predicted for r in a] == [r.predicted for r in b]


def test_text_helpers(spark):
    from corridor.functions.numeric import leading_number, reversed_scale
    r = spark.createDataFrame([("3/5", "2")], "a string, b string").select(
        leading_number("a").alias("n"), reversed_scale("b").alias("s")).first()
    assert (r.n, r.s) == (3, 4.0)


def test_centroid_tracker_stream(spark):
    from corridor.streaming import tracker as TR
    rows, ids = [], {}
    for cam, back in ((0, 6), (1, 7)):
        base = cam * 100
        for f in range(10):                                   # vehicle A: 10 px per frame
            rows.append((cam, f, base + f, 100.0 + 10 * f, 100.0))
        rows.append((cam, 2, base + 50, 500.0, 300.0))        # vehicle B, last seen at frame 2
        rows.append((cam, 2 + back, base + 51, 505.0, 300.0))
        rows.append((cam, 3, base + 60, 800.0, 500.0))        # vehicle C jumps exactly 50 px
        rows.append((cam, 4, base + 61, 850.0, 500.0))
    d = tempfile.mkdtemp(prefix="corridor-tracks-")
    schema = "camera_id long, frame_id long, det_id long, cx double, cy double"
    rows += [(cam, 1000, cam * 100 + 90, 0.0, 0.0) for cam in (0, 1)]     # closes the last frame
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(d, "in"))
    s = spark.readStream.schema(schema).parquet(os.path.join(d, "in")).withColumn("event_ts", F.timestamp_seconds(F.col("frame_id") + 10 ** 9))
    _run(TR.track_stream(s), "j7_out", mode="append")
    out = {r.det_id: r for r in spark.table("j7_out").collect()}
    assert len(out) == len(rows) - 2
    for cam in (0, 1):
        base = cam * 100
        assert {out[base + f].assigned_track for f in range(10)} == {0}   # A keeps id 0
        assert all(out[base + f].matched for f in range(1, 10))
        assert not out[base + 61].matched                                  # 50 px is outside the gate
    assert out[51].matched and out[51].assigned_track == out[50].assigned_track   # back after 6 frames
    assert not out[151].matched                                                   # back after 7: new id
    assert out[9].path_len == 10


def test_sliding_metrics_match_batch(spark, stream_dir):
    _, src = stream_dir
    _run(RS.sliding_metrics(RS.read_readings(spark, src, max_files_per_trigger=2)), "j3_out")
    got = spark.table("j3_out")
    r = RS.with_event_time(V.readings(spark, SF))
    exp = (r.groupBy(F.window("event_ts", "1 hour", "5 minutes").alias("w"), "location")
           .agg(F.count(F.lit(1)).alias("n2"), F.avg("average_speed_kmph").alias("m2"))
           .select(F.col("w.start").alias("window_start"), "location", "n2", "m2"))
    j = got.join(exp, ["window_start", "location"])
    assert j.count() == exp.count() == got.count()
    assert j.where((F.col("n") != F.col("n2")) | (F.abs(F.col("mean_speed") - F.col("m2")) > 1e-9)).count() == 0


def _frames(rows):
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["frame_id", "det_id", "cx", "cy"]).assign(detector=0)
    return pdf.assign(event_ts=pd.to_datetime(pdf["frame_id"] * 10 + 10 ** 9, unit="s"))


def test_tracker_split_frames():
    """A frame in two micro-batches gives the same tracks as in one."""
    from corridor.streaming import tracker as TR
    dets = [(f, 10 * f + k, 100.0 * k + 5 * f, 50.0) for f in range(6) for k in range(3)]

    def run(batches):
        p, h, out = TR.Tracker(), Variables(), []
        p.init(h)
        for b in batches:
            out += _advance(p, h, (1,), [_frames(b)[::2], _frames(b)[1::2]], 0)
        out += _advance(p, h, (1,), [], (10 ** 9 + 10 ** 6) * 1000)
        out += _advance(p, h, (1,), [], (10 ** 9 + 10 ** 7) * 1000)
        assert h.empty()
        return sorted(out)

    whole = run([dets])
    assert len(whole) == len(dets)
    assert run([dets[:4], dets[4:5], dets[5:11], dets[11:]]) == whole


def test_tracker_waits_for_the_watermark():
    """Frames that arrive in any order within the delay give the same tracks."""
    from corridor.streaming import tracker as TR

    def run(batches):
        p, h, out, newest, mark = TR.Tracker(), Variables(), [], 0, 0
        p.init(h)
        for b in batches:
            out += _advance(p, h, (1,), [_frames(b)], mark)
            newest = max([newest, *(r[0] * 10 + 10 ** 9 for r in b)])
            mark = (newest - 60) * 1000
        early = len(out)
        for mark in (mark + 100_000, mark + 10 * TR.IDLE_MS):
            out += _advance(p, h, (1,), [], mark)
        assert h.empty() and early < len(out)
        return out

    frames = [[(f, 10 * f + k, 100.0 * k + 5 * f, 50.0) for k in range(3)] for f in range(14)]
    whole = run(frames)
    assert len(whole) == 42 and [r[1] for r in whole] == sorted(r[1] for r in whole)
    assert run([*frames[:10], frames[11] + frames[12], frames[10], frames[13]]) == whole
    assert run([sum(frames[5:9], []), frames[4][:1], frames[4][1:] + frames[3], *frames[:3], *frames[9:]]) == whole


def test_tracker_state_and_quarantine(spark):
    """State variables are read back from the checkpoint; detections that
    cannot be placed go to the quarantine and hurt no track."""
    from corridor.streaming import tracker as TR
    d = tempfile.mkdtemp(prefix="corridor-state-")
    schema = "camera_id long, frame_id long, det_id long, cx double, cy double, track_id long, ts long"
    rows = [(1, f, f, 10.0 * f, 0.0, 7, 10 ** 9 + f) for f in range(30)]
    bad = [(None, 1, 100, 0.0, 0.0, 7, 10 ** 9), (1, None, 101, 0.0, 0.0, 7, 10 ** 9), (1, 2, None, 0.0, 0.0, 7, 10 ** 9),
           (1, 2, 102, None, 0.0, 7, 10 ** 9), (1, 2, 103, float("nan"), 0.0, 7, 10 ** 9), (1, 2, 104, 0.0, 0.0, 7, None)]
    spark.createDataFrame(rows + bad, schema).coalesce(1).write.parquet(os.path.join(d, "in"))
    spark.createDataFrame([(1, 200, 200, 0.0, 900.0, 0, 10 ** 9 + 200)], schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in"))
         .withColumn("event_ts", F.timestamp_seconds("ts")))
    q = (TR.track_stream(s).writeStream.format("memory").queryName("j7_state").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.table("j7_state").collect()
    assert sorted(r.det_id for r in out) == list(range(30)) and {r.assigned_track for r in out} == {0}
    assert max(r.path_len for r in out) == 20
    held = SF_.read_state(spark, os.path.join(d, "cp"), "tracks").select("key.*", "user_map_key.*", "user_map_value.*").collect()
    assert [(r.camera_id, r.track_id, r.cx, r.detector, len(r.xs)) for r in held] == [(1, 0, 290.0, 7, 20)]
    table = spark.createDataFrame(rows + bad, schema).withColumn("event_ts", F.timestamp_seconds("ts"))
    assert TR.untracked(table).count() == len(bad)


# --- J7 matching and its batch form ----------------------------------------

def _scene(rng, cameras=3, frames=90, n=8, gap=0.15):
    """Vehicles on crossing ways, seen with gaps and with ids that sometimes fail."""
    rows = []
    for cam in range(cameras):
        cars = [[rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(-15, 15), rng.uniform(-15, 15), k + 1] for k in range(n)]
        det = 0
        for f in range(frames):
            if rng.random() < 0.05:
                continue
            for c in cars:
                c[0], c[1] = c[0] + c[2], c[1] + c[3]
                for k in (0, 1):
                    if not 0 <= c[k] <= 400:
                        c[k + 2] *= -1
                if rng.random() >= gap:
                    rows.append((cam, f, det, round(c[0], 1), round(c[1], 1), rng.choice([c[4], c[4], 0, rng.randint(1, n)])))
                    det += 1
    return rows


DETECTIONS = "camera_id long, frame_id long, det_id long, cx double, cy double, track_id long"


def _walk(rows):
    """All frames of a camera one after another."""
    from corridor.operators import tracking as K
    out = {}
    for cam in {r[0] for r in rows}:
        tracks, n = [], iter(range(10 ** 9))
        for f in sorted({r[1] for r in rows if r[0] == cam}):
            dets = sorted({(r[2], r[3], r[4], max(r[5] or 0, 0)) for r in rows if r[:2] == (cam, f)})
            for d, (t, old) in zip(dets, K.step(tracks, f, dets, lambda: next(n))):
                out[(cam, f, d[0])] = (t.label, old, min(t.seen, K.PATH_LEN))
    return out


def test_assignment_is_the_best_one():
    """As many pairs as possible, of least total distance, by trying all."""
    import itertools
    import random
    from corridor.operators import tracking as K
    rng = random.Random(4)
    for _ in range(300):
        n, m = rng.randint(0, 5), rng.randint(0, 5)
        tracks = [K.Track(j, rng.uniform(0, 120), rng.uniform(0, 60), 0, 0, 1) for j in range(m)]
        dets = [(i, rng.uniform(0, 120), rng.uniform(0, 60), 0) for i in range(n)]

        def dist(i, j):
            return ((dets[i][1] - tracks[j].cx) ** 2 + (dets[i][2] - tracks[j].cy) ** 2) ** 0.5

        best = (0, 0.0)
        for js in itertools.product([-1, *range(m)], repeat=n):
            used = [j for j in js if j >= 0]
            if len(set(used)) == len(used) and all(dist(i, j) < K.GATE_PX for i, j in enumerate(js) if j >= 0):
                best = min(best, (-len(used), sum(dist(i, j) for i, j in enumerate(js) if j >= 0)))
        got = K.match(tracks, dets)
        used = [j for j in got if j >= 0]
        assert len(set(used)) == len(used)
        assert (-len(used), pytest.approx(sum(dist(i, j) for i, j in enumerate(got) if j >= 0))) == best


def test_crossing_vehicles_keep_their_ids():
    from corridor.operators import tracking as K
    rows = []
    for f in range(20):
        rows += [(0, f, 2 * f, 10.0 * f, 100.0, 5), (0, f, 2 * f + 1, 190.0 - 10.0 * f, 104.0, 9)]
    out = _walk(rows)
    assert {out[(0, f, 2 * f)][0] for f in range(20)} == {0} and {out[(0, f, 2 * f + 1)][0] for f in range(20)} == {1}
    # without ids the nearest pairs win, and they swap at the crossing
    out = _walk([(*r[:5], 0) for r in rows])
    assert {out[(0, f, 2 * f)][0] for f in range(20)} == {0, 1}
    # an id that fails the gate does not name a track
    far = _walk([(0, 0, 0, 0.0, 0.0, 5), (0, 1, 1, 300.0, 0.0, 5), (0, 2, 2, 10.0, 0.0, 5)])
    assert [far[(0, f, f)][:2] for f in range(3)] == [(0, False), (1, False), (0, True)]


@pytest.mark.parametrize("size", [9, 16, 1000])
def test_batch_tracks_equal_one_walk(spark, size):
    import random
    from corridor.operators import tracking as K
    rows = _scene(random.Random(size), cameras=2, frames=50)
    rows += [(9, f, f, 5.0, 5.0, 0) for f in range(0, 120)]           # a vehicle that stays
    rows += [(8, f, f, 5.0, 5.0, 3) for f in (0, 3, 90, 91, 300)]     # gaps longer than a range
    df = spark.createDataFrame(rows + rows[:5] + [(None, 1, 1, 1.0, 1.0, 1), (1, 2, 3, None, 1.0, 1)], DETECTIONS)
    got = {(r.camera_id, r.frame_id, r.det_id): (r.assigned_track, r.matched, r.path_len) for r in K.track_detections(df, size).collect()}
    assert got == _walk(rows)


def test_batch_tracks_equal_the_stream(spark):
    import random
    from corridor.operators import tracking as K
    from corridor.streaming import tracker as TR
    rows = _scene(random.Random(77), cameras=2, frames=26)
    d = os.path.join(tempfile.mkdtemp(prefix="corridor-both-"), "in")
    table = spark.createDataFrame(rows + [(c, 10 ** 6, 10 ** 6, 0.0, 0.0, 0) for c in (0, 1)], DETECTIONS)
    table.repartition(3, "det_id").write.parquet(d)
    s = (spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).parquet(d)
         .withColumn("event_ts", F.timestamp_seconds(F.col("frame_id") + 10 ** 9)))
    _run(TR.track_stream(s, watermark="1000 days"), "j7_both", mode="append")
    _run(TR.track_stream(spark.readStream.schema(DETECTIONS).parquet(d).withColumn("event_ts", F.timestamp_seconds(F.col("frame_id") + 10 ** 9))), "j7_once", mode="append")
    want = {tuple(r) for r in spark.table("j7_once").where("frame_id < 1000000").collect()}
    assert len(want) == len(rows)
    for size in (7, 11, 64):
        assert {tuple(r) for r in K.track_detections(table, size).where("frame_id < 1000000").collect()} == want


def test_tracking_of_nothing(spark):
    from corridor.operators import tracking as K
    assert K.track_detections(spark.createDataFrame([], DETECTIONS)).collect() == []
