"""Hand-computed golden rows for rule boundaries and small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from corridor.functions.congestion import (congestion_class, level_from_speed, speed_band, speed_band_code)
from corridor.operators import anomaly as A
from corridor.operators import decisions as D
from corridor.operators import detections as DT
from corridor.operators import features as FE
from corridor.operators import timeseries as TS

T0 = 1704067200  # 2024-01-01 00:00:00 UTC, a Monday
SCHEMA = "reading_id long, timestamp long, location string, weather string, vehicle_count int, average_speed_kmph double"


def readings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_speed_level_and_bands(spark):
    speeds = [0.0, 39.99, 40.0, 69.99, 70.0, 100.0, 100.01]
    df = spark.createDataFrame([(s,) for s in speeds], "s double")
    got = df.select("s", level_from_speed("s").alias("lvl"), speed_band("s").alias("band"),
                    speed_band_code("s").alias("code"), D.light_timing("s").alias("t")).collect()
    exp = {0.0: ("High", None, 1, 45), 39.99: ("High", "High", 0, 45), 40.0: ("Medium", "High", 0, 35),
           69.99: ("Medium", "Medium", 1, 35), 70.0: ("Low", "Medium", 1, 30), 100.0: ("Low", "Low", 2, 30),
           100.01: ("Low", None, 1, 30)}
    for r in got:
        assert (r.lvl, r.band, r.code, r.t.green) == exp[r.s], r


def test_score_class_right_closed(spark):
    scores = [0.0, 0.33, 0.330001, 0.66, 0.660001, 1.0, 1.01]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = {r.s: r.c for r in df.select("s", congestion_class("s").alias("c")).collect()}
    assert got == {0.0: None, 0.33: 0, 0.330001: 1, 0.66: 1, 0.660001: 2, 1.0: 2, 1.01: None}


def test_single_row_hour_never_fires(spark):
    rows = [(1, T0 + 3 * 3600, "L", "Sunny", 10, 500.0)]
    rows += [(10 + i, T0 + 4 * 3600 + i, "L", "Sunny", 10, 50.0 + (i % 3)) for i in range(30)]
    r = readings(spark, rows)
    s = A.score_anomalies(r, A.hourly_baseline(r)).where("reading_id = 1").first()
    assert s.speed_z is None and s.anomaly_detected is False and s.severity == "low"


def test_volume_branch_both_directions(spark):
    rows = [(i, T0 + i, "L", "Sunny", 50 + (i % 5) - 2, 50.0) for i in range(30)]
    rows += [(100, T0 + 100, "L", "Sunny", 150, 50.0), (101, T0 + 101, "L", "Sunny", 0, 50.0)]
    r = readings(spark, rows)
    s = {x.reading_id: x for x in A.score_anomalies(r, A.hourly_baseline(r), z_threshold=1.5).collect()}
    assert "volume_anomaly" in s[100].anomaly_types and s[100].recommendations == ["volume_high_prepare"]
    assert "volume_anomaly" in s[101].anomaly_types and s[101].recommendations == ["volume_low_investigate"]


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_slowdown_boundaries(spark, chunk):
    def series(loc, speeds, base):
        return [(base + i, T0 + base + i, loc, "Sunny", 10, float(s)) for i, s in enumerate(speeds)]
    rows = series("A", [60, 40, 60, 39.9, 60, 20, 60, 19.9], 0) + series("B", [60, 0, 60, 0], 100)
    out = TS.sudden_slowdowns(TS.speed_changes(readings(spark, rows), chunk_rows=max(chunk, 3)))
    got = {(r.reading_id, r.severity) for r in out.collect()}
    # -20 exactly is no hit, -20.1 medium, -40 exactly medium, -40.1 high; B has only 4 readings
    assert got == {(3, "medium"), (5, "medium"), (7, "high")}


def test_low_speed_runs(spark):
    rows = [(i, T0 + i, "A", "Sunny", 10, float(s)) for i, s in enumerate([10, 10, 30, 10, 10, 10, 15, 10])]
    ch = TS.speed_changes(readings(spark, rows), chunk_rows=4)
    got = sorted(r.reading_id for r in TS.persistent_congestion(ch).collect())
    assert got == [5]
    assert TS.persistent_congestion_latest(readings(spark, rows)).count() == 0
    assert [r.reading_id for r in TS.persistent_congestion_latest(readings(spark, rows[:6])).collect()] == [5]
    assert TS.persistent_congestion_latest(readings(spark, rows[:2])).count() == 0


def test_peak_hours_islands(spark):
    rows = []
    rid = 0
    for h in range(24):
        vc = 200 if h in (7, 8, 9, 12, 17, 21) else 10   # 6 of 24 hours reach the 75th percentile
        for _ in range(3):
            rows.append((rid, T0 + h * 3600 + rid, "A", "Sunny", vc, 20.0 if vc == 200 else 90.0))
            rid += 1
    p = TS.peak_hours(readings(spark, rows)).orderBy("start").collect()
    assert [(r.start, r.end) for r in p] == [(7, 9), (12, 12), (17, 17), (21, 21)]
    assert p[0].intensity == "High"


def test_integrity_rules(spark):
    rows = [(1, T0, "A", "Sunny", 1000, 50.0), (2, T0, "A", "Sunny", 1001, 50.0), (3, T0, "A", "Sunny", 10, -1.0),
            (4, T0, "A", "Sunny", 10, 0.0), (5, T0, "A", "Sunny", 10, 200.0), (6, T0, "A", "Sunny", 10, 201.0),
            (7, T0 - 3600, "A", "Sunny", 10, 50.0), (8, T0 - 3601, "A", "Sunny", 10, 50.0)]
    got = {r.reading_id: r.issue_count for r in D.integrity_check(readings(spark, rows), F.lit(T0)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1}


def test_unknown_labels_and_zero_cases(spark):
    fit = readings(spark, [(1, T0, "A", "Sunny", 10, 50.0), (2, T0, "B", "Rainy", 10, 50.0)])
    new = readings(spark, [(3, T0, "Z", "Hail", 0, 0.0)])
    enc = FE.apply_label_encoder(new, FE.label_encoder(fit, "location"), "location").first()
    assert enc.location_encoded == 0
    r = new.select(FE.weather_code("weather").alias("w")).first()
    assert r.w == 0
    e = D.environmental_impact(new).first()
    assert e.co2_per_vehicle == 0.0 and e.total_co2_per_hour == 0.0 and e.efficiency_rating == 75.0
    s = D.signal_optimisation(new.withColumn("hour", F.lit(8))).first()
    assert (s.total_cycle_time, s.green_time, s.yellow_time, s.red_time) == (64, 35, 5, 23)
    t = D.adaptive_timing(new).first()
    assert (t.green, t.yellow, t.red) == (15, 5, 37)


def test_track_gate(spark):
    rows = [(1, 0, 0, 2, 0.9, 100, 100, 120, 120, 1), (2, 0, 1, 2, 0.9, 110, 100, 130, 120, 1),
            (3, 0, 1, 2, 0.9, 150, 100, 170, 120, 2),   # centre 50 px from det 1: no match
            (4, 0, 2, 2, 0.9, 120, 100, 140, 120, 1)]
    det = spark.createDataFrame(rows, "det_id long, camera_id long, frame_id long, class_id int, confidence double, "
                                      "x1 int, y1 int, x2 int, y2 int, track_id long")
    m = {r.det_id: r.prev_det_id for r in DT.track_matches(DT.valid_detections(det)).collect()}
    assert m == {2: 1, 4: 2}


def test_format_timestamp(spark):
    df = spark.createDataFrame([("1704067200",), ("abc",), ("1704067200.9",)], "t string")
    got = [r.f for r in df.select(D.format_timestamp(F.col("t")).alias("f")).collect()]
    assert got == ["2024-01-01 00:00:00", "Invalid timestamp", "2024-01-01 00:00:00"]
