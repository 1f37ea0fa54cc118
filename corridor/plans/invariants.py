"""Registered queries whose rows are exact invariants of the operators that
SQL cannot express: fitted models, the isolation forest, k-means hotspots,
encryption.  Each row states what must hold, and the oracle derives the same
row from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import detections as DT
from ..operators import features as FE
from ..operators import hotspots as HS
from ..operators import isolation as IF
from ..operators import models as M
from ..operators import pipelines as PL
from ..operators import sensors as SN
from ..operators import tracking as TK
from ..session import ensure_checkpoint_dir, stored
from ..sources import fixtures as V
from ..sources.tables import read_table
from . import security
from ._registry import query
from .detections import _VALID, _valid
from .models import _IF_FEATURES

_TEST = "cast(concat('0x', substr(md5(cast(reading_id as varchar)), 1, 8)) as bigint) % 100 < 20"


def _planted(spark, sf_dir):
    """Model features with a speed that depends on them, so that any model that
    learns must beat the mean."""
    f = FE.train_test_split(FE.model_features(V.readings(spark, sf_dir)))
    signal = 80 - F.col("vehicle_count") * 0.25 - F.col("is_rush_hour") * 8 - F.col("location_encoded")
    return stored(f.withColumn("average_speed_kmph", signal.cast("double")), "planted")


def _learned(preds):
    r = preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.count("predicted").alias("n_filled"),
        F.avg((F.col("actual") - F.col("predicted")) ** 2).alias("mse"), F.var_pop("actual").alias("v"))
    return r.select("model", "n_predictions", "n_filled", (F.col("mse") < F.col("v") / 2).alias("beats_mean"))


def _fit_query(survey_id: str, model: str):
    @query(f"{survey_id}_learns_planted_signal", sql=f"""
    select '{model}' as model, count(*) as n_predictions, count(*) as n_filled, true as beats_mean
    from readings where {_TEST}""")
    def run(spark, sf_dir):
        f = _planted(spark, sf_dir)
        return _learned(M.predictions(M.train_models(f, [model]), f))


for _id, _model in (("g3", "random_forest"), ("g4", "gradient_boosting"), ("g5", "polynomial_regression"), ("g9", "linear_regression")):
    _fit_query(_id, _model)


@query("g9_partial_records", sql="""
select 'full' as pair, 0::bigint as n_differing, 2::bigint as n_scores, 0.85::double as confidence""")
def g9_partial_records(spark, sf_dir):
    """A record without its optional fields scores like one with the defaults written out."""
    f = _planted(spark, sf_dir)
    models = M.train_models(f, ["linear_regression", "random_forest"])
    readings = V.readings(spark, sf_dir)
    encoders = {c: FE.label_encoder(readings, c) for c in ("location", "weather")}
    one = readings.agg(F.max("vehicle_count").alias("vehicle_count"))
    part = M.score_records(one.withColumn("location", F.lit("Location_B")), models, encoders)
    whole = M.score_records(one.withColumns({c: F.lit("Location_B" if c == "location" else v) for c, v in M.RECORD_DEFAULTS.items() if c != "vehicle_count"}),
                            models, encoders)
    both = part.select("model", F.col("speed").alias("a"), "confidence").join(whole.select("model", F.col("speed").alias("b")), "model")
    return both.agg(F.lit("full").alias("pair"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("n_differing"),
                    F.count(F.lit(1)).alias("n_scores"), F.max("confidence").alias("confidence"))


@query("g10_uncertainty_invariants", sql=f"""
select count(*) as n_rows, count(*) as n_mean_is_prediction, count(*) as n_spread_not_negative from readings where {_TEST}""")
def g10_uncertainty_invariants(spark, sf_dir):
    f = _planted(spark, sf_dir)
    m = M.train_models(f, ["random_forest"])["random_forest"]
    u = M.forest_uncertainty(m, f.where("is_test")).select("reading_id", "prediction_mean", "prediction_std")
    p = M.predictions({"random_forest": m}, f).select("reading_id", "predicted")
    return u.join(p, "reading_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("prediction_mean") - F.col("predicted")) < 1e-6).alias("n_mean_is_prediction"),
        F.count_if(F.col("prediction_std") >= 0).alias("n_spread_not_negative"))


@query("g11_importance_invariants", sql="""
select 8::bigint as n_features, 1.0::double as total, 'vehicle_count' as first_feature from readings limit 1""")
def g11_importance_invariants(spark, sf_dir):
    f = _planted(spark, sf_dir)
    i = M.feature_importance(spark, M.train_models(f, ["random_forest"])["random_forest"])
    return i.agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 9).alias("total"), F.max_by("feature", "importance").alias("first_feature"))


@query("g1_saved_pipeline", sql=f"""
select reading_id, true as same_after_loading, true as unknown_is_first, true as scored
from readings where {_TEST}""")
def g1_saved_pipeline(spark, sf_dir):
    """A pipeline fitted on the raw training readings, saved and loaded, gives
    the test readings the speeds that it gave before; a label that it has
    never seen scores like the first one."""
    r = FE.train_test_split(V.readings(spark, sf_dir))
    fitted = PL.fit_readings(r.where("not is_test").drop("is_test"), ["linear_regression"])
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipelines-{uuid.uuid4().hex}"
    M.save_models(fitted, at)
    back = M.load_models(at, ["linear_regression"])
    test = r.where("is_test").select("reading_id", "timestamp", "location", "weather", "vehicle_count", "ts", "average_speed_kmph")

    def speed(models, rows, name):
        return PL.score_readings(models, rows).select("reading_id", F.col("speed").alias(name))

    first = r.agg(F.min("location")).scalar()
    both = (speed(fitted, test, "a").join(speed(back, test, "b"), "reading_id")
            .join(speed(back, test.withColumn("location", F.lit("nowhere")), "c"), "reading_id")
            .join(speed(back, test.withColumn("location", first), "d"), "reading_id"))
    return both.select("reading_id", (F.col("a") == F.col("b")).alias("same_after_loading"), (F.col("c") == F.col("d")).alias("unknown_is_first"),
                       F.col("a").isNotNull().alias("scored"))


@query("g10_bootstrap_invariants", sql=f"""
select reading_id, true as mean_of_members, true as spread_of_members, true as same_in_another_layout from readings where {_TEST}""")
def g10_bootstrap_invariants(spark, sf_dir):
    """Mean and spread are those of the members' predictions, and members
    fitted on another layout of the same rows give the same."""
    f = _planted(spark, sf_dir)
    train, test = f.where("not is_test"), f.where("is_test")
    one = PL.bootstrap("polynomial_regression", train, members=3)
    two = PL.bootstrap("polynomial_regression", train.orderBy("vehicle_count").coalesce(1), members=3)
    u = PL.with_uncertainty(one, test).select("reading_id", "prediction_mean", "prediction_std")
    for i, m in enumerate(one):
        u = u.join(m.transform(test).select("reading_id", F.col("prediction").alias(f"p{i}")), "reading_id")
    w = PL.with_uncertainty(two, test).select("reading_id", F.col("prediction_mean").alias("m2"), F.col("prediction_std").alias("s2"))
    p = [F.col(f"p{i}") for i in range(3)]
    mean = sum(p[1:], p[0]) / 3
    var = sum(((x - mean) * (x - mean) for x in p[1:]), (p[0] - mean) * (p[0] - mean)) / 3

    def near(a, b):
        return F.abs(a - b) <= F.abs(a) * 1e-6 + 1e-6

    return u.join(w, "reading_id").select(
        "reading_id", near(F.col("prediction_mean"), mean).alias("mean_of_members"), near(F.col("prediction_std"), F.sqrt(var)).alias("spread_of_members"),
        (near(F.col("prediction_mean"), F.col("m2")) & near(F.col("prediction_std"), F.col("s2"))).alias("same_in_another_layout"))


@query("g9_record_defaults", sql="""
select reading_id, true as same_speed from readings""")
def g9_record_defaults(spark, sf_dir):
    """Each reading's count as a record without its other fields scores like
    the record with the defaults written out."""
    r = V.readings(spark, sf_dir)
    models = PL.fit_readings(r, ["linear_regression"])
    part = r.select("reading_id", "vehicle_count")
    full = part.withColumns({c: F.lit(v) for c, v in M.RECORD_DEFAULTS.items() if c != "vehicle_count"})
    a = PL.score_readings(models, part).select("reading_id", F.col("speed").alias("a"))
    b = PL.score_readings(models, full).select("reading_id", F.col("speed").alias("b"))
    return a.join(b, "reading_id").select("reading_id", (F.col("a") == F.col("b")).alias("same_speed"))


@query("g12_saved_forest", sql="""
select reading_id, true as same_score, true as same_flag from readings""")
def g12_saved_forest(spark, sf_dir):
    """A saved and loaded detector scores and flags every reading like the fitted one."""
    r = V.readings(spark, sf_dir).select("reading_id", "vehicle_count", "average_speed_kmph")
    model, scored = IF.fit_detector(r, ["vehicle_count", "average_speed_kmph"], "reading_id", n_trees=50)
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    IF.save_detector(spark, model, at, 1)
    back = IF.flag(r, IF.load_detector(spark, at, 1)).select("reading_id", F.col("if_score").alias("b"), "is_ml_anomaly")
    flagged = F.col("if_score") > F.lit(model["threshold"])
    return scored.join(back, "reading_id").select("reading_id", (F.col("if_score") == F.col("b")).alias("same_score"), (flagged == F.col("is_ml_anomaly")).alias("same_flag"))


def _forest_rows(scores, flag):
    return scores.agg(F.count(F.lit(1)).alias("n_readings"),
                      (F.abs(F.count_if(F.col(flag)) / F.count(F.lit(1)) - IF.CONTAMINATION) <= 0.01).alias("share_ok"),
                      (F.min(F.when(F.col(flag), F.col("if_score"))) > F.max(F.when(~F.col(flag), F.col("if_score")))).alias("scores_apart"))


_FOREST_SQL = "select count(*) as n_readings, true as share_ok, true as scores_apart from readings"


@query("g12_isolation_forest_invariants", sql=_FOREST_SQL)
def g12_isolation_forest_invariants(spark, sf_dir):
    f = FE.model_features(V.readings(spark, sf_dir))
    return _forest_rows(IF.detect(f, _IF_FEATURES, "reading_id"), "is_ml_anomaly")


@query("c1_forest_invariants", sql=_FOREST_SQL)
def c1_forest_invariants(spark, sf_dir):
    r = V.readings(spark, sf_dir)
    s = A.score_with_forest(r, A.hourly_baseline(r))
    return _forest_rows(s.withColumn("ml", F.array_contains("anomaly_types", "ml_pattern_anomaly")), "ml")


@query("d34_hotspot_invariants", views=("detections",), sql=f"""
with {_VALID}
select camera_id, frame_id, count(*) as n_detections, true as members_fit, true as clusters_fit
from v group by 1, 2 having count(*) > {DT.HOTSPOT_MIN_DETECTIONS}""")
def d34_hotspot_invariants(spark, sf_dir):
    """Frames over five detections: hotspots hold no more vehicles than the
    frame, each more than two, and there are at most ten."""
    v = _valid(spark, sf_dir)
    h = DT.congestion_hotspots(v).groupBy("camera_id", "frame_id").agg(
        F.sum("vehicle_count").alias("members"), F.min("vehicle_count").alias("least"), F.count(F.lit(1)).alias("clusters"))
    n = v.groupBy("camera_id", "frame_id").agg(F.count(F.lit(1)).alias("n_detections")).where(f"n_detections > {DT.HOTSPOT_MIN_DETECTIONS}")
    return n.join(h, ["camera_id", "frame_id"], "left").select(
        "camera_id", "frame_id", "n_detections",
        ((F.coalesce("members", F.lit(0)) <= F.col("n_detections")) & (F.coalesce("least", F.lit(3)) > DT.HOTSPOT_MIN_MEMBERS)).alias("members_fit"),
        (F.coalesce("clusters", F.lit(0)) <= 10).alias("clusters_fit"))


@query("d34_camera_invariants", views=("detections",), sql=f"""
with {_VALID}
select camera_id, count(*) as n_detections, true as centres_are_means, true as distinct_centres,
  least(greatest(2, count(*) // 5), 10) as most_clusters, true as within
from v group by 1 having count(*) > {DT.HOTSPOT_MIN_DETECTIONS}""")
def d34_camera_invariants(spark, sf_dir):
    """Cameras over five detections: the clusters hold every detection once,
    there are no more of them than asked for, and they are a fixed point: the
    spread around the camera's mean is that within the clusters and that of
    their centres, which holds for means alone; no two centres are one."""
    v = _valid(spark, sf_dir)
    mean = v.groupBy("camera_id").agg((F.var_pop("cx") + F.var_pop("cy")).alias("spread"), F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    off = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    c = HS.camera_clusters(v).join(mean, "camera_id").groupBy("camera_id", "spread").agg(
        F.sum("vehicle_count").alias("n_detections"), F.sum("inertia").alias("inside"), F.sum(F.col("vehicle_count") * off).alias("between"),
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.count_distinct("x", "y")).alias("distinct_centres"))
    total = F.col("spread") * F.col("n_detections")
    most = F.least(F.greatest(F.lit(2), F.floor(F.col("n_detections") / 5)), F.lit(10))
    return c.select("camera_id", "n_detections", (F.abs(total - F.col("inside") - F.col("between")) <= total * 1e-6 + 1e-6).alias("centres_are_means"),
                    "distinct_centres", most.alias("most_clusters"), (F.col("n") <= most).alias("within"))


@query("j7_track_invariants", views=("detections",), sql=f"""
with {_VALID}
select camera_id, frame_id, count(*) as n_detections, count(*) as n_tracks, true as gates_hold, true as new_is_new
from v group by 1, 2""")
def j7_track_invariants(spark, sf_dir):
    """Each detection has one track and no two of a frame share it; a matched
    one lies within the gate of its track's place before, a new one has none."""
    v = _valid(spark, sf_dir)
    t = TK.track_detections(v).join(v.select("camera_id", "frame_id", "det_id", "cx", "cy"), ["camera_id", "frame_id", "det_id"])
    w = Window.partitionBy("camera_id", "assigned_track").orderBy("frame_id")
    far = F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    t = t.withColumn("far", far)
    return t.groupBy("camera_id", "frame_id").agg(
        F.count(F.lit(1)).alias("n_detections"), F.count_distinct("assigned_track").alias("n_tracks"),
        F.bool_and(~F.col("matched") | (F.coalesce("far", F.lit(1e9)) < TK.GATE_PX)).alias("gates_hold"),
        F.bool_and(F.col("matched") | F.col("far").isNull()).alias("new_is_new"))


@query("j7_ids_kept", views=("detections",), sql=f"""
with {_VALID},
u as (select * from v where track_id > 0 qualify count(*) over (partition by camera_id, frame_id, track_id) = 1)
select c.camera_id, c.frame_id, c.det_id, p.det_id as prev_det_id, true as same_track, true as matched
from u c join u p on c.camera_id = p.camera_id and c.track_id = p.track_id and c.frame_id = p.frame_id + 1
where sqrt((c.cx - p.cx) ^ 2 + (c.cy - p.cy) ^ 2) < 50""")
def j7_ids_kept(spark, sf_dir):
    """Where the detector names a vehicle in two frames in a row, within the
    gate, both detections are of one track."""
    v = _valid(spark, sf_dir)
    t = TK.track_detections(v).select("det_id", "assigned_track", "matched")
    named = v.where("track_id > 0").join(t, "det_id")
    once = named.groupBy("camera_id", "frame_id", "track_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("det_id", "cx", "cy", "assigned_track", "matched")]).where("n = 1")
    p = once.select("camera_id", (F.col("frame_id") + 1).alias("frame_id"), "track_id", F.col("det_id").alias("prev_det_id"),
                    F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("assigned_track").alias("before"))
    pairs = once.join(p, ["camera_id", "frame_id", "track_id"])
    near = F.sqrt((F.col("cx") - F.col("px")) * (F.col("cx") - F.col("px")) + (F.col("cy") - F.col("py")) * (F.col("cy") - F.col("py"))) < TK.GATE_PX
    return pairs.where(near).select("camera_id", "frame_id", "det_id", "prev_det_id", (F.col("assigned_track") == F.col("before")).alias("same_track"), "matched")


@query("b25_roundtrip_rows", sql="""
select reading_id, timestamp // 300 as rotation_bucket, true as roundtrip_ok from readings""")
def b25_roundtrip_rows(spark, sf_dir):
    return security.b25_payload_roundtrip(spark, sf_dir).select("reading_id", "rotation_bucket", "roundtrip_ok")


@query("a8_message_size", views=(), sql="""
select event_id, octet_length(encode(props))::bigint as payload_bytes from events""")
def a8_message_size(spark, sf_dir):
    """Byte size of a stored message."""
    return read_table(spark, sf_dir, "events").select("event_id", F.octet_length("props").alias("payload_bytes"))


_NODE = "least(1.0, {0}::double / b) * 0.6 + (1.0 / ({1} + 1))::double * 0.4"
_SCORES = [(_NODE.format(cap, lat), nid) for nid, cap, lat in SN.EDGE_NODES]
_BEST = "greatest(" + ", ".join(s for s, _ in _SCORES) + ")"


@query("c4_edge_node_of_message", views=(), sql=f"""
with s as (select event_id, octet_length(encode(props)) as b from events)
select event_id, case {" ".join(f"when {s} >= {_BEST} then '{n}'" for s, n in _SCORES)} end as node_id, R6({_BEST}) as node_score from s""")
def c4_edge_node_of_message(spark, sf_dir):
    """Best edge node by the byte size of a stored message."""
    return SN.choose_edge_node(a8_message_size(spark, sf_dir)).select("event_id", "node_id", "node_score")
