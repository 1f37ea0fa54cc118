"""Registered queries: prediction tables, evaluation, ensembles and fitted
models (C7, D42-D44, G3-G6, G9-G13, H1, H3).

The exact oracles use two models whose predictions are SQL expressions: the
heuristic speed estimate (B16 scoring path) and the hourly mean speed of the
training rows (a seasonal-naive baseline, the "existing" system).  Fitted
Spark ML models get property checks (rows-only here, tests in tests/).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import event_time
from ..operators import decisions as D
from ..operators import features as FE
from ..operators import isolation as IF
from ..operators import models as M
from ..session import stored
from ..sources import fixtures as V
from ._registry import query


def prediction_table(spark, sf_dir):
    """(reading_id, model, actual, predicted) on the hash-split test rows."""
    r = FE.train_test_split(V.readings(spark, sf_dir)).withColumn("hour", F.hour(event_time("timestamp")))
    # training-row hourly means: at most 24 rows, broadcast is bounded
    hm = r.where(~F.col("is_test")).groupBy("hour").agg(F.avg("average_speed_kmph").alias("hourly_mean"))
    test = D.heuristic_speed(r.where("is_test").join(F.broadcast(hm), "hour", "left"))
    # both models in one row, then one row each: the test rows are read once
    both = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted"))
                     for m, c in (("heuristic", "speed_estimate_scoring"), ("hourly_mean", "hourly_mean"))])
    return (test.select("reading_id", F.col("average_speed_kmph").alias("actual"), F.explode(both).alias("p"))
            .select("reading_id", "p.model", "actual", "p.predicted"))


_WF = "(case weather when 'Sunny' then 1.0 when 'Cloudy' then 0.95 when 'Rainy' then 0.8 when 'Snowy' then 0.7 " \
      "when 'Foggy' then 0.75 else 1.0 end)::double"
_CF = "(case when vehicle_count > 100 then 0.7 when vehicle_count > 50 then 0.85 else 1.0 end)::double"
_PRED = f"""
f as (select reading_id, ts, average_speed_kmph as actual, vehicle_count, weather,
        cast(concat('0x', substr(md5(cast(reading_id as varchar)), 1, 8)) as bigint) % 100 < 20 as is_test
      from readings),
hm as (select hour(ts) as hour, avg(actual) as m from f where not is_test group by 1),
p as (select reading_id, 'heuristic' as model, actual,
        least(greatest(50.0::double * {_WF} * {_CF}, 15.0), 100.0) as predicted from f where is_test
      union all
      select f.reading_id, 'hourly_mean', actual, hm.m from f left join hm on hour(f.ts) = hm.hour where is_test)"""

_BANDS = """
b as (select *, coalesce(case when actual > 0 and actual <= 40 then 0 when actual > 40 and actual <= 70 then 1
                          when actual > 70 and actual <= 100 then 2 end, 1) as ab,
        coalesce(case when predicted > 0 and predicted <= 40 then 0 when predicted > 40 and predicted <= 70 then 1
                      when predicted > 70 and predicted <= 100 then 2 end, 1) as pb from p)"""

_EVAL = f"""
{_BANDS},
reg as (select model, count(*) as n, avg((actual - predicted) ^ 2) as mse, sum((actual - predicted) ^ 2) as ss,
          var_pop(actual) as v, avg((ab = pb)::int::double) as accuracy from b group by 1),
cm as (select model, ab, pb, count(*) as c from b group by 1, 2, 3),
act as (select model, ab as cls, sum(c) as support from cm group by 1, 2),
prd as (select model, pb as cls, sum(c) as pn from cm group by 1, 2),
tp as (select model, ab as cls, c as tp from cm where ab = pb),
per as (select coalesce(act.model, prd.model) as model, coalesce(act.cls, prd.cls) as cls,
          coalesce(support, 0) as support, coalesce(pn, 0) as pn from act full join prd
          on act.model = prd.model and act.cls = prd.cls),
per2 as (select per.*, coalesce(tp.tp, 0) as tp from per left join tp on per.model = tp.model and per.cls = tp.cls),
per3 as (select *, coalesce(tp / nullif(pn, 0), 0.0) as prec, coalesce(tp / nullif(support, 0), 0.0) as rec from per2),
per4 as (select *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) as f1 from per3),
w as (select model, sum(prec * support) / sum(support) as precision, sum(rec * support) / sum(support) as recall,
        sum(f1 * support) / sum(support) as f1_score from per4 group by 1),
ev as (select reg.model, n, mse, 1 - ss / (v * n) as r2, accuracy, precision, recall, f1_score
       from reg join w on reg.model = w.model)"""


@query("d43_model_evaluation", sql=f"""
with {_PRED}, {_EVAL}
select model, n, R6(mse) as mse, R6(r2) as r2, R6(accuracy) as accuracy, R6(precision) as precision,
  R6(recall) as recall, R6(f1_score) as f1_score from ev""")
def d43_model_evaluation(spark, sf_dir):
    return M.evaluate(prediction_table(spark, sf_dir))


@query("d43_confusion_matrix", sql=f"""
with {_PRED}, {_BANDS},
cells as (select model, a.a as actual_band, b.b as predicted_band
          from (select distinct model from p) m, (select unnest([0, 1, 2]) as a) a, (select unnest([0, 1, 2]) as b) b)
select cells.model, cells.actual_band::bigint as actual_band, cells.predicted_band::bigint as predicted_band,
  count(b.model) as count
from cells left join b on cells.model = b.model and cells.actual_band = b.ab and cells.predicted_band = b.pb
group by 1, 2, 3""")
def d43_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(prediction_table(spark, sf_dir))


_WEIGHTS = """
wt as (select model, mse, (1.0 / (mse + 1e-8)) / sum(1.0 / (mse + 1e-8)) over () as weight
       from (select model, avg((actual - predicted) ^ 2) as mse from p group by 1))"""


@query("g6_ensemble_weights", sql=f"""
with {_PRED}, {_WEIGHTS}
select model, R6(mse) as mse, R6(weight) as weight from wt""")
def g6_ensemble_weights(spark, sf_dir):
    return M.ensemble_weights(prediction_table(spark, sf_dir))


@query("g6_ensemble_predictions", sql=f"""
with {_PRED}, {_WEIGHTS}
select p.reading_id, R6(max(p.actual)) as actual, R6(sum(p.predicted * wt.weight)) as predicted, 'ensemble' as model
from p join wt on p.model = wt.model group by 1""")
def g6_ensemble_predictions(spark, sf_dir):
    e = M.ensemble_predictions(prediction_table(spark, sf_dir))
    return e.select("reading_id", "actual", "predicted", "model")


@query("g13_mean_prediction_decisions", sql=f"""
with {_PRED},
m as (select reading_id, avg(predicted) as s from p group by 1)
select reading_id, R6(s) as mean_predicted_speed,
  case when s < 40 then 'High' when s < 70 then 'Medium' else 'Low' end as congestion_level,
  (case when s < 40 then 45 when s < 70 then 35 else 30 end)::bigint as green,
  (case when s < 40 then 20 when s < 70 then 25 else 26 end)::bigint as red
from m""")
def g13_mean_prediction_decisions(spark, sf_dir):
    m = M.mean_prediction(prediction_table(spark, sf_dir))
    return m.select("reading_id", "mean_predicted_speed", "congestion_level",
                    F.col("timing.green").alias("green"), F.col("timing.red").alias("red"))


@query("c7_prediction_alignment", sql=f"""
with {_PRED}
select p.reading_id, p.model, R6(actual) as actual, R6(predicted) as predicted, R6(predicted - actual) as error,
  R6(r.line_min) as line_min, R6(r.line_max) as line_max
from p join (select model, least(min(actual), min(predicted)) as line_min,
                    greatest(max(actual), max(predicted)) as line_max from p group by 1) r on p.model = r.model""")
def c7_prediction_alignment(spark, sf_dir):
    a = M.alignment(prediction_table(spark, sf_dir))
    return a.select("reading_id", "model", "actual", "predicted", "error", "line_min", "line_max")


def _all_predictions(spark, sf_dir):
    p = stored(prediction_table(spark, sf_dir), "predictions")
    return p.unionByName(M.ensemble_predictions(p).select("reading_id", "model", "actual", "predicted"))


_ALL_PRED = f"""
{_PRED.replace("p as (select", "p0 as (select")},
{_WEIGHTS.replace("from p group", "from p0 group")},
p as (select * from p0 union all
      select p0.reading_id, 'ensemble', max(p0.actual), sum(p0.predicted * wt.weight)
      from p0 join wt on p0.model = wt.model group by 1)"""


@query("d42_model_comparison", sql=f"""
with {_ALL_PRED}, {_EVAL},
l as (select model, 'accuracy' as metric, accuracy as value from ev union all
      select model, 'precision', precision from ev union all select model, 'recall', recall from ev union all
      select model, 'f1_score', f1_score from ev)
select metric, R6(max(value)) as best, R6(min(value)) as worst, R6(avg(value)) as average,
  R6(stddev_pop(value)) as std, arg_min(model, (-value, model)) as best_model
from l group by 1""")
def d42_model_comparison(spark, sf_dir):
    return M.model_comparison(M.evaluate(_all_predictions(spark, sf_dir)))


@query("d44_proposed_vs_existing", sql=f"""
with {_ALL_PRED}, {_EVAL},
g as (select avg(case when model <> 'hourly_mean' then accuracy end) as pa,
        avg(case when model = 'hourly_mean' then accuracy end) as ea from ev)
select R6(pa) as proposed_accuracy, R6(ea) as existing_accuracy, R6((pa - ea) / ea * 100) as accuracy_improvement_pct,
  R6(((1 - ea) - (1 - pa)) / (1 - ea) * 100) as error_reduction_pct from g""")
def d44_proposed_vs_existing(spark, sf_dir):
    ev = M.evaluate(_all_predictions(spark, sf_dir))
    return M.proposed_vs_existing(ev, existing=["hourly_mean"])


@query("h3_latest_results", sql=f"""
with {_ALL_PRED}, {_EVAL},
runs as (select 1::bigint as run_id, model, mse from ev where model in ('heuristic', 'hourly_mean')
         union all
         select 2::bigint, model, mse from ev where model in ('hourly_mean', 'ensemble'))
select model, run_id, R6(mse) as mse from (
  select *, row_number() over (partition by model order by run_id desc) as rn from runs) where rn = 1""")
def h3_latest_results(spark, sf_dir):
    """Two result sets (run 1: heuristic + hourly mean; run 2, later: hourly
    mean + ensemble) merged with the later run winning per model."""
    ev = M.evaluate(_all_predictions(spark, sf_dir)).select("model", "mse")
    run1 = ev.where(F.col("model").isin("heuristic", "hourly_mean")).withColumn("run_id", F.lit(1))
    run2 = ev.where(F.col("model").isin("hourly_mean", "ensemble")).withColumn("run_id", F.lit(2))
    return M.latest_results(run1.unionByName(run2)).select("model", "run_id", "mse")


# --------------------------------------------------- fitted models (P) --

def _features(spark, sf_dir):
    return FE.train_test_split(FE.model_features(V.readings(spark, sf_dir)))


@query("g3_random_forest_predictions")
def g3_random_forest_predictions(spark, sf_dir):
    """Random forest (50 trees) fitted on the training rows, test-row predictions."""
    f = _features(spark, sf_dir)
    return M.predictions(M.train_models(f, ["random_forest"]), f)


@query("g4_gradient_boosting_evaluation")
def g4_gradient_boosting_evaluation(spark, sf_dir):
    """Gradient-boosted trees (50 rounds), evaluated with D43."""
    f = _features(spark, sf_dir)
    return M.evaluate(M.predictions(M.train_models(f, ["gradient_boosting"]), f))


@query("g5_polynomial_regression_evaluation")
def g5_polynomial_regression_evaluation(spark, sf_dir):
    """Degree-2 polynomial regression, evaluated with D43."""
    f = _features(spark, sf_dir)
    return M.evaluate(M.predictions(M.train_models(f, ["polynomial_regression"]), f))


@query("g10_forest_uncertainty")
def g10_forest_uncertainty(spark, sf_dir):
    """Mean and spread of the forest's trees per test row."""
    f = _features(spark, sf_dir)
    m = M.train_models(f, ["random_forest"])["random_forest"]
    return M.forest_uncertainty(m, f.where("is_test")).select("reading_id", "prediction_mean", "prediction_std")


@query("g11_feature_importance")
def g11_feature_importance(spark, sf_dir):
    """Random-forest feature importances, sorted."""
    f = _features(spark, sf_dir)
    return M.feature_importance(spark, M.train_models(f, ["random_forest"])["random_forest"])


_IF_FEATURES = ("average_speed_kmph", "vehicle_count", "hour", "weather_encoded", "is_weekend")


@query("g12_isolation_forest_scores")
def g12_isolation_forest_scores(spark, sf_dir):
    """Isolation-forest score and the top-10 % flag per reading."""
    f = FE.model_features(V.readings(spark, sf_dir))
    return IF.detect(f, _IF_FEATURES, "reading_id").select("reading_id", "if_score", "is_ml_anomaly")


@query("g1_model_features", sql="""
with l as (select location, dense_rank() over (order by location) - 1 as c
           from (select distinct location from readings where location is not null)),
     w as (select weather, dense_rank() over (order by weather) - 1 as c
           from (select distinct weather from readings where weather is not null)),
     s as (select r.*, vehicle_count / (select max(vehicle_count) from readings) * 0.6
             + (100.0 - average_speed_kmph) / 100.0 * 0.4 as sc from readings r)
select s.reading_id, s.vehicle_count::bigint as vehicle_count, coalesce(l.c, 0) as location_encoded,
  coalesce(w.c, 0) as weather_encoded, hour(ts) as hour, isodow(ts) - 1 as day_of_week, month(ts) as month,
  cast(isodow(ts) - 1 >= 5 as bigint) as is_weekend,
  cast(hour(ts) between 7 and 9 or hour(ts) between 17 and 19 as bigint) as is_rush_hour,
  (case when sc > 0 and sc <= 0.33 then 0 when sc > 0.33 and sc <= 0.66 then 1
        when sc > 0.66 and sc <= 1.0 then 2 end)::varchar as congestion_class,
  coalesce(case when average_speed_kmph > 0 and average_speed_kmph <= 40 then 0
                when average_speed_kmph > 40 and average_speed_kmph <= 70 then 1
                when average_speed_kmph > 70 and average_speed_kmph <= 100 then 2 end, 1)::bigint as speed_band_code
from s left join l on s.location = l.location left join w on s.weather = w.weather""")
def g1_model_features(spark, sf_dir):
    f = FE.model_features(V.readings(spark, sf_dir))
    return f.select("reading_id", *FE.FEATURE_COLUMNS,
                    F.col("congestion_class").cast("string").alias("congestion_class"), "speed_band_code")


@query("h1_model_result_union", sql=f"""
with {_ALL_PRED}, {_EVAL}
select model, case when model = 'hourly_mean' then 'Existing' else 'Proposed' end as type,
  R6(accuracy) as accuracy, R6(mse) as mse from ev""")
def h1_model_result_union(spark, sf_dir):
    ev = M.evaluate(_all_predictions(spark, sf_dir))
    existing = ev.where(F.col("model") == "hourly_mean").withColumn("type", F.lit("Existing"))
    proposed = ev.where(F.col("model") != "hourly_mean").withColumn("type", F.lit("Proposed"))
    return existing.unionByName(proposed).select("model", "type", "accuracy", "mse")


@query("g9_model_scoring")
def g9_model_scoring(spark, sf_dir):
    """Fit the linear model on the training rows and score the test rows
    with the saved-pipeline API (``PipelineModel.transform``)."""
    f = _features(spark, sf_dir)
    return M.predictions(M.train_models(f, ["linear_regression"]), f)
