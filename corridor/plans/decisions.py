"""Registered queries: decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.congestion import level_from_speed
from ..functions.time import event_time
from ..operators import decisions as D
from ..operators import stats as S
from ..sources import fixtures as V
from ._registry import query

R = V.readings


def _sql_map(mapping, col, default):
    whens = " ".join(f"when '{k}' then {v}::double" for k, v in mapping.items())
    return f"(case {col} {whens} else {default}::double end)"


_LEVEL = "(case when average_speed_kmph < 40 then 'High' when average_speed_kmph < 70 then 'Medium' else 'Low' end)"


def _pick(table, i):
    return "case " + " ".join(f"when {_LEVEL} = '{k}' then {repr(v[i]) if isinstance(v[i], str) else v[i]}"
                              for k, v in table.items()) + " end"


@query("b10_light_timing", sql=f"""
select reading_id, {_LEVEL} as congestion_level,
  ({_pick(D.LIGHT_TIMING, 0)})::bigint as green, ({_pick(D.LIGHT_TIMING, 1)})::bigint as yellow,
  ({_pick(D.LIGHT_TIMING, 2)})::bigint as red
from readings""")
def b10_light_timing(spark, sf_dir):
    r = R(spark, sf_dir)
    return r.select("reading_id", level_from_speed("average_speed_kmph").alias("congestion_level"),
                    D.light_timing("average_speed_kmph").alias("t")).select("reading_id", "congestion_level", "t.*")


@query("b11_route_advice", sql=f"""
select reading_id, {_pick(D.ROUTE_ADVICE, 0)} as advice,
  ({_pick(D.ROUTE_ADVICE, 1)})::bigint as delay_min_lo, ({_pick(D.ROUTE_ADVICE, 2)})::bigint as delay_min_hi
from readings""")
def b11_route_advice(spark, sf_dir):
    r = R(spark, sf_dir)
    return r.select("reading_id", D.route_advice("average_speed_kmph").alias("a")).select("reading_id", "a.*")


_CYCLE = (f"(60.0::double * (case when vehicle_count > 100 then 1.3::double when vehicle_count > 50 then 1.1::double "
          f"else 0.9::double end) * {_sql_map(D.SIGNAL_WEATHER, 'weather', 1.0)} * "
          f"(case when hour(ts) between 7 and 9 or hour(ts) between 17 and 19 then 1.2::double else 1.0::double end))")


@query("b12_signal_optimisation", sql=f"""
select reading_id, trunc({_CYCLE})::bigint as total_cycle_time, trunc({_CYCLE} * 0.55::double)::bigint as green_time,
  trunc({_CYCLE} * 0.08::double)::bigint as yellow_time, trunc({_CYCLE} * 0.37::double)::bigint as red_time,
  R6(least(100.0::double, 100.0::double / {_sql_map(D.SIGNAL_WEATHER, 'weather', 1.0)}
    / (case when hour(ts) between 7 and 9 or hour(ts) between 17 and 19 then 1.2::double else 1.0::double end)))
    as efficiency_score
from readings""")
def b12_signal_optimisation(spark, sf_dir):
    r = R(spark, sf_dir).withColumn("hour", F.hour(event_time("timestamp")))
    return D.signal_optimisation(r).select("reading_id", "total_cycle_time", "green_time", "yellow_time",
                                           "red_time", "efficiency_score")


_SF = ("(case when average_speed_kmph < 20 then 1.5::double when average_speed_kmph < 40 then 1.3::double "
       "when average_speed_kmph < 80 then 1.0::double else 1.2::double end)")
_WF = _sql_map(D.EMISSION_WEATHER, "weather", 1.0)
_BASE = " + ".join(f"trunc(vehicle_count * {s}::double) * {g}" for s, g in zip(D.FLEET_SHARES, D.FLEET_CO2))


@query("b13_environmental_impact", sql=f"""
select reading_id, R6(({_BASE}) * {_SF} * {_WF}) as total_co2_per_hour,
  R6(case when vehicle_count > 0 then ({_BASE}) * {_SF} * {_WF} / vehicle_count else 0.0 end) as co2_per_vehicle,
  R6(greatest(0.0, least(100.0, 100 - ({_SF} - 1) * 50))) as efficiency_rating,
  concat_ws(',', case when {_SF} > 1.2 then 'improve_flow' end,
    case when {_WF} > 1.1 then 'weather_adaptive_management' end,
    'public_transport_carpooling', 'ev_charging') as advice
from readings""")
def b13_environmental_impact(spark, sf_dir):
    e = D.environmental_impact(R(spark, sf_dir))
    return e.select("reading_id", "total_co2_per_hour", "co2_per_vehicle", "efficiency_rating",
                    F.array_join("advice", ",").alias("advice"))


_INSIGHTS_SQL = "\nunion all\n".join(
    f"select reading_id, '{p}' as priority, '{cat}' as category, '{code}' as rule from readings where {c}"
    for c, p, cat, code in D.INSIGHT_RULES)


@query("b14_infrastructure_insights", sql=_INSIGHTS_SQL)
def b14_infrastructure_insights(spark, sf_dir):
    return D.infrastructure_insights(R(spark, sf_dir), "reading_id")


@query("d41_insight_priority_counts", sql=f"""
select priority, count(*) as n_insights from ({_INSIGHTS_SQL}) i group by 1""")
def d41_insight_priority_counts(spark, sf_dir):
    return D.insight_priority_counts(D.infrastructure_insights(R(spark, sf_dir), "reading_id"))


def situations(spark, sf_dir):
    """Situations from readings: volume, truck share from the fleet split,
    density = count / max count, speed, weather, hour and day name."""
    r = R(spark, sf_dir)
    mx = r.select(F.max("vehicle_count")).scalar()
    t = event_time("timestamp")
    return r.select(F.col("reading_id").alias("situation_id"),
                    F.col("vehicle_count").alias("total_vehicles"),
                    (F.col("vehicle_count") * D.FLEET_SHARES[1]).cast("int").alias("truck_count"),
                    F.try_divide(F.col("vehicle_count"), mx).alias("density"),
                    F.col("average_speed_kmph").alias("predicted_speed"), "weather",
                    F.hour(t).alias("hour"), F.date_format(t, "EEEE").alias("day_name"))


_SIT_SQL = """
sit as (select reading_id as situation_id, vehicle_count as total_vehicles,
          cast(trunc(vehicle_count * 0.15::double) as int) as truck_count,
          vehicle_count / (select max(vehicle_count) from readings) as density,
          average_speed_kmph as predicted_speed, weather, hour(ts) as hour, dayname(ts) as day_name
        from readings)"""

_RECS_SQL = "\nunion all\n".join(
    f"select situation_id, '{sec}' as section, '{code}' as rule, '{pri}' as priority from sit where {cond}"
    for sec, code, pri, cond in D.RECOMMENDATION_RULES)


@query("b15_recommendations", sql=f"with {_SIT_SQL}\n{_RECS_SQL}")
def b15_recommendations(spark, sf_dir):
    return D.recommendations(situations(spark, sf_dir))


@query("b15_recommendation_summary", sql=f"""
with {_SIT_SQL}
select situation_id,
  case when density > 0.7 then 'critical' when density > 0.5 then 'concerning' else 'manageable' end as situation,
  case when density > 0.7 then 'immediate' when density > 0.5 then 'prompt' else 'routine' end as urgency,
  case when density > 0.6 then 'prevent_deterioration' else 'maintain_optimal_flow' end as goal,
  case when weather in ('Rainy', 'Snowy', 'Foggy') then 'significant' else 'minimal' end as weather_effect,
  case when predicted_speed < 40 then 'High' when predicted_speed < 70 then 'Medium' else 'Low' end as congestion_level,
  case when density > 0.7 then '15-25' when density > 0.5 then '10-20' else '5-10' end as flow_improvement_pct,
  case when density > 0.7 then '20-40' when density > 0.5 then '15-30' else '10-15' end as congestion_reduction_pct,
  case when density > 0.7 then 'significant_risk_reduction' when density > 0.5 then 'moderate_improvement'
    else 'high_standards_kept' end as safety_outcome
from sit""")
def b15_recommendation_summary(spark, sf_dir):
    return D.recommendation_summary(situations(spark, sf_dir)).select(
        "situation_id", "situation", "urgency", "goal", "weather_effect", "congestion_level",
        "flow_improvement_pct", "congestion_reduction_pct", "safety_outcome")


_EST = (f"(50.0::double * {_sql_map(D.SPEED_WEATHER, 'weather', 1.0)} * (case when vehicle_count > 100 then 0.7::double "
        f"when vehicle_count > 50 then 0.85::double else 1.0::double end))")


@query("b16_heuristic_speed", sql=f"""
select reading_id, R6(least(greatest({_EST}, 10.0), 120.0)) as speed_estimate_sample,
  R6(least(greatest({_EST}, 15.0), 100.0)) as speed_estimate_scoring
from readings""")
def b16_heuristic_speed(spark, sf_dir):
    return D.heuristic_speed(R(spark, sf_dir)).select("reading_id", "speed_estimate_sample", "speed_estimate_scoring")


@query("b17_integrity_check", sql="""
with t as (select reading_id,
  case when coalesce(vehicle_count, 0) > 1000 then 'high_vehicle_count' end as a,
  case when coalesce(average_speed_kmph, 0) < 0 or coalesce(average_speed_kmph, 0) > 200 then 'invalid_speed' end as b,
  case when abs((select max(timestamp) from readings) - timestamp) > 3600 then 'suspicious_timestamp' end as c
  from readings)
select reading_id, concat_ws(',', a, b, c) as issues,
  ((a is not null)::int + (b is not null)::int + (c is not null)::int)::bigint as issue_count,
  greatest(0, 100 - 25 * ((a is not null)::int + (b is not null)::int + (c is not null)::int))::bigint as security_score
from t""")
def b17_integrity_check(spark, sf_dir):
    r = R(spark, sf_dir)
    now = r.select(F.max("timestamp")).scalar()
    c = D.integrity_check(r, now)
    return c.select("reading_id", F.array_join("issues", ",").alias("issues"), "issue_count", "security_score")


@query("b18_edge_payload", sql="""
select reading_id, case weather when 'Sunny' then 0 when 'Cloudy' then 1 when 'Rainy' then 2 when 'Snowy' then 3
    when 'Foggy' then 4 else 0 end::bigint as weather_encoded,
  hour(ts) as hour, (hour(ts) between 7 and 9 or hour(ts) between 17 and 19)::bigint as is_rush_hour,
  isodow(ts) - 1 as day_of_week, R6(vehicle_count / (select max(vehicle_count) from readings)) as traffic_density,
  case when vehicle_count > 50 then 'medium' else 'low' end as congestion_level,
  case when weather in ('Rainy', 'Snowy', 'Foggy') then 'high' else 'low' end as weather_impact,
  vehicle_count > 50 as congestion_alert, weather in ('Rainy', 'Snowy', 'Foggy') as weather_adjustment
from readings""")
def b18_edge_payload(spark, sf_dir):
    r = R(spark, sf_dir)
    mx = r.select(F.max("vehicle_count")).scalar()
    p = D.edge_payload(r.withColumn("density", F.try_divide(F.col("vehicle_count"), mx)))
    return p.select("reading_id", "payload.weather_encoded", "payload.time_features.hour",
                    "payload.time_features.is_rush_hour", "payload.time_features.day_of_week",
                    F.col("payload.traffic_density").alias("traffic_density"), "congestion_level",
                    "weather_impact", "congestion_alert", "weather_adjustment")


@query("b20_weather_alerts", sql="""
select weather, R6(avg(average_speed_kmph)) as avg_speed,
  case when avg(average_speed_kmph) < 40 then 'High' when avg(average_speed_kmph) < 60 then 'Medium'
       else 'Low' end as alert_level
from readings group by 1""")
def b20_weather_alerts(spark, sf_dir):
    return D.weather_alerts(R(spark, sf_dir))


@query("b21_location_recommendations", sql="""
with a as (select location, floor(avg(average_speed_kmph) * 100 + 0.5) / 100 as speed_avg,
             floor(avg(vehicle_count) * 100 + 0.5) / 100 as vehicle_avg from readings group by 1),
p as (select *, (speed_avg / max(speed_avg) over () * 0.6
                 + (1 - vehicle_avg / max(vehicle_avg) over ()) * 0.4) * 100 as ps from a)
select location, R6(ps) as performance_score,
  case when ps < 60 then 'High' when ps < 75 then 'Medium' else 'Low' end as priority,
  case when ps > 80 then 'excellent' when ps > 60 then 'good' else 'poor' end as performance_band
from p""")
def b21_location_recommendations(spark, sf_dir):
    p = D.location_recommendations(S.location_performance(R(spark, sf_dir)))
    return p.select("location", "performance_score", "priority",
                    D.score_band("performance_score", 80, 60).alias("performance_band"))


@query("b22_gauges", sql="""
select reading_id, R6(vehicle_count / (select max(vehicle_count) from readings) * 100) as density_gauge,
  R6(least(greatest(100 - average_speed_kmph, 0.0), 100.0)) as congestion_gauge
from readings""")
def b22_gauges(spark, sf_dir):
    r = R(spark, sf_dir)
    mx = r.select(F.max("vehicle_count")).scalar()
    return D.gauges(r, F.try_divide(F.col("vehicle_count"), mx)).select("reading_id", "density_gauge",
                                                                         "congestion_gauge")


@query("b23_expected_load", sql="""
select reading_id, R6(10 + vehicle_count / 10 + case when weather in ('Rainy', 'Snowy') then 5 else 0 end)
    as expected_latency_ms,
  R6(greatest(60.0, 95 - vehicle_count / 5)) as expected_efficiency,
  R6(least(100.0, vehicle_count * 0.8)) as processing_load
from readings""")
def b23_expected_load(spark, sf_dir):
    return D.expected_load(R(spark, sf_dir)).select("reading_id", "expected_latency_ms", "expected_efficiency",
                                                   "processing_load")


@query("b24_situation_flags", sql="""
select reading_id, vehicle_count > 50 as high_volume,
  vehicle_count / (select max(vehicle_count) from readings) > 0.7 as critical_density,
  weather in ('Rainy', 'Snowy', 'Foggy') as weather_advisory,
  case when weather in ('Rainy', 'Snowy', 'Foggy') then 'High' else 'Low' end as weather_impact
from readings""")
def b24_situation_flags(spark, sf_dir):
    r = R(spark, sf_dir)
    mx = r.select(F.max("vehicle_count")).scalar()
    r = r.withColumn("density", F.try_divide(F.col("vehicle_count"), mx))
    return D.situation_flags(r, "vehicle_count", "density").select(
        "reading_id", "high_volume", "critical_density", "weather_advisory", "weather_impact")


@query("d48_adaptive_timing", sql="""
with a as (select location, avg(coalesce(vehicle_count, 0)) as avg_vehicle_count,
             avg(coalesce(average_speed_kmph, 50.0)) as avg_speed from readings group by 1),
m as (select *, least(2.0, greatest(0.5, avg_vehicle_count / 50)) as c,
        case when avg_speed > 0 then least(1.5, greatest(0.7, 50.0 / avg_speed)) else 1.0 end as s from a)
select location, R6(avg_vehicle_count) as avg_vehicle_count, R6(avg_speed) as avg_speed,
  R6(c) as count_multiplier, R6(s) as speed_multiplier, trunc(30.0 * c * s)::bigint as green,
  5::bigint as yellow, greatest(15, trunc(25.0 * (2 - c)))::bigint as red
from m""")
def d48_adaptive_timing(spark, sf_dir):
    return D.adaptive_timing(R(spark, sf_dir))


@query("k1_format_timestamp", sql="""
select reading_id, coalesce(strftime(make_timestamp(cast(floor(try_cast(cast(timestamp as varchar) as double)) as bigint)
  * 1000000), '%Y-%m-%d %H:%M:%S'), 'Invalid timestamp') as formatted
from readings""")
def k1_format_timestamp(spark, sf_dir):
    r = R(spark, sf_dir)
    return r.select("reading_id", D.format_timestamp(F.col("timestamp").cast("string")).alias("formatted"))


@query("c6_weather_factors", sql=f"""
select reading_id, weather, R6({_sql_map(D.SIGNAL_WEATHER, 'weather', 1.0)}) as signal_factor,
  R6({_sql_map(D.EMISSION_WEATHER, 'weather', 1.0)}) as emission_factor,
  R6({_sql_map(D.SPEED_WEATHER, 'weather', 1.0)}) as speed_factor
from readings""")
def c6_weather_factors(spark, sf_dir):
    """Dimension lookups weather -> factor (unknown -> 1.0) for the three rules."""
    r = R(spark, sf_dir)
    w = F.col("weather")
    return r.select("reading_id", "weather", D._map_lookup(D.SIGNAL_WEATHER, w, 1.0).alias("signal_factor"),
                    D._map_lookup(D.EMISSION_WEATHER, w, 1.0).alias("emission_factor"),
                    D._map_lookup(D.SPEED_WEATHER, w, 1.0).alias("speed_factor"))
