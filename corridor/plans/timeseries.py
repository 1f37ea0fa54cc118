"""Registered queries: series features and incident detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as TS
from ..operators.series import POS
from ..sources import fixtures as V
from ._registry import query

# Rows per series chunk in the registered queries: small enough that every
# location spans several chunks at sf0.01, so the halo path is exercised.
CHUNK_ROWS = 1000

_W = "partition by location order by timestamp, reading_id"
_T = "average_speed_kmph"


def _lag_cols_sql():
    cols = [f"R6(lag({_T}, {k}) over (w)) as {_T}_lag_{k}" for k in TS.LAGS]
    for n in TS.ROLLING:
        fr = f"({_W} rows between {n - 1} preceding and current row)"
        cols.append(f"R6(case when count({_T}) over {fr} = {n} then avg({_T}) over {fr} end) as {_T}_rolling_mean_{n}")
        cols.append(f"R6(case when count({_T}) over {fr} = {n} then stddev_samp({_T}) over {fr} end) "
                    f"as {_T}_rolling_std_{n}")
    return ",\n  ".join(cols)


_FEATURES_SQL = f"""
select reading_id, location, row_number() over (w) - 1 as series_pos,
  {_lag_cols_sql()}
from readings window w as ({_W})"""


def _series(spark, sf_dir):
    """Keys, order and target only: the rank's checkpoint holds no other column."""
    return V.readings(spark, sf_dir).select("reading_id", "location", "timestamp", _T)


def _lag_out(df):
    keep = ["reading_id", "location", POS] + [c for c in df.columns if c.startswith(f"{_T}_")]
    return df.select(*keep)


@query("e1_lag_rolling_features", sql=_FEATURES_SQL)
def e1_lag_rolling_features(spark, sf_dir):
    return _lag_out(TS.lag_features(_series(spark, sf_dir), chunk_rows=CHUNK_ROWS))


@query("e3_complete_feature_rows", sql=f"""
select * from ({_FEATURES_SQL}) f
where {" and ".join(f"{_T}_lag_{k} is not null" for k in TS.LAGS)}
  and {" and ".join(f"{_T}_rolling_{s}_{n} is not null" for n in TS.ROLLING for s in ("mean", "std"))}""")
def e3_complete_feature_rows(spark, sf_dir):
    f = TS.lag_features(_series(spark, sf_dir), chunk_rows=CHUNK_ROWS)
    return _lag_out(TS.complete_rows(f))


_CHANGES_SQL = f"""
c as (select reading_id, location, timestamp, row_number() over (w) - 1 as pos,
        {_T} - lag({_T}) over (w) as ch,
        max({_T}) over ({_W} rows between 2 preceding and current row) as mx3,
        count(*) over (partition by location) as n
      from readings window w as ({_W}))"""

_SLOWDOWN_SQL = """
select 'sudden_slowdown' as type, case when ch < -40 then 'high' else 'medium' end as severity,
  location, reading_id, timestamp, R6(abs(ch)) as drop_kmph
from c where ch < -20 and n >= 5"""

_PERSISTENT_SQL = """
select 'persistent_congestion' as type, 'medium' as severity, location, reading_id, timestamp,
  cast(null as double) as drop_kmph
from c where pos >= 2 and mx3 < 15"""


@query("e4_sudden_slowdowns", sql=f"with {_CHANGES_SQL} {_SLOWDOWN_SQL}")
def e4_sudden_slowdowns(spark, sf_dir):
    return TS.sudden_slowdowns(TS.speed_changes(V.readings(spark, sf_dir), CHUNK_ROWS))


@query("e5_persistent_congestion", sql=f"with {_CHANGES_SQL} {_PERSISTENT_SQL}")
def e5_persistent_congestion(spark, sf_dir):
    return TS.persistent_congestion(TS.speed_changes(V.readings(spark, sf_dir), CHUNK_ROWS))


@query("e5_persistent_congestion_latest", sql=f"with {_CHANGES_SQL} {_PERSISTENT_SQL} and pos = n - 1")
def e5_persistent_congestion_latest(spark, sf_dir):
    return TS.persistent_congestion_latest(V.readings(spark, sf_dir))


@query("h4_incidents", sql=f"with {_CHANGES_SQL} {_SLOWDOWN_SQL} union all {_PERSISTENT_SQL}")
def h4_incidents(spark, sf_dir):
    return TS.incidents(V.readings(spark, sf_dir), CHUNK_ROWS)


_TREND_CTE = f"""
s as (select *, row_number() over ({_W}) - 1 as pos, count(*) over (partition by location) as n from readings),
l as (select * from s where pos >= n - 10 and n >= 3),
g as (select location, regr_slope({_T}, pos::double) as speed_slope,
        regr_slope(vehicle_count::double, pos::double) as volume_slope,
        arg_max({_T}, pos) as ls, arg_max(vehicle_count, pos) as lv, arg_max(timestamp, pos) as lt
      from l group by 1),
b as (select hour(ts) as hour, avg({_T}) as speed_mean, avg(vehicle_count) as volume_mean from readings group by 1),
x as (select g.*, ls + speed_slope * 3 as fs, lv + volume_slope * 3 as fv, b.speed_mean, b.volume_mean
      from g left join b on hour(make_timestamp(lt * 1000000)) = b.hour)"""


@query("e6_trend_slopes", sql=f"""
with s as (select *, row_number() over ({_W}) - 1 as pos, count(*) over (partition by location) as n from readings)
select location, R6(regr_slope({_T}, pos::double)) as speed_slope,
  R6(regr_slope(vehicle_count::double, pos::double)) as volume_slope, count(*) as n_points
from s where pos >= n - 10 group by 1""")
def e6_trend_slopes(spark, sf_dir):
    return TS.trend_slopes(V.readings(spark, sf_dir))


@query("e6_future_anomalies", sql=f"""
with {_TREND_CTE}
select location, R6(speed_slope) as speed_slope, R6(volume_slope) as volume_slope,
  'speed_anomaly_predicted' as type, R6(fs) as predicted_value, R6(speed_mean) as normal_value,
  '15_minutes' as time_horizon, 0.7::double as confidence
from x where abs(fs - speed_mean) > 30
union all
select location, R6(speed_slope), R6(volume_slope), 'volume_anomaly_predicted', R6(fv), R6(volume_mean),
  '15_minutes', 0.7::double
from x where abs(fv - volume_mean) > 50""")
def e6_future_anomalies(spark, sf_dir):
    return TS.trend_forecast(V.readings(spark, sf_dir))


@query("e7_peak_hours", sql=f"""
with h as (select hour(ts) as hour, floor(avg(vehicle_count) * 100 + 0.5) / 100 as vc,
             floor(avg({_T}) * 100 + 0.5) / 100 as sp from readings group by 1),
i as (select *, vc / max(vc) over () * 0.6 + (100 - sp) / 100 * 0.4 as intensity from h),
t as (select *, quantile_cont(intensity, 0.75) over () as threshold from i),
p as (select *, hour - row_number() over (order by hour) as island from t where intensity >= threshold),
g as (select min(hour) as start, max(hour) as "end", avg(intensity) as mi, avg(vc) as av, avg(sp) as asp
      from p group by island)
select start, "end", R6(mi) as mean_intensity, R6(av) as avg_vehicles, R6(asp) as avg_speed,
  case when mi > 0.8 then 'High' when mi > 0.6 then 'Medium' else 'Low' end as intensity,
  row_number() over (order by start) as period
from g""")
def e7_peak_hours(spark, sf_dir):
    return TS.peak_hours(V.readings(spark, sf_dir))


@query("e9_location_volume_share", sql="""
select location, R6(m) as mean_vehicle_count, R6(m / max(m) over ()) as mean_vehicle_count_norm
from (select location, avg(vehicle_count) as m from readings group by 1)""")
def e9_location_volume_share(spark, sf_dir):
    a = V.readings(spark, sf_dir).groupBy("location").agg(F.avg("vehicle_count").alias("mean_vehicle_count"))
    return TS.max_normalised(a, "mean_vehicle_count")


@query("e2_rolling_stats", sql=f"""
select reading_id, location, {", ".join(f"{_T}_rolling_{s}_{n}" for n in TS.ROLLING for s in ("mean", "std"))}
from ({_FEATURES_SQL}) f""")
def e2_rolling_stats(spark, sf_dir):
    f = TS.lag_features(_series(spark, sf_dir), chunk_rows=CHUNK_ROWS)
    return f.select("reading_id", "location",
                    *[f"{_T}_rolling_{s}_{n}" for n in TS.ROLLING for s in ("mean", "std")])
