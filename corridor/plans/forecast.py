"""Registered queries: forecast, demand, latest state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import models as M
from ..sources import fixtures as V
from ._registry import query
from .models import _ALL_PRED, _EVAL, _all_predictions

_LATEST = """
lt as (select location, arg_max(timestamp, (timestamp, reading_id)) as timestamp,
         arg_max(reading_id, (timestamp, reading_id)) as reading_id,
         arg_max(weather, (timestamp, reading_id)) as weather,
         arg_max(vehicle_count, (timestamp, reading_id)) as vehicle_count,
         arg_max(average_speed_kmph, (timestamp, reading_id)) as average_speed_kmph
       from readings group by 1)"""


@query("c8_latest_per_location", sql=f"""
with {_LATEST}
select location, timestamp, reading_id, weather, vehicle_count::bigint as vehicle_count,
  R6(average_speed_kmph) as average_speed_kmph from lt""")
def c8_latest_per_location(spark, sf_dir):
    return FC.latest_per_location(V.readings(spark, sf_dir))


def _forecast_sql(where=""):
    return f"""
with {_LATEST},
h as (select *, hour(ts) as hour from readings),
s1 as (select location, weather, hour, avg(average_speed_kmph) as s1, avg(vehicle_count) as v1 from h group by 1, 2, 3),
s2 as (select location, hour, avg(average_speed_kmph) as s2, avg(vehicle_count) as v2 from h group by 1, 2),
pts as (select lt.location, lt.weather, st.step, lt.timestamp + st.step * 1800 as timestamp,
          hour(make_timestamp((lt.timestamp + st.step * 1800) * 1000000)) as hour
        from lt, (select unnest(range(1, 21)) as step) st),
f as (select pts.*, least(greatest(coalesce(s1, s2), 10.0), 90.0) as ps,
        least(greatest(coalesce(v1, v2), 10.0), 200.0) as pv
      from pts left join s1 on pts.location = s1.location and pts.weather = s1.weather and pts.hour = s1.hour
      left join s2 on pts.location = s2.location and pts.hour = s2.hour)
select location, weather, step, timestamp, hour, R6(ps) as predicted_speed, R6(pv) as predicted_volume,
  R6(ps + 10) as upper, R6(greatest(0.0, ps - 10)) as lower
from f {where}"""


@query("g7_forecast", sql=_forecast_sql())
def g7_forecast(spark, sf_dir):
    return FC.forecast(V.readings(spark, sf_dir))


@query("b30_forecast_slice", sql=_forecast_sql("where location = 'Location_A'"))
def b30_forecast_slice(spark, sf_dir):
    return FC.forecast_slice(FC.forecast(V.readings(spark, sf_dir)), location="Location_A")


@query("g8_demand_matrix", sql="""
select location, hour, R6(m) as mean_vehicle_count, R6(m / max(m) over ()) as demand
from (select location, hour(ts) as hour, avg(vehicle_count) as m from readings group by 1, 2)""")
def g8_demand_matrix(spark, sf_dir):
    return FC.demand_matrix(V.readings(spark, sf_dir))


@query("b29_proposed_rows", sql=f"""
with {_ALL_PRED}, {_EVAL}
select model, R6(accuracy) as accuracy, R6(1 - accuracy) as error, 'Proposed' as type
from ev where model <> 'hourly_mean'""")
def b29_proposed_rows(spark, sf_dir):
    ev = M.evaluate(_all_predictions(spark, sf_dir))
    typed = ev.withColumn("type", F.when(F.col("model") == "hourly_mean", "Existing").otherwise("Proposed"))
    return FC.rows_of_type(typed, "Proposed").select("model", "accuracy", (1 - F.col("accuracy")).alias("error"),
                                                     "type")
