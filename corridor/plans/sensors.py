"""Registered queries: sensor payloads, fusion and registry health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sensors as SN
from ..sources import fixtures as V
from ..sources.tables import read_table
from ._registry import query

_VIEWS = ("sensors", "sensor_readings")

_TAGGED = """
l as (select * from sensor_readings
      qualify row_number() over (partition by hour_bucket, sensor_key order by ts desc, event_id desc) = 1),
t as (select r.*, s.sensor_id, s.category from l r join sensors s on r.sensor_key = s.sensor_key
      where s.status = 'active')"""

_WF = """((case when precipitation > 10 then 0.7 when precipitation > 5 then 0.85 else 1.0 end)
  * (case when visibility < 100 then 0.5 when visibility < 500 then 0.75 else 1.0 end)
  * (case when wind_speed > 20 then 0.8 else 1.0 end)
  * (case when road_condition in ('icy', 'snow') then 0.6 when road_condition = 'wet' then 0.8 else 1.0 end))"""

_FUSED = f"""
{_TAGGED},
g as (select hour_bucket,
        avg(case when category = 'speed' then average_speed end) as average_speed,
        stddev_pop(case when category = 'speed' then average_speed end) as sd,
        coalesce(sum(case when category = 'speed' then vehicle_count end), 0)::bigint as total_volume,
        avg(case when category = 'speed' then vehicle_count end) as average_volume,
        count_if(category = 'speed')::bigint as n_speed_readings,
        greatest(0.0, least(1.0, product(case when category = 'weather' then {_WF}::double else 1.0 end)))
          as weather_impact_score,
        greatest(0.0, least(1.0, product(case when category = 'air_quality' then (case when air_quality_index > 150
          then 0.6 when air_quality_index > 100 then 0.75 when air_quality_index > 50 then 0.9 else 1.0 end)::double
          else 1.0 end))) as air_quality_impact_score,
        greatest(0.0, least(1.0, product(case when category = 'noise' then (case when decibel_level > 80 then 0.5
          when decibel_level > 70 then 0.7 when decibel_level > 60 then 0.85 else 1.0 end)::double else 1.0 end)))
          as noise_impact_score
      from t group by 1),
h as (select *, (weather_impact_score + air_quality_impact_score + noise_impact_score) / 3 as env,
        case when average_speed between 40 and 70 then 1.0 when average_speed < 20 then 0.3
             when average_speed < 40 then 0.6 when average_speed is not null then 0.8 end as sf,
        case when average_volume < 30 then 0.8 when average_volume <= 80 then 1.0 when average_volume <= 120 then 0.7
             when average_volume is not null then 0.4 end as vf
      from g)"""


def _fused(spark, sf_dir):
    return SN.fuse(V.sensor_readings(spark, sf_dir), V.sensors(spark, sf_dir))


@query("d36_sensor_fusion", views=_VIEWS, sql=f"""
with {_FUSED}
select hour_bucket, R6(average_speed) as average_speed, R6(1 - sd / average_speed) as speed_confidence,
  total_volume, R6(average_volume) as average_volume, n_speed_readings from h""")
def d36_sensor_fusion(spark, sf_dir):
    f = _fused(spark, sf_dir).withColumn("total_volume", F.coalesce("total_volume", F.lit(0)))
    return f.select("hour_bucket", "average_speed", "speed_confidence", "total_volume", "average_volume",
                    "n_speed_readings")


@query("d37_environmental_impact", views=_VIEWS, sql=f"""
with {_FUSED}
select hour_bucket, R6(weather_impact_score + 1e-9) as weather_impact_score,
  R6(air_quality_impact_score + 1e-9) as air_quality_impact_score, R6(noise_impact_score + 1e-9) as noise_impact_score,
  R6(env + 1e-9) as overall_environmental_score from h""")
def d37_environmental_impact(spark, sf_dir):
    # products of two-decimal factors often end in a 5 at the seventh decimal;
    # the nudge rounds them alike whatever the order of multiplication
    return _fused(spark, sf_dir).select("hour_bucket", *[(F.col(c) + 1e-9).alias(c) for c in (
        "weather_impact_score", "air_quality_impact_score", "noise_impact_score", "overall_environmental_score")])


@query("d38_traffic_health", views=_VIEWS, sql=f"""
with {_FUSED}
select hour_bucket, R6((coalesce(sf, 0) + env + coalesce(vf, 0))
  / ((sf is not null)::int + 1 + (vf is not null)::int)) as traffic_health_score,
  case when (coalesce(sf, 0) + env + coalesce(vf, 0)) / ((sf is not null)::int + 1 + (vf is not null)::int) > 0.8
       then 'excellent'
       when (coalesce(sf, 0) + env + coalesce(vf, 0)) / ((sf is not null)::int + 1 + (vf is not null)::int) > 0.6
       then 'good' else 'poor' end as health_band
from h""")
def d38_traffic_health(spark, sf_dir):
    from ..operators.decisions import score_band
    f = _fused(spark, sf_dir)
    return f.select("hour_bucket", "traffic_health_score",
                    score_band("traffic_health_score", 0.8, 0.6).alias("health_band"))


@query("d39_sensor_inventory", views=_VIEWS, sql="""
with rep as (select distinct sensor_key from sensor_readings
             where hour_bucket = (select max(hour_bucket) from sensor_readings))
select category, count(*) as total, count_if(status = 'active')::bigint as active,
  count_if(status = 'maintenance')::bigint as in_maintenance,
  count_if(status = 'active' and rep.sensor_key is not null)::bigint as reporting,
  count_if(status = 'active' and rep.sensor_key is not null)::bigint * 6 as data_points
from sensors left join rep on sensors.sensor_key = rep.sensor_key group by 1""")
def d39_sensor_inventory(spark, sf_dir):
    return SN.inventory(V.sensors(spark, sf_dir), V.sensor_readings(spark, sf_dir))


_ALERTS_SQL = """
a as (select sensor_id, category, location,
        case when status = 'maintenance' then 'maintenance_required' when uptime_hours > 8000 then 'replacement_recommended'
             when days_since_calibration > 90 then 'calibration_required' when error_rate > 0.05 then 'accuracy_degraded'
        end as alert_type,
        case when status = 'maintenance' then 'high' when uptime_hours > 8000 then 'medium'
             when days_since_calibration > 90 then 'medium' when error_rate > 0.05 then 'high' end as priority
      from sensors)"""


@query("d40_maintenance_alerts", views=("sensors",), sql=f"""
with {_ALERTS_SQL}
select * from a where alert_type is not null""")
def d40_maintenance_alerts(spark, sf_dir):
    return SN.maintenance_alerts(V.sensors(spark, sf_dir))


@query("d40_alert_priority_counts", views=("sensors",), sql=f"""
with {_ALERTS_SQL}
select priority, count(*) as n_alerts from a where alert_type is not null group by 1""")
def d40_alert_priority_counts(spark, sf_dir):
    return SN.alert_priority_counts(SN.maintenance_alerts(V.sensors(spark, sf_dir)))


@query("c2_uncovered_zones", views=("sensors",), sql="""
select z.location, 'multi_modal' as sensor_type, 'high' as priority
from (select concat('Zone_', cast(n_nationkey as varchar)) as location from nation) z
where not exists (select 1 from sensors s where s.location = z.location)""")
def c2_uncovered_zones(spark, sf_dir):
    zones = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Zone_"), F.col("n_nationkey").cast("string")).alias("location"))
    return SN.uncovered_zones(zones, V.sensors(spark, sf_dir))


@query("c3_reporting_status", views=_VIEWS, sql="""
select s.sensor_id, s.category, s.location,
  case when r.sensor_key is not null then 'data_ok' else 'no_data' end as data_status
from sensors s left join (select distinct sensor_key from sensor_readings
                          where hour_bucket = (select max(hour_bucket) from sensor_readings)) r
  on s.sensor_key = r.sensor_key""")
def c3_reporting_status(spark, sf_dir):
    st = SN.reporting_status(V.sensors(spark, sf_dir), V.sensor_readings(spark, sf_dir))
    return st.select("sensor_id", "category", "location", "data_status")


@query("d49_sensor_coverage", views=_VIEWS, sql="""
with rep as (select distinct sensor_key, hour_bucket from sensor_readings)
select s.location, s.category, count(distinct rep.hour_bucket) as reporting_windows,
  R6(count(distinct rep.hour_bucket) / (select max(hour_bucket) - min(hour_bucket) + 1 from sensor_readings))
    as quality
from sensors s left join rep on s.sensor_key = rep.sensor_key group by 1, 2""")
def d49_sensor_coverage(spark, sf_dir):
    return SN.coverage(V.sensors(spark, sf_dir), V.sensor_readings(spark, sf_dir))


@query("a7_collected_payloads", views=_VIEWS, sql=f"""
with {_TAGGED}
select event_id, sensor_id, category,
  R6(case when category = 'speed' then average_speed end) as average_speed,
  (case when category = 'speed' then vehicle_count end)::varchar as vehicle_count,
  R6(case when category = 'weather' then precipitation end) as precipitation,
  R6(case when category = 'weather' then visibility end) as visibility,
  (case when category = 'weather' then wind_speed end)::varchar as wind_speed,
  case when category = 'weather' then road_condition end as road_condition,
  (case when category = 'air_quality' then air_quality_index end)::varchar as air_quality_index,
  R6(case when category = 'noise' then decibel_level end) as decibel_level
from t""")
def a7_collected_payloads(spark, sf_dir):
    tagged = SN.with_category(V.sensor_readings(spark, sf_dir), V.sensors(spark, sf_dir))
    msg = SN.collected_json(tagged).select("event_id", "category", "payload_json")
    p = SN.parse_collected(msg)
    # Nullable integer fields are compared as text (see b7).
    return p.select("event_id", F.col("sensor_id_parsed").alias("sensor_id"), "category", "average_speed",
                    F.col("vehicle_count").cast("string").alias("vehicle_count"), "precipitation", "visibility",
                    F.col("wind_speed").cast("string").alias("wind_speed"), "road_condition",
                    F.col("air_quality_index").cast("string").alias("air_quality_index"), "decibel_level")


@query("a8_payload_size", views=_VIEWS)
def a8_payload_size(spark, sf_dir):
    """JSON text and byte size of each collected message (no oracle: JSON
    number formatting is engine specific)."""
    tagged = SN.with_category(V.sensor_readings(spark, sf_dir), V.sensors(spark, sf_dir))
    return SN.collected_json(tagged).select("event_id", "sensor_id", "payload_json", "payload_bytes")


@query("c4_edge_node_choice", views=_VIEWS)
def c4_edge_node_choice(spark, sf_dir):
    """Best edge node per message by capacity and latency score (no oracle:
    the size input is Spark's JSON text)."""
    tagged = SN.with_category(V.sensor_readings(spark, sf_dir), V.sensors(spark, sf_dir))
    return SN.choose_edge_node(SN.collected_json(tagged)).select("event_id", "payload_bytes", "node_id", "node_score")
