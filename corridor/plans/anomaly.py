"""Registered queries: baselines, anomaly scoring and incident detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..sources import fixtures as V
from ._registry import query

_BASELINE_SQL = """
b as (select hour(ts) as hour, avg(average_speed_kmph) as speed_mean,
        stddev_samp(average_speed_kmph) as speed_std, avg(vehicle_count) as volume_mean,
        stddev_samp(vehicle_count) as volume_std, count(*) as n_readings
      from readings group by 1)"""


@query("d22_hourly_baseline", sql=f"""
with {_BASELINE_SQL}
select hour, R6(speed_mean) as speed_mean, R6(speed_std) as speed_std,
  R6(volume_mean) as volume_mean, R6(volume_std) as volume_std, n_readings from b""")
def d22_hourly_baseline(spark, sf_dir):
    return A.hourly_baseline(V.readings(spark, sf_dir))


@query("d23_dow_hour_baseline", sql="""
select isodow(ts) - 1 as day_of_week, hour(ts) as hour,
  R6(avg(average_speed_kmph)) as speed_mean, R6(stddev_samp(average_speed_kmph)) as speed_std,
  R6(avg(vehicle_count)) as volume_mean, R6(stddev_samp(vehicle_count)) as volume_std,
  count(*) as n_readings
from readings group by 1, 2""")
def d23_dow_hour_baseline(spark, sf_dir):
    return A.daily_hour_baseline(V.readings(spark, sf_dir))


def _scores_sql(z: float) -> str:
    return f"""
with {_BASELINE_SQL},
s as (select r.reading_id, r.location, hour(r.ts) as hour, r.average_speed_kmph, r.vehicle_count,
        b.speed_mean, b.volume_mean,
        abs(r.average_speed_kmph - b.speed_mean) / (b.speed_std + 1e-8) as speed_z,
        abs(r.vehicle_count - b.volume_mean) / (b.volume_std + 1e-8) as volume_z
      from readings r left join b on hour(r.ts) = b.hour),
t as (select *, coalesce(speed_z > {z}, false) as sh, coalesce(volume_z > {z}, false) as vh,
        greatest(speed_z, volume_z) as max_z from s)
select reading_id, location, hour, R6(speed_z) as speed_z, R6(volume_z) as volume_z, R6(max_z) as max_z,
  concat_ws(',', case when sh then 'speed_anomaly' end, case when vh then 'volume_anomaly' end) as anomaly_types,
  sh or vh as anomaly_detected,
  case when max_z > 4 then 'high' when max_z > 3 then 'medium' else 'low' end as severity,
  R6(least(0.95, max_z / 5)) as confidence,
  concat_ws(',',
    case when sh and average_speed_kmph < speed_mean then 'speed_drop_check_incident'
         when sh then 'speed_high_check_compliance' end,
    case when vh and vehicle_count > volume_mean then 'volume_high_prepare'
         when vh then 'volume_low_investigate' end) as recommendations
from t"""


def _scores(spark, sf_dir, z):
    r = V.readings(spark, sf_dir)
    s = A.score_anomalies(r, A.hourly_baseline(r), z_threshold=z)
    return s.select("reading_id", "location", "hour", "speed_z", "volume_z", "max_z",
                    F.array_join("anomaly_types", ",").alias("anomaly_types"),
                    "anomaly_detected", "severity", "confidence",
                    F.array_join("recommendations", ",").alias("recommendations"))


@query("c1_anomaly_scores", sql=_scores_sql(2.5))
def c1_anomaly_scores(spark, sf_dir):
    return _scores(spark, sf_dir, 2.5)


@query("c1_anomaly_scores_z15", sql=_scores_sql(1.5))
def c1_anomaly_scores_z15(spark, sf_dir):
    """C1 with the lowest dashboard threshold (1.5), where the volume branch fires."""
    return _scores(spark, sf_dir, 1.5)


@query("d46_anomaly_counts", sql=f"""
with {_BASELINE_SQL},
s as (select hour(r.ts) as hour,
        abs(r.average_speed_kmph - b.speed_mean) / (b.speed_std + 1e-8) as speed_z,
        abs(r.vehicle_count - b.volume_mean) / (b.volume_std + 1e-8) as volume_z
      from readings r left join b on hour(r.ts) = b.hour),
t as (select hour, coalesce(speed_z > 2.5, false) as sh, coalesce(volume_z > 2.5, false) as vh,
        greatest(speed_z, volume_z) as max_z from s)
select hour, case when max_z > 4 then 'high' when max_z > 3 then 'medium' else 'low' end as severity,
  count(*) as n_readings, count_if(sh or vh)::bigint as n_anomalies, count_if(sh)::bigint as n_speed,
  count_if(vh)::bigint as n_volume
from t group by 1, 2""")
def d46_anomaly_counts(spark, sf_dir):
    r = V.readings(spark, sf_dir)
    return A.anomaly_counts(A.score_anomalies(r, A.hourly_baseline(r)))


@query("c1_anomaly_scores_with_forest")
def c1_anomaly_scores_with_forest(spark, sf_dir):
    """z tests plus the isolation-forest verdict (property-checked: the ML
    branch flags about 10 % of the readings)."""
    r = V.readings(spark, sf_dir)
    s = A.score_with_forest(r, A.hourly_baseline(r))
    return s.select("reading_id", "severity", "anomaly_detected", "if_score",
                    F.array_join("anomaly_types", ",").alias("anomaly_types"),
                    F.array_join("recommendations", ",").alias("recommendations"))


@query("d46_anomaly_counts_large", views=("readings_large",), sql="""
with b as (select hour(ts) as hour, avg(average_speed_kmph) as speed_mean, stddev_samp(average_speed_kmph) as speed_std,
             avg(vehicle_count) as volume_mean, stddev_samp(vehicle_count) as volume_std
           from readings_large group by 1),
s as (select hour(r.ts) as hour,
        abs(r.average_speed_kmph - b.speed_mean) / (b.speed_std + 1e-8) as speed_z,
        abs(r.vehicle_count - b.volume_mean) / (b.volume_std + 1e-8) as volume_z
      from readings_large r left join b on hour(r.ts) = b.hour),
t as (select hour, coalesce(speed_z > 2.5, false) as sh, coalesce(volume_z > 2.5, false) as vh,
        greatest(speed_z, volume_z) as max_z from s)
select hour, case when max_z > 4 then 'high' when max_z > 3 then 'medium' else 'low' end as severity,
  count(*) as n_readings, count_if(sh or vh)::bigint as n_anomalies, count_if(sh)::bigint as n_speed,
  count_if(vh)::bigint as n_volume
from t group by 1, 2""")
def d46_anomaly_counts_large(spark, sf_dir):
    r = V.readings_large(spark, sf_dir)
    return A.anomaly_counts(A.score_anomalies(r, A.hourly_baseline(r)))
