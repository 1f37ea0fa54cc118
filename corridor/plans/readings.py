"""Registered queries over the readings views: enrichments (B1-B9),
data quality (D1-D8), descriptive statistics (D9-D29), ordering (F1-F6,
A2) and set operations (H2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators import features as FE
from ..operators import quality as Q
from ..operators import stats as S
from ..sources import fixtures as V
from ._registry import query

R = V.readings
RL = V.readings_large

_RUSH_SQL = "(hour(ts) between 7 and 9 or hour(ts) between 17 and 19)"
_DOW_SQL = "(isodow(ts) - 1)"


# ----------------------------------------------------------------- B1-B9 --

@query("b1_time_features", sql=f"""
select reading_id, hour(ts) as hour, {_DOW_SQL} as day_of_week, month(ts) as month,
  cast({_DOW_SQL} >= 5 as bigint) as is_weekend, cast({_RUSH_SQL} as bigint) as is_rush_hour
from readings""")
def b1_time_features(spark, sf_dir):
    return FE.time_features(R(spark, sf_dir)).select(
        "reading_id", "hour", "day_of_week", "month", "is_weekend", "is_rush_hour")


@query("b2_calendar_names", sql="""
select reading_id, dayname(ts) as day_name, monthname(ts) as month_name,
  strftime(ts, '%Y-%m-%d') as date
from readings""")
def b2_calendar_names(spark, sf_dir):
    return FE.calendar_names(R(spark, sf_dir)).select(
        "reading_id", "day_name", "month_name", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("b3_rush_period", sql="""
select reading_id, hour(ts) as hour,
  case when hour(ts) between 7 and 9 then 'Morning Rush'
       when hour(ts) between 17 and 19 then 'Evening Rush' else 'Off-Peak' end as rush_period
from readings""")
def b3_rush_period(spark, sf_dir):
    return FE.with_rush_period(R(spark, sf_dir)).select("reading_id", "hour", "rush_period")


@query("b4_label_encoding", sql="""
with l as (select location, dense_rank() over (order by location) - 1 as c
           from (select distinct location from readings where location is not null)),
     w as (select weather, dense_rank() over (order by weather) - 1 as c
           from (select distinct weather from readings where weather is not null))
select r.reading_id, coalesce(l.c, 0) as location_encoded, coalesce(w.c, 0) as weather_encoded
from readings r left join l on r.location = l.location left join w on r.weather = w.weather""")
def b4_label_encoding(spark, sf_dir):
    r = R(spark, sf_dir)
    out = FE.apply_label_encoder(r, FE.label_encoder(r, "location"), "location")
    out = FE.apply_label_encoder(out, FE.label_encoder(r, "weather"), "weather")
    return out.select("reading_id", "location_encoded", "weather_encoded")


@query("b5_weather_code", sql="""
select reading_id, weather, case weather when 'Sunny' then 0 when 'Cloudy' then 1 when 'Rainy' then 2
  when 'Snowy' then 3 when 'Foggy' then 4 else 0 end::bigint as weather_code
from readings""")
def b5_weather_code(spark, sf_dir):
    return R(spark, sf_dir).select("reading_id", "weather", FE.weather_code("weather").alias("weather_code"))


_SCORE_SQL = ("vehicle_count / (select max(vehicle_count) from readings) * 0.6 "
              "+ (100.0 - average_speed_kmph) / 100.0 * 0.4")


@query("b6_congestion_score", sql=f"""
select reading_id, R6({_SCORE_SQL}) as congestion_score from readings""")
def b6_congestion_score(spark, sf_dir):
    return FE.with_congestion(R(spark, sf_dir)).select("reading_id", "congestion_score")


@query("b7_congestion_class", sql=f"""
select reading_id, case when s > 0 and s <= 0.33 then 0 when s > 0.33 and s <= 0.66 then 1
  when s > 0.66 and s <= 1.0 then 2 end::varchar as congestion_class
from (select reading_id, {_SCORE_SQL} as s from readings)""")
def b7_congestion_class(spark, sf_dir):
    # The class is null outside (0, 1]; compared as text so that a nullable
    # integer column does not turn into floats on collection.
    return FE.with_congestion(R(spark, sf_dir)).select(
        "reading_id", F.col("congestion_class").cast("string").alias("congestion_class"))


@query("b8_congestion_level", sql="""
select reading_id, case when average_speed_kmph < 40 then 'High' when average_speed_kmph < 70 then 'Medium'
  else 'Low' end as congestion_level
from readings""")
def b8_congestion_level(spark, sf_dir):
    return FE.with_congestion(R(spark, sf_dir)).select("reading_id", "congestion_level")


@query("b9_speed_band", sql="""
select reading_id,
  case when s > 0 and s <= 40 then 'High' when s > 40 and s <= 70 then 'Medium'
       when s > 70 and s <= 100 then 'Low' end as speed_band,
  coalesce(case when s > 0 and s <= 40 then 0 when s > 40 and s <= 70 then 1
       when s > 70 and s <= 100 then 2 end, 1)::bigint as speed_band_code
from (select reading_id, average_speed_kmph as s from readings)""")
def b9_speed_band(spark, sf_dir):
    return FE.with_congestion(R(spark, sf_dir)).select("reading_id", "speed_band", "speed_band_code")


# ----------------------------------------------------------------- D1-D8 --

def _summary_sql(view):
    return f"""
select count(*) as total_records, R6(avg(average_speed_kmph)) as avg_speed,
  R6(avg(vehicle_count)) as avg_vehicle_count, R6(stddev_samp(average_speed_kmph)) as speed_std,
  R6(stddev_samp(vehicle_count)) as vehicle_count_std, count(distinct location) as unique_locations
from {view}"""


@query("d1_dataset_summary", sql=_summary_sql("readings"))
def d1_dataset_summary(spark, sf_dir):
    return Q.dataset_summary(R(spark, sf_dir))


@query("d1_dataset_summary_large", views=("readings_large",), sql=_summary_sql("readings_large"))
def d1_dataset_summary_large(spark, sf_dir):
    return Q.dataset_summary(RL(spark, sf_dir))


@query("d2_date_range", sql="""
select strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') as start,
  strftime(make_timestamp(max(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') as "end",
  cast(floor((max(timestamp) - min(timestamp)) / 86400) as bigint) as days
from readings""")
def d2_date_range(spark, sf_dir):
    return Q.date_range(R(spark, sf_dir))


def _missing_sql(view):
    parts = []
    for c in Q.READING_COLUMNS:
        parts.append(f"select '{c}' as column_name, count_if({c} is null)::bigint as n_missing, "
                     f"floor(count_if({c} is null) / count(*) * 100 * 100 + 0.5) / 100 as pct_missing from {view}")
    return "\nunion all\n".join(parts)


@query("d3_missing_values", sql=_missing_sql("readings"))
def d3_missing_values(spark, sf_dir):
    return Q.missing_values(R(spark, sf_dir))


_DUP_SQL = """
select coalesce(sum(c - 1), 0)::bigint as duplicate_rows
from (select count(*) as c from {v} group by timestamp, location, weather, vehicle_count, average_speed_kmph)"""


@query("d4_duplicate_rows", sql=_DUP_SQL.format(v="readings"))
def d4_duplicate_rows(spark, sf_dir):
    return Q.duplicate_rows(R(spark, sf_dir))


@query("d4_duplicate_rows_large", views=("readings_large",), sql=_DUP_SQL.format(v="readings_large"))
def d4_duplicate_rows_large(spark, sf_dir):
    return Q.duplicate_rows(RL(spark, sf_dir))


def _ranges_sql(view):
    parts = []
    for c in Q.NUMERIC_COLUMNS:
        x = f"{c}::double"
        parts.append(f"select '{c}' as column_name, R6(min({x})) as min, R6(max({x})) as max, "
                     f"floor(avg({x}) * 1000 + 0.5) / 1000 as mean, "
                     f"floor(stddev_samp({x}) * 1000 + 0.5) / 1000 as std from {view}")
    return "\nunion all\n".join(parts)


@query("d5_value_ranges", sql=_ranges_sql("readings"))
def d5_value_ranges(spark, sf_dir):
    # Mean and std of epoch seconds carry ~12 significant digits; engines
    # differ past the 3rd decimal there, so both sides compare at 3 dp.
    v = Q.value_ranges(R(spark, sf_dir))
    return v.withColumns({"mean": round_half_up("mean", 3), "std": round_half_up("std", 3)})


def _iqr_cte(view):
    parts = []
    for c in Q.NUMERIC_COLUMNS:
        parts.append(f"select '{c}' as column_name, {c}::double as value from {view}")
    longv = "\nunion all\n".join(parts)
    return f"""
lv as ({longv}),
q as (select column_name, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
      from lv group by 1),
b as (select column_name, q1, q3, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound from q),
o as (select b.column_name, b.q1, b.q3, b.lower_bound, b.upper_bound,
        count_if(lv.value < b.lower_bound or lv.value > b.upper_bound)::bigint as outliers
      from lv join b on lv.column_name = b.column_name group by all)"""


@query("d6_iqr_outliers", sql=f"""
with {_iqr_cte('readings')}
select column_name, R6(q1) as q1, R6(q3) as q3, R6(lower_bound) as lower_bound,
  R6(upper_bound) as upper_bound, outliers from o""")
def d6_iqr_outliers(spark, sf_dir):
    return Q.iqr_outliers(R(spark, sf_dir))


_MISS_TOTAL = " + ".join(f"count_if({c} is null)" for c in Q.READING_COLUMNS)


@query("d7_quality_score", sql=f"""
with {_iqr_cte('readings')},
n as (select count(*) as n_rows, ({_MISS_TOTAL})::bigint as missing_values from readings),
d as ({_DUP_SQL.format(v='readings')}),
t as (select n.n_rows, n.missing_values, d.duplicate_rows, (select sum(outliers) from o)::bigint as outliers
      from n, d)
select n_rows, missing_values, duplicate_rows, outliers,
  R6(greatest(0.0, least(100.0, 100 - (missing_values + duplicate_rows + outliers) / n_rows * 100))) as quality_score,
  case when greatest(0.0, least(100.0, 100 - (missing_values + duplicate_rows + outliers) / n_rows * 100)) > 80
       then 'good' else 'needs_attention' end as status
from t""")
def d7_quality_score(spark, sf_dir):
    return Q.quality_score(R(spark, sf_dir))


# ---------------------------------------------------------------- D9-D29 --

@query("d9_value_counts", sql="""
with c as (select 'weather' as column_name, weather as value, count(*) as count from readings
           where weather is not null group by 2
           union all
           select 'location', location, count(*) from readings where location is not null group by 2)
select column_name, value, count,
  row_number() over (partition by column_name order by count desc, value) as rank from c""")
def d9_value_counts(spark, sf_dir):
    return S.value_counts(R(spark, sf_dir))


def _hourly_sql(view):
    return f"""
select hour(ts) as hour, R6(avg(average_speed_kmph)) as avg_speed, R6(avg(vehicle_count)) as avg_vehicle_count,
  count(*) as n_readings
from {view} group by 1"""


@query("d10_hourly_pattern", sql=_hourly_sql("readings"))
def d10_hourly_pattern(spark, sf_dir):
    return S.hourly_pattern(R(spark, sf_dir))


@query("d10_hourly_pattern_large", views=("readings_large",), sql=_hourly_sql("readings_large"))
def d10_hourly_pattern_large(spark, sf_dir):
    return S.hourly_pattern(RL(spark, sf_dir))


@query("d11_hourly_band", sql="""
select hour, R6(m) as mean_speed, R6(s) as std_speed, R6(m - s) as lower, R6(m + s) as upper
from (select hour(ts) as hour, avg(average_speed_kmph) as m, stddev_samp(average_speed_kmph) as s
      from readings group by 1)""")
def d11_hourly_band(spark, sf_dir):
    return S.hourly_band(R(spark, sf_dir))


@query("d12_daily_hour_trend", sql="""
select strftime(ts, '%Y-%m-%d') as date, hour(ts) as hour, R6(avg(average_speed_kmph)) as mean_speed
from readings group by 1, 2""")
def d12_daily_hour_trend(spark, sf_dir):
    return S.daily_hour_trend(R(spark, sf_dir)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("d13_location_mean_speed", sql="""
select location, R6(m) as mean_speed, row_number() over (order by m, location) as rank
from (select location, avg(average_speed_kmph) as m from readings group by 1)""")
def d13_location_mean_speed(spark, sf_dir):
    return S.location_mean_speed(R(spark, sf_dir))


def _group_stats_sql(key, view):
    s, v = "average_speed_kmph", "vehicle_count"
    return f"""
select {key}, R6(avg({s})) as speed_mean, R6(stddev_samp({s})) as speed_std, R6(min({s})) as speed_min,
  R6(max({s})) as speed_max, R6(avg({v})) as vehicle_mean, R6(stddev_samp({v})) as vehicle_std,
  min({v})::bigint as vehicle_min, max({v})::bigint as vehicle_max, count(*) as n_readings
from {view} group by 1"""


@query("d14_weather_stats", sql=_group_stats_sql("weather", "readings"))
def d14_weather_stats(spark, sf_dir):
    return S.weather_stats(R(spark, sf_dir))


@query("d14_weather_stats_large", views=("readings_large",), sql=_group_stats_sql("weather", "readings_large"))
def d14_weather_stats_large(spark, sf_dir):
    return S.weather_stats(RL(spark, sf_dir))


@query("d15_location_stats", sql=_group_stats_sql("location", "readings"))
def d15_location_stats(spark, sf_dir):
    return S.location_stats(R(spark, sf_dir))


@query("d15_location_stats_large", views=("readings_large",), sql=_group_stats_sql("location", "readings_large"))
def d15_location_stats_large(spark, sf_dir):
    return S.location_stats(RL(spark, sf_dir))


@query("d16_location_efficiency", sql="""
with a as (select location, floor(avg(average_speed_kmph) * 10 + 0.5) / 10 as avg_speed,
             floor(avg(vehicle_count) * 10 + 0.5) / 10 as avg_vehicle_count from readings group by 1)
select location, R6(avg_speed) as avg_speed, R6(avg_vehicle_count) as avg_vehicle_count,
  R6(avg_speed / (avg_vehicle_count + 1) * 100) as efficiency,
  row_number() over (order by avg_speed / (avg_vehicle_count + 1) * 100 desc, location) as rank
from a""")
def d16_location_efficiency(spark, sf_dir):
    return S.location_efficiency(R(spark, sf_dir))


@query("d17_location_performance", sql="""
with a as (select location, floor(avg(average_speed_kmph) * 100 + 0.5) / 100 as speed_avg,
             floor(avg(vehicle_count) * 100 + 0.5) / 100 as vehicle_avg from readings group by 1),
p as (select *, (speed_avg / max(speed_avg) over () * 0.6
                 + (1 - vehicle_avg / max(vehicle_avg) over ()) * 0.4) * 100 as ps from a)
select location, R6(speed_avg) as speed_avg, R6(vehicle_avg) as vehicle_avg, R6(ps) as performance_score,
  row_number() over (order by ps desc, location) as rank from p""")
def d17_location_performance(spark, sf_dir):
    return S.location_performance(R(spark, sf_dir))


@query("d18_congestion_level_counts", sql=f"""
with t as (select case when average_speed_kmph > 0 and average_speed_kmph <= 40 then 'High'
                       when average_speed_kmph > 40 and average_speed_kmph <= 70 then 'Medium'
                       when average_speed_kmph > 70 and average_speed_kmph <= 100 then 'Low' end as band,
                  {_SCORE_SQL} as s from readings)
select 'speed_band' as scheme, band as level, count(*) as n_readings from t where band is not null group by 2
union all
select 'score_bin', case when s < 0.33 then 'low' when s < 0.66 then 'medium' when s >= 0.66 then 'high' end,
  count(*) from t where s is not null group by 2""")
def d18_congestion_level_counts(spark, sf_dir):
    return S.congestion_level_counts(R(spark, sf_dir))


@query("d19_rush_period_stats", sql="""
select case when hour(ts) between 7 and 9 then 'Morning Rush'
            when hour(ts) between 17 and 19 then 'Evening Rush' else 'Off-Peak' end as rush_period,
  R6(avg(average_speed_kmph)) as avg_speed, R6(avg(vehicle_count)) as avg_vehicle_count, count(*) as n_readings
from readings group by 1""")
def d19_rush_period_stats(spark, sf_dir):
    return S.rush_period_stats(R(spark, sf_dir))


_HCOLS_SPEED = ",\n  ".join(
    f"R6(coalesce(avg(case when hour(ts) = {h} then average_speed_kmph end), 0.0)) as h{h:02d}" for h in range(24))
_HCOLS_CONG = ",\n  ".join(
    f"R6(coalesce(avg(case when hour(ts) = {h} then 100 - average_speed_kmph end), 0.0)) as h{h:02d}" for h in range(24))


@query("d20_day_hour_matrix", sql=f"""
select isodow(ts) - 1 as day_of_week, dayname(ts) as day_name,
  {_HCOLS_SPEED}
from readings group by 1, 2""")
def d20_day_hour_matrix(spark, sf_dir):
    return S.day_hour_matrix(R(spark, sf_dir))


@query("d21_location_hour_congestion", sql=f"""
select location,
  {_HCOLS_CONG}
from readings group by 1""")
def d21_location_hour_congestion(spark, sf_dir):
    return S.location_hour_congestion(R(spark, sf_dir))


@query("d24_peak_insights", sql="""
with h as (select hour(ts) as hour, avg(vehicle_count) as vc, avg(average_speed_kmph) as sp from readings group by 1),
d as (select isodow(ts) - 1 as dow, dayname(ts) as dn, avg(vehicle_count) as vc from readings group by 1, 2)
select (select hour from h order by vc desc, hour limit 1) as peak_hour,
  (select hour from h order by sp desc, hour limit 1) as fastest_hour,
  (select dn from d order by vc desc, dow limit 1) as busiest_day""")
def d24_peak_insights(spark, sf_dir):
    return S.peak_insights(R(spark, sf_dir))


@query("d25_hour_volume_vs_mean", sql="""
with h as (select hour(ts) as hour, avg(vehicle_count) as m from readings group by 1)
select hour, R6(m) as mean_vehicle_count, R6(avg(m) over ()) as overall_mean,
  row_number() over (order by m desc, hour) as rank from h""")
def d25_hour_volume_vs_mean(spark, sf_dir):
    return S.hour_volume_vs_mean(R(spark, sf_dir))


@query("d26_weather_impact", sql="""
select weather, R6(m) as mean_speed, row_number() over (order by m, weather) as rank
from (select weather, avg(average_speed_kmph) as m from readings group by 1)""")
def d26_weather_impact(spark, sf_dir):
    return S.weather_impact(R(spark, sf_dir))


def _corr_sql(view):
    cols = ["timestamp", "vehicle_count", "average_speed_kmph"]
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"select '{a}' as column_a, '{b}' as column_b, 1.0::double as correlation")
            else:
                parts.append(f"select '{a}' as column_a, '{b}' as column_b, "
                             f"R6(corr({a}::double, {b}::double)) as correlation from {view}")
    return "\nunion all\n".join(parts)


@query("d27_correlation_matrix", sql=_corr_sql("readings"))
def d27_correlation_matrix(spark, sf_dir):
    return S.correlation_matrix(R(spark, sf_dir))


def _hist_sql(view):
    parts = []
    for c in ("average_speed_kmph", "vehicle_count"):
        parts.append(f"""
select '{c}' as column_name, bin, R6(mn + bin * w) as bin_lo, R6(mn + (bin + 1) * w) as bin_hi, count(*) as count
from (select cast(coalesce(least(floor(({c}::double - mn) / w), 29), 0) as bigint) as bin, mn, w
      from {view}, (select min({c}::double) as mn, (max({c}::double) - min({c}::double)) / 30 as w from {view}) mm
      where {c} is not null)
group by bin, mn, w""")
    return "\nunion all\n".join(parts)


@query("d28_histogram", sql=_hist_sql("readings"))
def d28_histogram(spark, sf_dir):
    return S.histogram(R(spark, sf_dir))


@query("d29_box_stats", sql="""
select weather, R6(quantile_cont(average_speed_kmph, 0.0)) as min, R6(quantile_cont(average_speed_kmph, 0.25)) as q1,
  R6(quantile_cont(average_speed_kmph, 0.5)) as median, R6(quantile_cont(average_speed_kmph, 0.75)) as q3,
  R6(quantile_cont(average_speed_kmph, 1.0)) as max
from readings where average_speed_kmph is not null group by 1""")
def d29_box_stats(spark, sf_dir):
    return S.box_stats(R(spark, sf_dir))


# ------------------------------------------------------------ F, A2, H2 --

@query("f1_sorted_by_time", sql="""
select reading_id, timestamp, row_number() over (order by timestamp, reading_id) - 1 as time_rank from readings""")
def f1_sorted_by_time(spark, sf_dir):
    return S.sorted_by_time(R(spark, sf_dir).select("reading_id", "timestamp"))


@query("a2_data_preview", sql="""
select reading_id, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') as datetime,
  location, weather, vehicle_count::bigint as vehicle_count, format('{:,.1f}', average_speed_kmph) as average_speed
from readings order by timestamp, reading_id limit 10""")
def a2_data_preview(spark, sf_dir):
    return S.preview(R(spark, sf_dir))


@query("f4_top_demand_locations", sql="""
select location, R6(avg(vehicle_count)) as mean_demand from readings group by 1
order by avg(vehicle_count) desc, location limit 3""")
def f4_top_demand_locations(spark, sf_dir):
    return S.top_demand_locations(R(spark, sf_dir))


@query("f5_first_locations", sql="""
select location, first_timestamp, first_reading_id from (
  select location, min(timestamp) as first_timestamp,
    arg_min(reading_id, (timestamp, reading_id)) as first_reading_id
  from readings group by 1)
order by first_timestamp, first_reading_id limit 6""")
def f5_first_locations(spark, sf_dir):
    return S.first_locations(R(spark, sf_dir))


@query("f6_hash_sample", sql="""
select reading_id, timestamp, location, weather, vehicle_count::bigint as vehicle_count,
  R6(average_speed_kmph) as average_speed_kmph
from readings order by md5(cast(reading_id as varchar)), reading_id limit 100""")
def f6_hash_sample(spark, sf_dir):
    return S.hash_sample(R(spark, sf_dir), 100).select(
        "reading_id", "timestamp", "location", "weather", "vehicle_count", "average_speed_kmph")


@query("h2_distinct_locations", sql="select distinct location from readings where location is not null")
def h2_distinct_locations(spark, sf_dir):
    return S.distinct_locations(R(spark, sf_dir))


@query("g2_train_test_split", sql="""
select reading_id, cast(concat('0x', substr(md5(cast(reading_id as varchar)), 1, 8)) as bigint) % 100 as bucket,
  cast(concat('0x', substr(md5(cast(reading_id as varchar)), 1, 8)) as bigint) % 100 < 20 as is_test
from readings""")
def g2_train_test_split(spark, sf_dir):
    r = FE.train_test_split(R(spark, sf_dir))
    return r.select("reading_id", FE.hash_bucket("reading_id").alias("bucket"), "is_test")



@query("d15_grouped_statistics", sql="""
select 'hour' as dimension, cast(hour(ts) as varchar) as key, R6(avg(average_speed_kmph)) as avg_speed,
  R6(avg(vehicle_count)) as avg_vehicle_count, R6(stddev_samp(average_speed_kmph)) as speed_std,
  count(*) as n_readings from readings group by hour(ts)
union all
select 'weather', weather, R6(avg(average_speed_kmph)), R6(avg(vehicle_count)), R6(stddev_samp(average_speed_kmph)),
  count(*) from readings group by weather
union all
select 'location', location, R6(avg(average_speed_kmph)), R6(avg(vehicle_count)),
  R6(stddev_samp(average_speed_kmph)), count(*) from readings group by location""")
def d15_grouped_statistics(spark, sf_dir):
    """Hour, weather and location statistics from one GROUPING SETS pass."""
    return S.grouped_statistics(R(spark, sf_dir))


@query("d29_box_stats_large", views=("readings_large",), sql="""
select weather, R6(quantile_cont(average_speed_kmph, 0.0)) as min, R6(quantile_cont(average_speed_kmph, 0.25)) as q1,
  R6(quantile_cont(average_speed_kmph, 0.5)) as median, R6(quantile_cont(average_speed_kmph, 0.75)) as q3,
  R6(quantile_cont(average_speed_kmph, 1.0)) as max
from readings_large where average_speed_kmph is not null group by 1""")
def d29_box_stats_large(spark, sf_dir):
    """Box statistics over the 600k-row table (no row id: ties are broken by
    a generated unique id, so duplicate rows still spread out)."""
    return S.box_stats(RL(spark, sf_dir), id_col=None)
