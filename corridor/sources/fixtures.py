"""The reference's record shapes, derived from the driver tables.

Each view exists twice: as a lazy Spark DataFrame builder and as DuckDB SQL
text (used only by the correctness oracle).  The expressions are fixed by
FIXTURES.md so both engines give identical rows.  All builders are pure
projections of one scan (plus, for ``sensor_readings``, two scalar
subqueries over ``supplier``), so they add no shuffle and let the operators'
filters and column pruning reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def epoch_seconds(ts: str | Column) -> Column:
    """Whole Unix seconds of a TIMESTAMP_NTZ column read as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("long")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


# --------------------------------------------------------------------------
# readings: the core traffic table (one row per event)
# --------------------------------------------------------------------------

def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("reading_id"),
        F.col("ts"),
        epoch_seconds("ts").alias("timestamp"),
        F.concat(F.lit("Location_"),
                 F.expr("substr('ABCDEF', cast(user_id % 6 as int) + 1, 1)")).alias("location"),
        F.expr("case event_type when 'click' then 'Sunny' when 'view' then 'Cloudy' "
               "when 'signup' then 'Rainy' when 'purchase' then 'Snowy' else 'Foggy' end").alias("weather"),
        (_k() * 2).alias("vehicle_count"),
        F.col("value").alias("average_speed_kmph"),
    )


READINGS_SQL = """
select event_id as reading_id, ts, cast(floor(epoch(ts)) as bigint) as timestamp,
  concat('Location_', substr('ABCDEF', cast(user_id % 6 as int) + 1, 1)) as location,
  case event_type when 'click' then 'Sunny' when 'view' then 'Cloudy'
    when 'signup' then 'Rainy' when 'purchase' then 'Snowy' else 'Foggy' end as weather,
  cast(json_extract_string(props, '$.k') as int) * 2 as vehicle_count,
  value as average_speed_kmph
from events"""


# --------------------------------------------------------------------------
# readings_large: the same shape from lineitem (no unique key: aggregates only)
# --------------------------------------------------------------------------

def readings_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    ts_sec = (F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
              + (F.col("l_orderkey") * 97 + F.col("l_linenumber") * 3607) % 86400)
    return li.select(
        ts_sec.alias("timestamp"),
        F.timestamp_seconds(ts_sec).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("Location_"), (F.col("l_suppkey") % 40).cast("string")).alias("location"),
        F.expr("case l_partkey % 5 when 0 then 'Sunny' when 1 then 'Cloudy' when 2 then 'Rainy' "
               "when 3 then 'Snowy' else 'Foggy' end").alias("weather"),
        (F.col("l_quantity") * 4).cast("int").alias("vehicle_count"),
        (F.col("l_extendedprice") / 1000).alias("average_speed_kmph"),
    )


READINGS_LARGE_SQL = """
select x.timestamp, make_timestamp(x.timestamp * 1000000) as ts, x.location, x.weather,
  x.vehicle_count, x.average_speed_kmph
from (select cast(epoch(l_shipdate) as bigint) + (l_orderkey * 97 + l_linenumber * 3607) % 86400 as timestamp,
        concat('Location_', cast(l_suppkey % 40 as varchar)) as location,
        case l_partkey % 5 when 0 then 'Sunny' when 1 then 'Cloudy' when 2 then 'Rainy'
          when 3 then 'Snowy' else 'Foggy' end as weather,
        cast(trunc(l_quantity * 4) as int) as vehicle_count,
        l_extendedprice / 1000 as average_speed_kmph
      from lineitem) x"""


# --------------------------------------------------------------------------
# detections: one row per detected object (camera, frame = hour, det_id)
# --------------------------------------------------------------------------

FRAME_BASE_HOUR = 473352  # hour number of 2024-01-01 00:00 UTC; frames count from it


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = _k()
    frame = F.expr("cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) div 3600") \
        - FRAME_BASE_HOUR
    b = ev.select("event_id", "user_id", "event_type", k.alias("k"), frame.alias("frame_id"))
    ux = (F.col("user_id") * 8 + F.col("frame_id") * 3) % 1180
    uy = (F.col("user_id") * 5) % 640
    return b.select(
        F.col("event_id").alias("det_id"),
        # 64 users a camera: more users make more cameras, not fuller frames
        F.expr("user_id div 64").alias("camera_id"),
        "frame_id",
        F.expr("case event_type when 'click' then 2 when 'view' then 7 when 'signup' then 5 "
               "when 'purchase' then 3 else case when k % 2 = 0 then 1 else 0 end end").alias("class_id"),
        ((F.col("k") + 1) / F.lit(100.0).cast("double")).alias("confidence"),
        ux.cast("int").alias("x1"),
        uy.cast("int").alias("y1"),
        (ux + 40 + F.col("k") % 80).cast("int").alias("x2"),
        (uy + 30 + F.col("k") % 50).cast("int").alias("y2"),
        F.col("user_id").alias("track_id"),
    )


DETECTIONS_SQL = """
select event_id as det_id, user_id // 64 as camera_id, frame_id,
  case event_type when 'click' then 2 when 'view' then 7 when 'signup' then 5
    when 'purchase' then 3 else case when k % 2 = 0 then 1 else 0 end end as class_id,
  (k + 1)::double / 100 as confidence,
  cast((user_id * 8 + frame_id * 3) % 1180 as int) as x1,
  cast((user_id * 5) % 640 as int) as y1,
  cast((user_id * 8 + frame_id * 3) % 1180 + 40 + k % 80 as int) as x2,
  cast((user_id * 5) % 640 + 30 + k % 50 as int) as y2,
  user_id as track_id
from (select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as int) as k,
        cast(floor(epoch(ts)) as bigint) // 3600 - 473352 as frame_id
      from events) f"""


# --------------------------------------------------------------------------
# sensors: registry with health attributes (one row per supplier)
# --------------------------------------------------------------------------

def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.expr("case s_suppkey % 4 when 0 then 'sensor_' when 1 then 'weather_' "
                        "when 2 then 'air_' else 'noise_' end"),
                 F.lpad(key.cast("string"), 4, "0")).alias("sensor_id"),
        F.expr("case s_suppkey % 4 when 0 then 'speed' when 1 then 'weather' "
               "when 2 then 'air_quality' else 'noise' end").alias("category"),
        F.concat(F.lit("Zone_"), F.col("s_nationkey").cast("string")).alias("location"),
        F.when(F.col("s_acctbal") < 0, "maintenance").otherwise("active").alias("status"),
        ((key * 83) % 8760 + 100).cast("int").alias("uptime_hours"),
        ((key * 37) % 365 + 1).cast("int").alias("days_since_calibration"),
        (((key * 13) % 100) / F.lit(1000.0).cast("double")).alias("error_rate"),
        key.alias("sensor_key"),
    )


SENSORS_SQL = """
select concat(case s_suppkey % 4 when 0 then 'sensor_' when 1 then 'weather_'
                when 2 then 'air_' else 'noise_' end, lpad(cast(s_suppkey as varchar), 4, '0')) as sensor_id,
  case s_suppkey % 4 when 0 then 'speed' when 1 then 'weather'
    when 2 then 'air_quality' else 'noise' end as category,
  concat('Zone_', cast(s_nationkey as varchar)) as location,
  case when s_acctbal < 0 then 'maintenance' else 'active' end as status,
  cast((s_suppkey * 83) % 8760 as int) + 100 as uptime_hours,
  cast((s_suppkey * 37) % 365 as int) + 1 as days_since_calibration,
  ((s_suppkey * 13) % 100)::double / 1000 as error_rate,
  s_suppkey as sensor_key
from supplier"""


# --------------------------------------------------------------------------
# sensor_readings: one payload per event, spread over the sensors
# --------------------------------------------------------------------------

def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    sup = read_table(spark, sf_dir, "supplier")
    # Two uncorrelated scalar subqueries (one aggregate job each), not a join.
    n_sensors = sup.select(F.count(F.lit(1))).scalar()
    first_key = sup.select(F.min("s_suppkey")).scalar()
    k = _k()
    b = ev.select("event_id", "ts", "value", k.alias("k"),
                  epoch_seconds("ts").alias("ep"))
    return b.select(
        "event_id",
        (F.col("event_id") % n_sensors + first_key).alias("sensor_key"),
        "ts",
        F.expr("ep div 3600").alias("hour_bucket"),
        F.col("value").alias("average_speed"),
        (F.col("k") * 2).alias("vehicle_count"),
        (F.col("k") / F.lit(4.0).cast("double")).alias("precipitation"),
        (F.col("value") * 20).alias("visibility"),
        (F.col("k") % 31).alias("wind_speed"),
        F.expr("case event_id % 4 when 0 then 'dry' when 1 then 'wet' when 2 then 'icy' "
               "else 'snow' end").alias("road_condition"),
        (F.col("k") * 2).alias("air_quality_index"),
        (F.lit(45.0).cast("double") + F.col("k") * F.lit(0.4).cast("double")).alias("decibel_level"),
    )


SENSOR_READINGS_SQL = """
select event_id, sensor_key, ts, ep // 3600 as hour_bucket,
  value as average_speed, k * 2 as vehicle_count, k::double / 4 as precipitation,
  value * 20 as visibility, k % 31 as wind_speed,
  case event_id % 4 when 0 then 'dry' when 1 then 'wet' when 2 then 'icy' else 'snow' end as road_condition,
  k * 2 as air_quality_index, 45::double + k * 0.4::double as decibel_level
from (select e.*, cast(json_extract_string(e.props, '$.k') as int) as k,
        cast(floor(epoch(e.ts)) as bigint) as ep,
        e.event_id % (select count(*) from supplier) + (select min(s_suppkey) from supplier) as sensor_key
      from events e) b"""


BUILDERS = {
    "readings": readings,
    "readings_large": readings_large,
    "detections": detections,
    "sensors": sensors,
    "sensor_readings": sensor_readings,
}

VIEW_SQL = {
    "readings": READINGS_SQL,
    "readings_large": READINGS_LARGE_SQL,
    "detections": DETECTIONS_SQL,
    "sensors": SENSORS_SQL,
    "sensor_readings": SENSOR_READINGS_SQL,
}
