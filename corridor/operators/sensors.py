"""Sensor registry, payloads and fusion.

Fusion is one hash aggregation per time window over all categories at once:
category-specific metrics are conditional aggregates (``avg(when(...))``,
``product(when(..., factor).otherwise(1))``), so no per-category tables are
joined back together and nothing is collected per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Impact factors, health bands, maintenance rules, edge nodes.
PRECIP_FACTORS = ((10, 0.7), (5, 0.85))          # precipitation > mm -> factor
VISIBILITY_FACTORS = ((100, 0.5), (500, 0.75))   # visibility < m -> factor
WIND_LIMIT, WIND_FACTOR = 20, 0.8
ROAD_FACTORS = {"icy": 0.6, "snow": 0.6, "wet": 0.8}
AQI_FACTORS = ((150, 0.6), (100, 0.75), (50, 0.9))
NOISE_FACTORS = ((80, 0.5), (70, 0.7), (60, 0.85))
HEALTH_DEFAULT = 0.5
UPTIME_LIMIT_HOURS = 8000
CALIBRATION_LIMIT_DAYS = 90
ERROR_RATE_LIMIT = 0.05
DATA_POINTS_PER_SENSOR = 6
# Edge nodes (node_id, capacity, latency ms); the cloud node is never chosen.
EDGE_NODES = (("edge_node_1", 100, 5), ("edge_node_2", 150, 3), ("edge_node_3", 200, 4))

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("average_speed", T.DoubleType()), T.StructField("vehicle_count", T.IntegerType()),
    T.StructField("precipitation", T.DoubleType()), T.StructField("visibility", T.DoubleType()),
    T.StructField("wind_speed", T.IntegerType()), T.StructField("road_condition", T.StringType()),
    T.StructField("air_quality_index", T.IntegerType()), T.StructField("decibel_level", T.DoubleType()),
])
CATEGORY_FIELDS = {
    "speed": ("average_speed", "vehicle_count"),
    "weather": ("precipitation", "visibility", "wind_speed", "road_condition"),
    "air_quality": ("air_quality_index",),
    "noise": ("decibel_level",),
}


def with_category(readings: DataFrame, sensors: DataFrame, active_only: bool = True) -> DataFrame:
    """Attach sensor id, category and location to each payload (dimension
    lookup; AQE broadcasts the registry when its runtime size allows)."""
    s = sensors.select("sensor_key", "sensor_id", "category", F.col("location").alias("sensor_location"), "status")
    if active_only:
        s = s.where(F.col("status") == "active")
    return readings.join(s, "sensor_key")


def _step_factor(x: Column, steps, greater: bool = True) -> Column:
    e = None
    for limit, f in steps:
        c = (x > limit) if greater else (x < limit)
        e = F.when(c, F.lit(f)) if e is None else e.when(c, F.lit(f))
    return e.otherwise(F.lit(1.0))


def weather_factor() -> Column:
    """Product of the precipitation, visibility, wind and road factors of one weather payload."""
    road = F.col("road_condition")
    road_f = F.when(road.isin("icy", "snow"), ROAD_FACTORS["icy"]).when(road == "wet", ROAD_FACTORS["wet"]).otherwise(1.0)
    return (_step_factor(F.col("precipitation"), PRECIP_FACTORS)
            * _step_factor(F.col("visibility"), VISIBILITY_FACTORS, greater=False)
            * F.when(F.col("wind_speed") > WIND_LIMIT, WIND_FACTOR).otherwise(1.0)
            * road_f)


def latest_payloads(readings: DataFrame, sensors: DataFrame, window_col: str = "hour_bucket", active_only: bool = True,
                    order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One row per (window, sensor): its last payload, so that a sensor counts
    once however often it reports."""
    payload = [c for c in readings.columns if c not in ("sensor_key", window_col, *order)]
    last = F.max_by(F.struct(*payload), F.struct(*order)).alias("p")
    r = readings.groupBy(window_col, "sensor_key").agg(last).select(window_col, "sensor_key", "p.*")
    return with_category(r, sensors, active_only)


def fuse(readings: DataFrame, sensors: DataFrame, window_col: str = "hour_bucket",
         active_only: bool = True) -> DataFrame:
    """D36-D38 per time window, over each sensor's latest payload in it: fused
    speed/volume, environmental impact scores (products of penalty factors,
    clamped to [0, 1]) and the traffic health score (mean of the available
    factors)."""
    return fuse_latest(latest_payloads(readings, sensors, window_col, active_only), window_col)


def fuse_latest(r: DataFrame, window_col) -> DataFrame:
    """The fusion of ``latest_payloads``; ``window_col`` is a column or its name."""
    cat = F.col("category")
    is_speed = cat == "speed"
    one = F.lit(1.0)
    g = r.groupBy(window_col).agg(
        F.avg(F.when(is_speed, F.col("average_speed"))).alias("average_speed"),
        F.stddev_pop(F.when(is_speed, F.col("average_speed"))).alias("_speed_std"),
        F.sum(F.when(is_speed, F.col("vehicle_count"))).alias("total_volume"),
        F.avg(F.when(is_speed, F.col("vehicle_count"))).alias("average_volume"),
        F.product(F.when(cat == "weather", weather_factor()).otherwise(one)).alias("_w"),
        F.product(F.when(cat == "air_quality", _step_factor(F.col("air_quality_index"), AQI_FACTORS))
                  .otherwise(one)).alias("_a"),
        F.product(F.when(cat == "noise", _step_factor(F.col("decibel_level"), NOISE_FACTORS))
                  .otherwise(one)).alias("_n"),
        F.count_if(is_speed).alias("n_speed_readings"))
    clamp01 = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    g = g.withColumns({
        "speed_confidence": 1 - F.try_divide(F.col("_speed_std"), F.col("average_speed")),
        "weather_impact_score": clamp01(F.col("_w")),
        "air_quality_impact_score": clamp01(F.col("_a")),
        "noise_impact_score": clamp01(F.col("_n")),
    }).withColumn("overall_environmental_score",
                  (F.col("weather_impact_score") + F.col("air_quality_impact_score") + F.col("noise_impact_score")) / 3)
    sp, vol = F.col("average_speed"), F.col("average_volume")
    speed_f = (F.when(sp.between(40, 70), 1.0).when(sp < 20, 0.3).when(sp < 40, 0.6).when(sp.isNotNull(), 0.8))
    vol_f = F.when(vol < 30, 0.8).when(vol <= 80, 1.0).when(vol <= 120, 0.7).when(vol.isNotNull(), 0.4)
    factors = F.array_compact(F.array(speed_f, F.col("overall_environmental_score"), vol_f))
    health = F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors)
    return g.withColumn("traffic_health_score", F.when(F.size(factors) > 0, health).otherwise(HEALTH_DEFAULT)) \
            .drop("_speed_std", "_w", "_a", "_n")


def inventory(sensors: DataFrame, readings: DataFrame | None = None, window_col: str = "hour_bucket") -> DataFrame:
    """Sensors per category, active count, reporting count (active
    sensors with a payload in the latest window; all active sensors when no
    readings are given) and data points per minute = reporting x 6."""
    s = sensors
    if readings is not None:
        latest = readings.select(F.max(window_col)).scalar()
        rep = (readings.where(F.col(window_col) == latest).select("sensor_key").distinct()
               .withColumn("_rep", F.lit(True)))
        s = s.join(rep, "sensor_key", "left")
        reporting = F.count_if((F.col("status") == "active") & F.coalesce(F.col("_rep"), F.lit(False)))
    else:
        reporting = F.count_if(F.col("status") == "active")
    return (s.groupBy("category")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("status") == "active").alias("active"),
                 F.count_if(F.col("status") == "maintenance").alias("in_maintenance"),
                 reporting.alias("reporting"))
            .withColumn("data_points", F.col("reporting") * DATA_POINTS_PER_SENSOR))


def maintenance_alerts(sensors: DataFrame) -> DataFrame:
    """First matching rule per sensor (maintenance -> uptime ->
    calibration -> error rate); sensors without an alert are dropped."""
    alert = (F.when(F.col("status") == "maintenance", F.struct(F.lit("maintenance_required").alias("alert_type"),
                                                                 F.lit("high").alias("priority")))
              .when(F.col("uptime_hours") > UPTIME_LIMIT_HOURS,
                    F.struct(F.lit("replacement_recommended").alias("alert_type"), F.lit("medium").alias("priority")))
              .when(F.col("days_since_calibration") > CALIBRATION_LIMIT_DAYS,
                    F.struct(F.lit("calibration_required").alias("alert_type"), F.lit("medium").alias("priority")))
              .when(F.col("error_rate") > ERROR_RATE_LIMIT,
                    F.struct(F.lit("accuracy_degraded").alias("alert_type"), F.lit("high").alias("priority"))))
    return (sensors.select("sensor_id", "category", "location", alert.alias("a"))
            .where(F.col("a").isNotNull()).select("sensor_id", "category", "location", "a.*"))


def alert_priority_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority").agg(F.count(F.lit(1)).alias("n_alerts"))


def uncovered_zones(candidates: DataFrame, sensors: DataFrame) -> DataFrame:
    """Candidate locations without any sensor (left anti join)."""
    return (candidates.join(sensors.select("location").distinct(), "location", "left_anti")
            .withColumns({"sensor_type": F.lit("multi_modal"), "priority": F.lit("high")}))


def reporting_status(sensors: DataFrame, readings: DataFrame, window_col: str = "hour_bucket",
                     window_value: Column | None = None) -> DataFrame:
    """Registry left-joined with the sensors that reported in the chosen
    window (default: the latest window in the data)."""
    w = window_value if window_value is not None else readings.select(F.max(window_col)).scalar()
    rep = readings.where(F.col(window_col) == w).select("sensor_key").distinct().withColumn("_rep", F.lit(True))
    return (sensors.join(rep, "sensor_key", "left")
            .withColumn("data_status", F.when(F.col("_rep"), "data_ok").otherwise("no_data")).drop("_rep"))


def coverage(sensors: DataFrame, readings: DataFrame, window_col: str = "hour_bucket") -> DataFrame:
    """Share of the period's windows in which each (location, category)
    received data from any of its sensors.

    Readings are mapped to (location, category) through the registry (a
    dimension join, broadcast by AQE when small), de-duplicated per window
    and counted; the registry's own (location, category) list is then
    left-joined so combinations without data keep a zero."""
    span = readings.agg((F.max(window_col) - F.min(window_col) + 1).alias("n")).select("n").scalar()
    dim = sensors.select("sensor_key", "location", "category")
    seen = (readings.select("sensor_key", window_col).join(dim, "sensor_key")
            .select("location", "category", window_col).distinct()
            .groupBy("location", "category").agg(F.count(F.lit(1)).alias("reporting_windows")))
    cells = sensors.select("location", "category").distinct()
    return (cells.join(seen, ["location", "category"], "left")
            .withColumn("reporting_windows", F.coalesce("reporting_windows", F.lit(0)))
            .withColumn("quality", F.col("reporting_windows") / span))


def payload_struct(category: Column | None = None) -> Column:
    """The category's payload fields as a struct (others null)."""
    cat = F.col("category") if category is None else category
    fields = []
    for f in PAYLOAD_SCHEMA.fields:
        owner = next(c for c, fs in CATEGORY_FIELDS.items() if f.name in fs)
        fields.append(F.when(cat == owner, F.col(f.name).cast(f.dataType)).alias(f.name))
    return F.struct(*fields)


def collected_json(tagged: DataFrame) -> DataFrame:
    """A collected message ``{sensor_id: payload}`` as JSON text and its size."""
    js = F.to_json(F.create_map(F.col("sensor_id"), payload_struct()))
    return tagged.withColumns({"payload_json": js, "payload_bytes": F.octet_length(js)})


def parse_collected(df: DataFrame, json_col: str = "payload_json") -> DataFrame:
    """Parse ``MAP<sensor_id, payload>`` JSON into one row per sensor;
    malformed text gives no rows (``from_json`` -> null)."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), PAYLOAD_SCHEMA))
    return df.select("*", F.explode(m).alias("sensor_id_parsed", "p")).select("*", "p.*").drop("p")


def choose_edge_node(df: DataFrame, size_col: str = "payload_bytes") -> DataFrame:
    """C4: score each edge node ``min(1, capacity / size) * .6 + 1 / (latency + 1) * .4``
    and keep the best (ties: first node).  The node table is a fixed
    three-row constant, so it is evaluated as expressions, not joined."""
    size = F.col(size_col)  # a message of no bytes fits any node
    scores = [F.struct((F.least(F.lit(1.0), F.try_divide(F.lit(float(cap)), size)) * 0.6 + F.lit(1.0 / (lat + 1)) * 0.4)
                       .alias("score"), F.lit(-i).alias("order"), F.lit(nid).alias("node_id"))
              for i, (nid, cap, lat) in enumerate(EDGE_NODES)]
    best = F.array_max(F.array(*scores))
    return df.withColumns({"node_id": best["node_id"], "node_score": best["score"]})
