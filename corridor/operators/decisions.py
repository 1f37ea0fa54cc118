"""Rule tables and decision arithmetic.

Rules are column expressions (``when`` chains, literal maps) or small literal
rule tables expanded with ``explode`` — one row in, a bounded number of rows
out, no join against the fact table.  Rule texts are short stable codes of
our own; categories, priorities and numeric ranges follow the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.congestion import level_from_speed
from ..functions.numeric import clamp, col_of
from ..functions.time import event_time, is_rush_hour

# Fixed values --------------------------------------------------------------
# Signal timing (seconds) per congestion level: green, yellow, red.
LIGHT_TIMING = {"High": (45, 5, 20), "Medium": (35, 5, 25), "Low": (30, 4, 26)}
# Route advice per level: advice code, expected delay range in minutes.
ROUTE_ADVICE = {"High": ("use_alternative_routes", 15, 30),
                "Medium": ("adjust_departure_time", 5, 15),
                "Low": ("routes_clear", 0, 5)}
# Weather factors: signal cycle (B12), emissions (B13), speed estimate.
SIGNAL_WEATHER = {"Sunny": 1.0, "Cloudy": 1.05, "Rainy": 1.2, "Snowy": 1.3, "Foggy": 1.4}
EMISSION_WEATHER = {"Sunny": 1.0, "Cloudy": 1.02, "Rainy": 1.15, "Snowy": 1.25, "Foggy": 1.1}
SPEED_WEATHER = {"Sunny": 1.0, "Cloudy": 0.95, "Rainy": 0.8, "Snowy": 0.7, "Foggy": 0.75}
BAD_WEATHER = ("Rainy", "Snowy", "Foggy")
BASE_CYCLE_SECONDS = 60.0
PHASE_SHARES = (0.55, 0.08, 0.37)
# Fleet split (share of vehicles) and grams CO2 per km: car, truck, bus, motorcycle.
FLEET_SHARES = (0.75, 0.15, 0.05, 0.05)
FLEET_CO2 = (120, 250, 180, 80)
# Base adaptive timing (green, yellow, red) and its clamps.
BASE_TIMING = (30, 5, 25)
# Infrastructure insight rules: (condition code, priority, category, rule code).
INSIGHT_RULES = (
    ("vehicle_count > 150", "High", "Capacity", "add_lanes_or_routes"),
    ("average_speed_kmph < 30", "High", "Traffic Flow", "intelligent_signals"),
    ("weather in ('Rainy', 'Snowy', 'Foggy')", "Medium", "Safety", "weather_monitoring_variable_limits"),
    ("true", "Medium", "Long-term Planning", "adaptive_traffic_zones"),
    ("true", "Medium", "Peak Hour Management", "peak_dynamic_pricing"),
    ("true", "Low", "Technology", "iot_sensor_rollout"),
)
# Weather advice counts per weather (B15); any other weather gets 3.
WEATHER_ADVICE_COUNT = {"Rainy": 4, "Snowy": 4, "Foggy": 4, "Sunny": 3}


def _map_lookup(mapping: dict, key: Column, default) -> Column:
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def light_timing(speed: str | Column) -> Column:
    """struct(green, yellow, red) from the speed level."""
    lvl = level_from_speed(speed)
    def pick(i):
        e = None
        for name, t in LIGHT_TIMING.items():
            e = F.when(lvl == name, F.lit(t[i])) if e is None else e.when(lvl == name, F.lit(t[i]))
        return e
    return F.struct(pick(0).alias("green"), pick(1).alias("yellow"), pick(2).alias("red"))


def route_advice(speed: str | Column) -> Column:
    """struct(advice, delay_min_lo, delay_min_hi)."""
    lvl = level_from_speed(speed)
    def pick(i):
        e = None
        for name, t in ROUTE_ADVICE.items():
            e = F.when(lvl == name, F.lit(t[i])) if e is None else e.when(lvl == name, F.lit(t[i]))
        return e
    return F.struct(pick(0).alias("advice"), pick(1).alias("delay_min_lo"), pick(2).alias("delay_min_hi"))


def signal_optimisation(df: DataFrame, count: str = "vehicle_count", weather: str = "weather",
                        hour: str = "hour") -> DataFrame:
    """cycle = 60 x count factor x weather factor x rush factor; phases
    55/8/37 % of the unrounded cycle, each truncated; efficiency
    ``min(100, 100 / weather / rush)``."""
    vc = F.col(count)
    cm = F.when(vc > 100, 1.3).when(vc > 50, 1.1).otherwise(0.9)
    wm = _map_lookup(SIGNAL_WEATHER, F.col(weather), 1.0)
    tm = F.when(is_rush_hour(hour), 1.2).otherwise(1.0)
    cycle = F.lit(BASE_CYCLE_SECONDS) * cm * wm * tm
    g, y, r = PHASE_SHARES
    return df.withColumns({
        "total_cycle_time": cycle.cast("int"),
        "green_time": (cycle * g).cast("int"),
        "yellow_time": (cycle * y).cast("int"),
        "red_time": (cycle * r).cast("int"),
        "efficiency_score": F.least(F.lit(100.0), F.lit(100.0) / wm / tm),
    })


def environmental_impact(df: DataFrame, count: str = "vehicle_count", speed: str = "average_speed_kmph",
                         weather: str = "weather") -> DataFrame:
    """Truncated fleet split x grams CO2 x speed factor x weather factor."""
    vc, sp = F.col(count), F.col(speed)
    sf = F.when(sp < 20, 1.5).when(sp < 40, 1.3).when(sp < 80, 1.0).otherwise(1.2)
    wf = _map_lookup(EMISSION_WEATHER, F.col(weather), 1.0)
    parts = [(vc * share).cast("int") * grams for share, grams in zip(FLEET_SHARES, FLEET_CO2)]
    base = parts[0] + parts[1] + parts[2] + parts[3]
    total = base * sf * wf
    return df.withColumns({
        "speed_factor": sf, "weather_factor": wf,
        "total_co2_per_hour": total,
        "co2_per_vehicle": F.when(vc > 0, F.try_divide(total, vc)).otherwise(F.lit(0.0)),
        "efficiency_rating": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (sf - 1) * 50)),
        "advice": F.array_compact(F.array(
            F.when(sf > 1.2, F.lit("improve_flow")),
            F.when(wf > 1.1, F.lit("weather_adaptive_management")),
            F.lit("public_transport_carpooling"), F.lit("ev_charging"))),
    })


def infrastructure_insights(df: DataFrame, id_col: str) -> DataFrame:
    """3 to 6 insight rows per input row (explode of conditional rules
    over vehicle_count, average_speed_kmph and weather)."""
    rules = [F.when(F.expr(c), F.struct(F.lit(p).alias("priority"), F.lit(cat).alias("category"),
                                        F.lit(code).alias("rule")))
             for c, p, cat, code in INSIGHT_RULES]
    return (df.select(id_col, F.explode(F.array_compact(F.array(*rules))).alias("i"))
              .select(id_col, "i.*"))


def insight_priority_counts(insights: DataFrame) -> DataFrame:
    """D41."""
    return insights.groupBy("priority").agg(F.count(F.lit(1)).alias("n_insights"))


def _recommendation_rules():
    """B15 rule table: (section, rule code, priority, condition as SQL text).

    Conditions read the situation columns total_vehicles, truck_count,
    density, predicted_speed, weather, hour and day_name.
    """
    rush = "hour in (7, 8, 9, 17, 18, 19)"
    weekend = "day_name in ('Saturday', 'Sunday')"
    rules = [
        ("immediate", "emergency_traffic_control", "High", "density > 0.8"),
        ("immediate", "activate_alternative_routes", "High", "density > 0.8"),
        ("immediate", "optimise_signal_timing", "Medium", "density > 0.6 and density <= 0.8"),
        ("immediate", "monitor_traffic_flow", "Medium", "density > 0.6 and density <= 0.8"),
        ("immediate", "maintain_operations", "Low", "density <= 0.6"),
        ("immediate", "heavy_vehicle_management", "Medium", "truck_count > total_vehicles * 0.3"),
    ]
    for name, n in WEATHER_ADVICE_COUNT.items():
        rules += [("weather", f"{name.lower()}_{i + 1}", "Medium", f"weather = '{name}'") for i in range(n)]
    listed = ", ".join(f"'{w}'" for w in WEATHER_ADVICE_COUNT)
    rules += [("weather", f"standard_{i + 1}", "Low", f"coalesce(weather not in ({listed}), true)")
              for i in range(3)]
    rules += [
        ("time", "rush_hour_management", "High", f"{rush} and not {weekend}"),
        ("time", "peak_period_strategy", "High", f"{rush} and not {weekend}"),
        ("time", "weekend_traffic", "Low", weekend),
        ("time", "off_peak_hours", "Low", f"not {rush} and not {weekend} and (hour >= 22 or hour <= 6)"),
        ("time", "regular_hours", "Low", f"not {rush} and not {weekend} and hour > 6 and hour < 22"),
        ("optimisation", "adaptive_signal_control", "Medium", "true"),
        ("optimisation", "predictive_analytics", "Medium", "true"),
        ("optimisation", "mobile_units", "Medium", "true"),
        ("optimisation", "public_transport_coordination", "Medium", "true"),
        ("optimisation", "emergency_protocols", "High", "predicted_speed < 40"),
        ("optimisation", "temporary_one_way", "High", "predicted_speed < 40"),
        ("optimisation", "extra_enforcement", "High", "predicted_speed < 40"),
    ]
    for i in range(3):
        rules.append(("priority", f"critical_{i + 1}", "High", "density > 0.8"))
        rules.append(("priority", f"elevated_{i + 1}", "Medium", "density > 0.6 and density <= 0.8"))
        rules.append(("priority", f"routine_{i + 1}", "Low", "density <= 0.6"))
    return tuple(rules)


RECOMMENDATION_RULES = _recommendation_rules()


def recommendations(situations: DataFrame, id_col: str = "situation_id") -> DataFrame:
    """One row per (situation, section, rule) with priority — an explode
    of the conditional rule table, so each input row stays in its task."""
    rules = [F.when(F.expr(cond), F.struct(F.lit(sec).alias("section"), F.lit(code).alias("rule"),
                                           F.lit(pri).alias("priority")))
             for sec, code, pri, cond in RECOMMENDATION_RULES]
    return (situations.select(id_col, F.explode(F.array_compact(F.array(*rules))).alias("x"))
                      .select(id_col, "x.*"))


def recommendation_summary(situations: DataFrame) -> DataFrame:
    """B15 summary: situation, urgency, goal and expected-outcome ranges."""
    d = F.col("density")
    return situations.withColumns({
        "situation": F.when(d > 0.7, "critical").when(d > 0.5, "concerning").otherwise("manageable"),
        "urgency": F.when(d > 0.7, "immediate").when(d > 0.5, "prompt").otherwise("routine"),
        "goal": F.when(d > 0.6, "prevent_deterioration").otherwise("maintain_optimal_flow"),
        "weather_effect": F.when(F.col("weather").isin(*BAD_WEATHER), "significant").otherwise("minimal"),
        "congestion_level": level_from_speed("predicted_speed"),
        "flow_improvement_pct": F.when(d > 0.7, "15-25").when(d > 0.5, "10-20").otherwise("5-10"),
        "congestion_reduction_pct": F.when(d > 0.7, "20-40").when(d > 0.5, "15-30").otherwise("10-15"),
        "safety_outcome": F.when(d > 0.7, "significant_risk_reduction").when(d > 0.5, "moderate_improvement")
        .otherwise("high_standards_kept"),
    })


def heuristic_speed(df: DataFrame, count: str = "vehicle_count", weather: str = "weather") -> DataFrame:
    """50 x weather factor x count factor, clamped to [10, 120] (sample
    path) and [15, 100] (scoring path).  No random noise."""
    vc = F.col(count)
    cf = F.when(vc > 100, 0.7).when(vc > 50, 0.85).otherwise(1.0)
    base = F.lit(50.0) * _map_lookup(SPEED_WEATHER, F.col(weather), 1.0) * cf
    return df.withColumns({"speed_estimate_sample": clamp(base, 10.0, 120.0),
                           "speed_estimate_scoring": clamp(base, 15.0, 100.0)})


def integrity_check(df: DataFrame, now: Column, count: str = "vehicle_count", speed: str = "average_speed_kmph",
                    seconds: str = "timestamp") -> DataFrame:
    """Payload rules (count > 1000, speed outside [0, 200], more than an
    hour from ``now``) and ``security_score = max(0, 100 - 25 n)``."""
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.col(count), F.lit(0)) > 1000, F.lit("high_vehicle_count")),
        F.when((F.coalesce(F.col(speed), F.lit(0.0)) < 0) | (F.coalesce(F.col(speed), F.lit(0.0)) > 200),
               F.lit("invalid_speed")),
        F.when(F.abs(now - F.coalesce(F.col(seconds), now)) > 3600, F.lit("suspicious_timestamp"))))
    return df.withColumns({"issues": issues, "issue_count": F.size(issues),
                           "has_issues": F.size(issues) > 0,
                           "security_score": F.greatest(F.lit(0), 100 - F.size(issues) * 25)})


def edge_payload(df: DataFrame) -> DataFrame:
    """The edge payload (weather code, nested time features, density)
    and the edge analysis flags."""
    from .features import weather_code
    t = event_time("timestamp")
    hour = F.hour(t)
    payload = F.struct(
        F.coalesce(F.col("vehicle_count"), F.lit(0)).alias("vehicle_count"),
        weather_code(F.coalesce(F.col("weather"), F.lit("Sunny"))).alias("weather_encoded"),
        F.struct(hour.alias("hour"), is_rush_hour(hour).cast("int").alias("is_rush_hour"),
                 F.weekday(t).alias("day_of_week")).alias("time_features"),
        F.coalesce(F.col("density"), F.lit(0.0)).alias("traffic_density"))
    p = df.withColumn("payload", payload)
    return p.withColumns({
        "congestion_level": F.when(F.col("payload.vehicle_count") > 50, "medium").otherwise("low"),
        "weather_impact": F.when(F.col("payload.weather_encoded").isin(2, 3, 4), "high").otherwise("low"),
    }).withColumns({"congestion_alert": F.col("congestion_level") != "low",
                    "weather_adjustment": F.col("weather_impact") == "high",
                    "payload_json": F.to_json("payload")})


def weather_alerts(readings: DataFrame) -> DataFrame:
    """Mean speed per weather -> High (< 40) / Medium (< 60) / Low."""
    a = readings.groupBy("weather").agg(F.avg("average_speed_kmph").alias("avg_speed"))
    return a.withColumn("alert_level", F.when(F.col("avg_speed") < 40, "High")
                        .when(F.col("avg_speed") < 60, "Medium").otherwise("Low"))


def location_recommendations(performance: DataFrame) -> DataFrame:
    """B21 on D17 output: score < 60 High, < 75 Medium, else Low priority."""
    s = F.col("performance_score")
    return performance.withColumn("priority", F.when(s < 60, "High").when(s < 75, "Medium").otherwise("Low"))


def gauges(df: DataFrame, density: Column, speed: str = "average_speed_kmph") -> DataFrame:
    """Density x 100 and congestion = clamp(100 - speed, 0, 100)."""
    return df.withColumns({"density_gauge": density * 100,
                           "congestion_gauge": clamp(100 - F.col(speed), 0.0, 100.0)})


def expected_load(df: DataFrame, count: str = "vehicle_count", weather: str = "weather") -> DataFrame:
    """Expected latency, efficiency and processing load."""
    vc = F.col(count)
    return df.withColumns({
        "expected_latency_ms": 10 + vc / 10 + F.when(F.col(weather).isin("Rainy", "Snowy"), 5).otherwise(0),
        "expected_efficiency": F.greatest(F.lit(60.0), 95 - vc / 5),
        "processing_load": F.least(F.lit(100.0), vc * 0.8)})


def situation_flags(df: DataFrame, total: str, density: str, weather: str = "weather") -> DataFrame:
    """High volume, critical density, weather advisory, weather impact."""
    bad = F.col(weather).isin(*BAD_WEATHER)
    return df.withColumns({"high_volume": F.col(total) > 50, "critical_density": F.col(density) > 0.7,
                           "weather_advisory": bad,
                           "weather_impact": F.when(bad, "High").otherwise("Low")})


def score_band(score: str | Column, high: float, mid: float, labels=("excellent", "good", "poor")) -> Column:
    """Three-way banding (health > .8 / .6, performance > 80 / 60)."""
    s = col_of(score)
    return F.when(s > high, labels[0]).when(s > mid, labels[1]).otherwise(labels[2])


def adaptive_timing(readings: DataFrame, key: str = "location") -> DataFrame:
    """Per intersection, mean count and speed -> clamped multipliers ->
    green = int(30 c s), yellow 5, red = max(15, int(25 (2 - c)))."""
    a = readings.groupBy(key).agg(F.avg(F.coalesce(F.col("vehicle_count"), F.lit(0))).alias("avg_vehicle_count"),
                                  F.avg(F.coalesce(F.col("average_speed_kmph"), F.lit(50.0))).alias("avg_speed"))
    c = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("avg_vehicle_count") / 50))
    s = F.when(F.col("avg_speed") > 0,
               F.least(F.lit(1.5), F.greatest(F.lit(0.7), F.try_divide(F.lit(50.0), F.col("avg_speed"))))
               ).otherwise(F.lit(1.0))
    g, y, r = BASE_TIMING
    out = a.withColumns({"count_multiplier": c, "speed_multiplier": s}).withColumns({
        "green": (F.lit(float(g)) * F.col("count_multiplier") * F.col("speed_multiplier")).cast("int"),
        "yellow": F.lit(y),
        "red": F.greatest(F.lit(15), (F.lit(float(r)) * (2 - F.col("count_multiplier"))).cast("int"))})
    # without readings: one row with the base timing
    kind = readings.schema[key].dataType.simpleString()
    base = readings.sparkSession.createDataFrame(
        [(None, None, None, None, None, g, y, r)],
        f"{key} {kind}, avg_vehicle_count double, avg_speed double, count_multiplier double, speed_multiplier double, "
        "green int, yellow int, red int")
    return out.unionByName(base.where(readings.select(F.count(F.lit(1))).scalar() == 0))


def format_timestamp(text: str | Column) -> Column:
    """K1: numeric text of Unix seconds -> 'yyyy-MM-dd HH:mm:ss' (UTC);
    'Invalid timestamp' when it does not parse."""
    x = F.expr(f"try_cast({text} as double)") if isinstance(text, str) else text.try_cast("double")
    # years 1 to 9999; also rules out NaN and infinity, which no cast survives
    secs = F.when(x.between(-62135596800.0, 253402300799.0), F.floor(x))
    return F.coalesce(F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd HH:mm:ss"), F.lit("Invalid timestamp"))

