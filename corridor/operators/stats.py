"""Descriptive statistics of readings (D9-D21, D24-D29), ordering and top-k
(F1-F6) and set operations (H2).

All are hash aggregates with map-side partial aggregation; windows only run
over already-aggregated rows whose count is bounded by a key domain (24
hours, 7 days, the location list).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.congestion import congestion_score, score_level, speed_band
from ..functions.numeric import round_half_up
from ..functions.time import event_time, rush_period
from .ordering import exact_quantiles, with_group_rank

HOURS = list(range(24))
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
HIST_BINS = 30


def _rank(agg: DataFrame, order: Sequence[str]) -> DataFrame:
    """1-based ``rank`` of an aggregate whose row count depends on the data
    (e.g. one row per location): distributed sort, no single-task window."""
    return with_group_rank(agg, [], list(order), "_r").withColumn("rank", F.col("_r") + 1).drop("_r")


def _hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.hour(event_time("timestamp")))


def value_counts(readings: DataFrame, columns: Sequence[str] = ("weather", "location")) -> DataFrame:
    """Frequency of each value of each column, ranked by count desc then value."""
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (readings.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
              .where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    # the value domain is data dependent: rank with the distributed sort
    ranked = with_group_rank(counts.withColumn("_neg", -F.col("count")), ["column_name"], ["_neg", "value"], "_r")
    return ranked.withColumn("rank", F.col("_r") + 1).drop("_neg", "_r")


def hourly_pattern(readings: DataFrame) -> DataFrame:
    """Mean speed and vehicle count per hour."""
    return _hour(readings).groupBy("hour").agg(
        F.avg("average_speed_kmph").alias("avg_speed"),
        F.avg("vehicle_count").alias("avg_vehicle_count"),
        F.count(F.lit(1)).alias("n_readings"))


def hourly_band(readings: DataFrame) -> DataFrame:
    """Hourly mean speed with a one-sample-std band."""
    a = _hour(readings).groupBy("hour").agg(F.avg("average_speed_kmph").alias("mean_speed"),
                                            F.stddev_samp("average_speed_kmph").alias("std_speed"))
    return a.withColumns({"lower": F.col("mean_speed") - F.col("std_speed"),
                          "upper": F.col("mean_speed") + F.col("std_speed")})


def daily_hour_trend(readings: DataFrame) -> DataFrame:
    """Mean speed per (date, hour)."""
    t = event_time("timestamp")
    return (readings.withColumns({"date": F.to_date(t), "hour": F.hour(t)})
            .groupBy("date", "hour").agg(F.avg("average_speed_kmph").alias("mean_speed")))


def location_mean_speed(readings: DataFrame) -> DataFrame:
    """Mean speed per location, ranked ascending."""
    a = _keyed(readings, "location").groupBy("location").agg(F.avg("average_speed_kmph").alias("mean_speed"))
    return _rank(a, ["mean_speed", "location"])


def _keyed(readings: DataFrame, key: str) -> DataFrame:
    """Rows without the key belong to no group."""
    return readings.where(F.col(key).isNotNull())


def _group_stats(readings: DataFrame, key: str) -> DataFrame:
    s, v = "average_speed_kmph", "vehicle_count"
    return _keyed(readings, key).groupBy(key).agg(
        F.avg(s).alias("speed_mean"), F.stddev_samp(s).alias("speed_std"),
        F.min(s).alias("speed_min"), F.max(s).alias("speed_max"),
        F.avg(v).alias("vehicle_mean"), F.stddev_samp(v).alias("vehicle_std"),
        F.min(v).alias("vehicle_min"), F.max(v).alias("vehicle_max"),
        F.count(F.lit(1)).alias("n_readings"))


def weather_stats(readings: DataFrame) -> DataFrame:
    """D14."""
    return _group_stats(readings, "weather")


def location_stats(readings: DataFrame) -> DataFrame:
    """D15."""
    return _group_stats(readings, "location")


def location_efficiency(readings: DataFrame) -> DataFrame:
    """``avg_speed / (avg_count + 1) * 100`` on means rounded to 1 dp."""
    a = readings.groupBy("location").agg(
        round_half_up(F.avg("average_speed_kmph"), 1).alias("avg_speed"),
        round_half_up(F.avg("vehicle_count"), 1).alias("avg_vehicle_count"))
    a = a.withColumn("efficiency", F.col("avg_speed") / (F.col("avg_vehicle_count") + 1) * 100)
    return _rank(a.withColumn("_neg", -F.col("efficiency")), ["_neg", "location"]).drop("_neg")


def location_performance(readings: DataFrame) -> DataFrame:
    """``(speed / max speed * .6 + (1 - veh / max veh) * .4) * 100`` on
    location means rounded to 2 dp; the max runs over the location aggregate."""
    a = readings.groupBy("location").agg(
        round_half_up(F.avg("average_speed_kmph"), 2).alias("speed_avg"),
        round_half_up(F.avg("vehicle_count"), 2).alias("vehicle_avg"))
    max_speed = a.select(F.max("speed_avg")).scalar()      # scalar subqueries over the aggregate
    max_vehicles = a.select(F.max("vehicle_avg")).scalar()
    a = a.withColumn("performance_score",
                     (F.try_divide(F.col("speed_avg"), max_speed) * 0.6
                      + (1 - F.try_divide(F.col("vehicle_avg"), max_vehicles)) * 0.4) * 100)
    return _rank(a.withColumn("_neg", -F.col("performance_score")), ["_neg", "location"]).drop("_neg")


def congestion_level_counts(readings: DataFrame) -> DataFrame:
    """Counts by speed band (readings outside (0, 100] are not counted) and by score bins."""
    mx = readings.select(F.max("vehicle_count")).scalar()
    t = readings.select(speed_band("average_speed_kmph").alias("band"),
                        score_level(congestion_score("vehicle_count", "average_speed_kmph", mx)).alias("score_bin"))
    structs = F.array(F.struct(F.lit("speed_band").alias("scheme"), F.col("band").alias("level")),
                      F.struct(F.lit("score_bin").alias("scheme"), F.col("score_bin").alias("level")))
    # like a value count, readings outside every band are not a level
    return (t.select(F.explode(structs).alias("s")).select("s.*").where(F.col("level").isNotNull())
            .groupBy("scheme", "level").agg(F.count(F.lit(1)).alias("n_readings")))


def rush_period_stats(readings: DataFrame) -> DataFrame:
    """Mean speed and count per rush period label."""
    return (_hour(readings).withColumn("rush_period", rush_period("hour"))
            .groupBy("rush_period").agg(F.avg("average_speed_kmph").alias("avg_speed"),
                                        F.avg("vehicle_count").alias("avg_vehicle_count"),
                                        F.count(F.lit(1)).alias("n_readings")))


def day_hour_matrix(readings: DataFrame) -> DataFrame:
    """Mean speed per day of week x hour, Monday first, empty cells 0.
    The pivot values are given, so no extra distinct job runs."""
    t = event_time("timestamp")
    p = (readings.withColumns({"day_of_week": F.weekday(t), "hour": F.hour(t)})
         .groupBy("day_of_week").pivot("hour", HOURS).agg(F.avg("average_speed_kmph")))
    p = p.na.fill(0.0)
    return (p.withColumn("day_name", F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]),
                                                  F.col("day_of_week") + 1))
             .select("day_of_week", "day_name", *[F.col(str(h)).alias(f"h{h:02d}") for h in HOURS]))


def location_hour_congestion(readings: DataFrame) -> DataFrame:
    """Mean of (100 - speed) per location x hour, empty cells 0."""
    p = (_hour(readings).withColumn("c", 100 - F.col("average_speed_kmph"))
         .groupBy("location").pivot("hour", HOURS).agg(F.avg("c")))
    return p.na.fill(0.0).select("location", *[F.col(str(h)).alias(f"h{h:02d}") for h in HOURS])


def peak_insights(readings: DataFrame) -> DataFrame:
    """Peak-volume hour, fastest hour and busiest day (ties -> smallest key)."""
    t = event_time("timestamp")
    h = (readings.withColumn("hour", F.hour(t)).groupBy("hour")
         .agg(F.avg("vehicle_count").alias("vc"), F.avg("average_speed_kmph").alias("sp")))
    d = (readings.withColumn("day_of_week", F.weekday(t)).groupBy("day_of_week")
         .agg(F.avg("vehicle_count").alias("vc")))
    peak = h.select(F.max(F.struct("vc", (-F.col("hour")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("peak_hour"))
    fast = h.select(F.max(F.struct("sp", (-F.col("hour")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("fastest_hour"))
    busy = d.select(F.max(F.struct("vc", (-F.col("day_of_week")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("dow"))
    return peak.select("peak_hour", fast.select("fastest_hour").scalar().alias("fastest_hour"),
                       F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]),
                                    busy.select("dow").scalar() + 1).alias("busiest_day"))


def hour_volume_vs_mean(readings: DataFrame) -> DataFrame:
    """Mean count per hour ranked desc, with the mean of the hourly means."""
    h = _hour(readings).groupBy("hour").agg(F.avg("vehicle_count").alias("mean_vehicle_count"))
    return (h.withColumn("overall_mean", F.avg("mean_vehicle_count").over(Window.partitionBy()))
             .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_vehicle_count"), "hour"))))


def weather_impact(readings: DataFrame) -> DataFrame:
    """Mean speed per weather ranked ascending."""
    a = _keyed(readings, "weather").groupBy("weather").agg(F.avg("average_speed_kmph").alias("mean_speed"))
    return a.withColumn("rank", F.row_number().over(Window.orderBy("mean_speed", "weather")))


def correlation_matrix(readings: DataFrame,
                       columns: Sequence[str] = ("timestamp", "vehicle_count", "average_speed_kmph")) -> DataFrame:
    """Pearson correlation of every column pair, long form, one scan."""
    cols = list(columns)
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    one = readings.agg(*aggs)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")
            rows.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), v.alias("correlation")))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def histogram(readings: DataFrame, columns: Sequence[str] = ("average_speed_kmph", "vehicle_count"),
              bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed)."""
    out = None
    for c in columns:
        mn = readings.select(F.min(F.col(c).cast("double"))).scalar()
        mx = readings.select(F.max(F.col(c).cast("double"))).scalar()
        width = (mx - mn) / bins
        x = F.col(c).cast("double")
        b = F.least(F.floor(F.try_divide(x - mn, width)), F.lit(bins - 1))
        h = (readings.where(x.isNotNull()).select(F.coalesce(b, F.lit(0)).alias("bin"))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
             .select(F.lit(c).alias("column_name"), "bin",
                     (mn + F.col("bin") * width).alias("bin_lo"),
                     (mn + (F.col("bin") + 1) * width).alias("bin_hi"), "count"))
        out = h if out is None else out.unionByName(h)
    return out


def box_stats(readings: DataFrame, group: str = "weather", value: str = "average_speed_kmph",
              id_col: str | None = "reading_id") -> DataFrame:
    """Min, quartiles and max per group (exact, distributed)."""
    q = exact_quantiles(readings, [group], value, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    return q.groupBy(group).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                                  for p, n in names.items()])


def sorted_by_time(readings: DataFrame) -> DataFrame:
    """global time order as an explicit 0-based ``time_rank`` (computed by a
    range-partitioned sort, not a single-task window).  The sorted rows are
    stored with all their columns, so select what is needed before."""
    return with_group_rank(readings, [], ["timestamp", "reading_id"], "time_rank")


def preview(readings: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` readings in time order, formatted (top-k, not a sort)."""
    top = readings.orderBy("timestamp", "reading_id").limit(n)
    return top.select("reading_id",
                      F.date_format(event_time("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
                      "location", "weather", "vehicle_count",
                      F.format_number("average_speed_kmph", 1).alias("average_speed"))


def top_demand_locations(readings: DataFrame, n: int = 3) -> DataFrame:
    """locations with the highest mean vehicle count."""
    a = readings.groupBy("location").agg(F.avg("vehicle_count").alias("mean_demand"))
    return a.orderBy(F.desc("mean_demand"), "location").limit(n)


def first_locations(readings: DataFrame, n: int = 6) -> DataFrame:
    """the first ``n`` locations in arrival order."""
    a = readings.groupBy("location").agg(F.min(F.struct("timestamp", "reading_id")).alias("first"))
    return (a.select("location", F.col("first.timestamp").alias("first_timestamp"),
                     F.col("first.reading_id").alias("first_reading_id"))
             .orderBy("first_timestamp", "first_reading_id").limit(n))


def hash_sample(readings: DataFrame, n: int, id_col: str = "reading_id") -> DataFrame:
    """reproducible sample of ``n`` rows (smallest md5 of the id)."""
    return readings.withColumn("_h", F.md5(F.col(id_col).cast("string"))).orderBy("_h", id_col).limit(n).drop("_h")


def distinct_locations(readings: DataFrame) -> DataFrame:
    """H2."""
    return readings.select("location").where(F.col("location").isNotNull()).distinct()



def grouped_statistics(readings: DataFrame) -> DataFrame:
    """D10 + D14 + D15 in one pass: GROUPING SETS over hour, weather and
    location (one scan, one shuffle of partial aggregates)."""
    h = _hour(readings)
    g = h.groupingSets([["hour"], ["weather"], ["location"]], "hour", "weather", "location").agg(
        F.grouping_id().alias("_gid"),
        F.avg("average_speed_kmph").alias("avg_speed"), F.avg("vehicle_count").alias("avg_vehicle_count"),
        F.stddev_samp("average_speed_kmph").alias("speed_std"), F.count(F.lit(1)).alias("n_readings"))
    # grouping_id bits are (hour, weather, location), 1 = aggregated away
    dim = (F.when(F.col("_gid") == 3, F.lit("hour")).when(F.col("_gid") == 5, F.lit("weather"))
            .otherwise(F.lit("location")))
    key = F.coalesce(F.col("hour").cast("string"), F.col("weather"), F.col("location"))
    return g.select(dim.alias("dimension"), key.alias("key"), "avg_speed", "avg_vehicle_count", "speed_std",
                    "n_readings")
