"""Exact global ranks and quantiles without a single-task window.

Quantiles are found by radix selection, without a sort (``exact_quantiles``).

``Window.orderBy(...)`` without ``partitionBy`` (and the exact ``percentile``
aggregate, whose final merge holds every distinct value of a group) funnel a
whole table or group through one task.  For ranks the order is produced by a
range-partitioned sort instead: Spark samples the sort keys so every
partition gets a similar share even when one group holds most rows (a
tie-break column keeps equal values splittable).  Per-partition row counts
form a small table (partitions x groups); its running sums give each
partition's first rank, and a row's rank is that offset plus its position
inside the sorted partition.  The sorted, position-stamped rows are
checkpointed (eagerly, into the cluster's ``spark.checkpoint.dir``) so the
sort runs once, both the count branch and the rank branch read the same
materialised partitions, and lineage is cut: a lost executor re-reads the
checkpoint instead of re-sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored

_POS_MASK = (1 << 33) - 1


def with_group_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                    rank_col: str = "rank", size_col: str | None = None) -> DataFrame:
    """Add a 0-based ``rank_col`` = position of the row inside its group in the
    order ``order_cols`` (which should end in a unique tie-break column).
    With ``size_col`` the group's row count is added too, taken from the
    same small count table (no extra pass over the data)."""
    g = list(group_cols)
    keys = g + list(order_cols)
    sorted_df = (df.repartitionByRange(*[F.col(k) for k in keys])
                   .sortWithinPartitions(*keys)
                   .withColumn("_mid", F.monotonically_increasing_id()))
    sorted_df = sorted_df.withColumns({"_pid": F.shiftright("_mid", 33),
                                       "_pos": F.col("_mid").bitwiseAND(F.lit(_POS_MASK))})
    ensure_checkpoint_dir(df.sparkSession)
    sorted_df = sorted_df.checkpoint(eager=True)
    counts = sorted_df.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_pos").alias("_first"))
    # Running count over the small (partitions x groups) table.
    w = Window.partitionBy(*g).orderBy("_pid") if g else Window.orderBy("_pid")
    offsets = counts.withColumn(
        "_offset", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    extra = []
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_n").over(Window.partitionBy(*g)))
        extra = [size_col]
    offsets = offsets.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{c}") for c in g],
                             F.coalesce("_offset", F.lit(0)).alias("_offset"), "_first", *extra)
    # null-safe: rows with a null group key form a group of their own
    same = F.col("_pid") == F.col("_opid")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (sorted_df.join(offsets, same)
            .withColumn(rank_col, F.col("_offset") + F.col("_pos") - F.col("_first"))
            .drop("_mid", "_pid", "_pos", "_offset", "_first", "_opid", *[f"_o_{c}" for c in g]))


# Digits of a double, the highest first: sign, exponent and 10 bits of the
# fraction; then 21 bits and 21 bits.
_FIRST, _REST = 1 << 10, 1 << 21


def _digits(v: Column) -> list[Column]:
    """Three whole numbers per double, which order as the doubles do (NaN
    last).  Scaling by a power of two is exact, so no two doubles share all."""
    size = F.abs(v)
    e0 = F.greatest(F.lit(-1074.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    m0 = size / F.pow(F.lit(2.0), e0)
    # the logarithm may miss a power of two by one
    e = F.when(m0 >= 2, e0 + 1).when(m0 < 1, e0 - 1).otherwise(e0)
    m = F.when(m0 >= 2, m0 / 2).when(m0 < 1, m0 * 2).otherwise(m0)
    sign = F.when(v < 0, -1.0).otherwise(1.0)
    x1 = (m - 1) * _FIRST
    x2 = (x1 - F.floor(x1)) * _REST
    x3 = (x2 - F.floor(x2)) * _REST
    odd = F.isnan(v) | (size == float("inf"))

    def digit(x: Column, at_odd: Column) -> Column:
        return F.when(odd, at_odd).when(size == 0, 0.0).otherwise(sign * x).cast("long")

    top = float(2200 * _FIRST)
    return [digit((e + 1075) * _FIRST + F.floor(x1), F.when(F.isnan(v), top + 1).otherwise(sign * top)),
            digit(F.floor(x2), F.lit(0.0)), digit(x3, F.lit(0.0))]


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], tie_break: str | None = None,
                    approx_accuracy: int | None = None, bracket_accuracy: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (the pandas / ``quantile_cont`` rule)
    per group: one row per (group, prob) with column ``quantile``.

    Nulls are ignored.  The ranks that are asked for are found by radix
    selection: values are counted by group and first digit, the running counts
    tell in which bin a rank lies, and only the values of such bins are
    counted by the next digit.  Three digits hold a double, so three
    aggregates over a narrow stored projection suffice; a rank at the first or
    last place of its bin, or in a bin of equal values, is found at once, so
    ties, minima and maxima cost nothing.  Nothing is sorted; values are added
    up where they lie, and a group has at most some four million bins.
    With ``approx_accuracy`` the answer comes instead from
    ``percentile_approx`` alone (values taken from the data, no
    interpolation) for when exactness is not worth two more passes.
    ``tie_break`` and ``bracket_accuracy`` are taken from earlier callers;
    radix selection needs neither.
    """
    g, probs = list(group_cols), [float(p) for p in probs]
    if approx_accuracy:
        arr = F.percentile_approx(value_col, probs, approx_accuracy)
        a = df.where(F.col(value_col).isNotNull()).groupBy(*g).agg(arr.alias("_q"))
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("_q").alias("quantile"))
        return a.select(*g, F.explode(pairs).alias("z")).select(*g, F.col("z.prob").alias("prob"),
                                                                F.col("z.quantile").cast("double").alias("quantile"))
    # one key, in which nulls are equal; -0.0 counts as 0.0
    key = F.struct(*(g or [F.lit(0).alias("_all")])).alias("_g")
    base = stored(df.where(F.col(value_col).isNotNull()).select(key, (F.col(value_col).cast("double") + F.lit(0.0)).alias("_v")), "quantile-values")
    found, targets, wanted = None, None, None
    for level in range(3):
        prefix = [f"_d{i}" for i in range(level)]
        digits = _digits(F.col("_v"))
        rows = base.select("_g", "_v", *[digits[i].alias(f"_d{i}") for i in range(level)], digits[level].alias("_d"))
        if level:
            rows = rows.join(targets.select("_g", *prefix).distinct(), ["_g", *prefix], "left_semi")
        bins = rows.groupBy("_g", *prefix, "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = Window.partitionBy("_g", *prefix).orderBy("_d")
        bins = bins.withColumn("_end", F.sum("_n").over(upto))
        if not level:
            bins = stored(bins, "quantile-bins")
            at = F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), (F.lit(p) * (F.col("_count") - 1)).alias("at")) for p in probs])).alias("t")
            wanted = bins.groupBy("_g").agg(F.sum("_n").alias("_count")).select("_g", at).select("_g", "t.*")
            wanted = wanted.withColumns({"_lo": F.floor("at"), "_hi": F.ceil("at")})
            targets = wanted.select("_g", F.explode(F.array("_lo", "_hi")).alias("_rank")).distinct().withColumn("_left", F.col("_rank"))
        place = F.col("_left") - (F.col("_end") - F.col("_n"))
        hit = (targets.join(bins, ["_g", *prefix]).where((place >= 0) & (place < F.col("_n")))
               .select("_g", *prefix, F.col("_d").alias(f"_d{level}"), "_rank", place.alias("_left"),
                       F.when((F.col("_low") == F.col("_high")) | (place == 0), F.col("_low")).when(place == F.col("_n") - 1, F.col("_high")).alias("_value")))
        hit = stored(hit, "quantile-ranks")
        done = hit.where("_value is not null").select("_g", "_rank", "_value")
        found = done if found is None else found.unionByName(done)
        targets = hit.where("_value is null").drop("_value")
        if targets.isEmpty():
            break
    low = found.select("_g", F.col("_rank").alias("_lo"), F.col("_value").alias("lo"))
    high = found.select("_g", F.col("_rank").alias("_hi"), F.col("_value").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    out = wanted.join(low, ["_g", "_lo"]).join(high, ["_g", "_hi"])
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in g], "prob",
                      F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (F.col("at") - F.col("_lo"))).alias("quantile"))
