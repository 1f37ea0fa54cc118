"""D34 per camera: congestion hotspots over all of a camera's detections.

Seeded k-means for all cameras at once.  Detections at one place are one point
with a weight, which bounds a camera's points by its pixels.  A camera of up
to ``BLOCK_POINTS`` points is a group that one task fits, all steps in one
job.  A camera with more is cut into blocks of that size at most: each step
adds up the members of its clusters per block and then the blocks, so no
camera is ever one group however full it is.  Both ways take the same steps
with the same functions.

Starts are drawn like k-means++: the next centre is the point that wins a
race of exponential times with rates proportional to weight times squared
distance to the centres so far, which is one minimum per camera and draws a
point with the wanted probability.  Times come from a hash of point, start and
seed, so reruns and file layouts give equal centres.  The start of least
inertia stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cpu_partitions, stored
from .detections import HOTSPOT_MIN_DETECTIONS, HOTSPOT_MIN_MEMBERS

# Clusters per camera, min(max(2, n // 5), 10).
MOST_CLUSTERS = 10
# Most points that one task fits as a group, and aim for a block of a camera with more.
BLOCK_POINTS = 1 << 18

_PLACE = ("x", "y", "w", "h")


def _squared(c: Column) -> Column:
    return (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])


def _nearest() -> Column:
    """(d, i): squared distance to the nearest centre, and its number."""
    return F.array_min(F.transform("cs", lambda c, i: F.struct(_squared(c).alias("d"), i.alias("i"))))


# ------------------------------------------------ one block of points, all starts

def _closest(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest of the centres, and its number (the first of equals)."""
    d, at = None, np.zeros(len(x), dtype=np.int64)
    for i, (cx, cy) in enumerate(c):
        e = (x - cx) * (x - cx) + (y - cy) * (y - cy)
        if d is None:
            d = e
        else:
            nearer = e < d
            d[nearer], at[nearer] = e[nearer], i
    return d, at


def _hashed(h: np.ndarray, value: int) -> np.ndarray:
    """Hashes ``h`` of a row's first columns, taken on by a whole number (as ``xxhash64`` does)."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    v = np.uint64((value & 0xFFFFFFFF) * int(p1) & 0xFFFFFFFFFFFFFFFF)
    h = (h + p5 + np.uint64(4)) ^ v
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _race(p: tuple, cs: np.ndarray, seed: int) -> np.ndarray:
    """(start, 3): time, x and y of the first point to arrive in each start; no
    time where all points have a centre."""
    x, y, w, h = p
    step, out = cs.shape[1], np.full((len(cs), 3), np.inf)
    for start, c in enumerate(cs):
        rate = w * _closest(x, y, c)[0] if step else w
        draw = _hashed(_hashed(_hashed(h.astype(np.int64).view(np.uint64), start), seed), step) & np.uint64((1 << 52) - 1)
        with np.errstate(divide="ignore"):
            time = np.where(rate > 0, -np.log((draw.astype(np.float64) + 0.5) / float(1 << 52)) / rate, np.inf)
        i = int(time.argmin())
        if time[i] < np.inf:
            out[start] = time[i], x[i], y[i]
    return out


def _grown(cs: np.ndarray, won: np.ndarray) -> np.ndarray:
    """One more centre per start; where all points have one, the first is there twice."""
    c = won[:, None, 1:]
    return np.concatenate([cs, np.where(np.isinf(won[:, :1, None]), cs[:, :1], c) if cs.shape[1] else c], axis=1)


def _sums(p: tuple, cs: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """(start, cluster, 3): members and the sums of their places, for the starts that move."""
    x, y, w, _ = p
    out = np.zeros((*cs.shape[:2], 3))
    for start in np.flatnonzero(moving):
        at = _closest(x, y, cs[start])[1]
        out[start] = np.stack([np.bincount(at, v, cs.shape[1]) for v in (w, w * x, w * y)], axis=1)
    return out


def _moved(cs: np.ndarray, moving: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after one step, and which starts moved; a centre without members stays."""
    n = sums[:, :, :1]
    new = np.where(n > 0, sums[:, :, 1:] / np.where(n > 0, n, 1), cs)
    return new, moving & ~(np.abs(new - cs) <= 1e-9).all(axis=(1, 2))


def _inertia(p: tuple, cs: np.ndarray) -> np.ndarray:
    x, y, w, _ = p
    return np.array([(w * _closest(x, y, c)[0]).sum() for c in cs])


# ------------------------------------------------ cameras as groups, and in blocks

def _fit_groups(points: DataFrame, starts: int, max_iter: int, seed: int) -> DataFrame:
    """(camera_id, centres) of cameras whose points are one group each."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        p = tuple(pdf[c].to_numpy() for c in _PLACE)
        cs, moving = np.empty((starts, 0, 2)), np.full(starts, True)
        for _ in range(int(pdf["k"].iloc[0])):
            cs = _grown(cs, _race(p, cs, seed))
        for _ in range(max_iter):
            cs, moving = _moved(cs, moving, _sums(p, cs, moving))
            if not moving.any():
                break
        best = cs[_inertia(p, cs).argmin()]
        return pd.DataFrame({"camera_id": pdf["camera_id"].iloc[:1].to_numpy(), "centres": [best.ravel()]})

    parts = points.repartition(cpu_partitions(points.sparkSession), "camera_id")
    return stored(parts.groupBy("camera_id").applyInPandas(fit, _schema(points, "centres array<double>")), "hotspot-centres")


def _schema(points: DataFrame, columns: str) -> str:
    return f"camera_id {points.schema['camera_id'].dataType.simpleString()}, {columns}"


def _fit_blocks(points: DataFrame, starts: int, max_iter: int, seed: int) -> DataFrame:
    """(camera_id, centres) of cameras in blocks: a step is one job, which
    takes the centres to the blocks and one short row per block back."""
    spark = points.sparkSession
    block = F.pmod(F.xxhash64("h", F.lit(seed)), F.ceil(2 * F.col("n_points") / BLOCK_POINTS)).alias("block")
    dealt = points.select("camera_id", block, *_PLACE).repartition(cpu_partitions(spark), "camera_id", "block")
    rows = F.sort_array(F.collect_list(F.struct(*_PLACE))).alias("p")
    blocks = stored(dealt.groupBy("camera_id", "block").agg(rows).select("camera_id", "block", *[F.col(f"p.{c}").alias(c) for c in _PLACE]), "hotspot-blocks")
    state = _schema(points, "cs array<double>, moving array<boolean>")
    part = _schema(points, "block long, cs array<double>, moving array<boolean>, part array<double>")

    def step(centres: DataFrame, of_block, of_blocks) -> DataFrame:
        """``of_block(places, cs, moving)`` per block, then ``of_blocks(cs, moving, parts)`` per camera."""
        def each(batches):
            for pdf in batches:
                found = [of_block(tuple(np.asarray(r[c]) for c in _PLACE), np.asarray(r["cs"], dtype=float).reshape(starts, -1, 2), np.asarray(r["moving"]))
                         for r in pdf.to_dict("records")]
                yield pdf[["camera_id", "block", "cs", "moving"]].assign(part=[f.ravel() for f in found])

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            one = pdf.iloc[0]
            cs, moving = of_blocks(np.asarray(one["cs"], dtype=float).reshape(starts, -1, 2), np.asarray(one["moving"]), np.stack(pdf["part"].to_list()))
            return pd.DataFrame({"camera_id": pdf["camera_id"].iloc[:1].to_numpy(), "cs": [cs.ravel()], "moving": [moving]})

        return stored(blocks.join(centres, "camera_id").mapInPandas(each, part).groupBy("camera_id").applyInPandas(together, state), "hotspot-centres")

    def first(cs, moving, parts):
        won = parts.reshape(len(parts), starts, 3)
        return _grown(cs, won[won[:, :, 0].argmin(axis=0), np.arange(starts)]), moving

    def added(cs, moving, parts):
        return _moved(cs, moving, parts.sum(axis=0).reshape(*cs.shape[:2], 3))

    def least(cs, moving, parts):
        return cs[parts.sum(axis=0).argmin()], moving

    none = F.array().cast("array<double>").alias("cs")
    centres = points.select("camera_id").distinct().select("camera_id", none, F.array_repeat(F.lit(True), starts).alias("moving"))
    # a camera in blocks has points enough for all clusters
    for _ in range(MOST_CLUSTERS):
        centres = step(centres, lambda p, cs, moving: _race(p, cs, seed), first)
    settled = []
    for _ in range(max_iter):
        centres = step(centres, _sums, added)
        any_moves = F.exists("moving", lambda m: m)
        settled.append(centres.where(~any_moves))
        centres = centres.where(any_moves)
        if centres.isEmpty():
            break
    for s in settled:
        centres = centres.unionByName(s)
    return step(centres, lambda p, cs, moving: _inertia(p, cs), least).select("camera_id", F.col("cs").alias("centres"))


def camera_clusters(valid: DataFrame, starts: int = 10, max_iter: int = 300, seed: int = 0) -> DataFrame:
    """(camera_id, cluster, x, y, vehicle_count, inertia, x0, y0, x1, y1) for
    each cluster with members, of cameras with more than five detections."""
    there = F.col("camera_id").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    points = stored(valid.where(there).groupBy("camera_id", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
                    .agg(F.count(F.lit(1)).alias("w")), "hotspot-points")
    k = F.least(F.greatest(F.lit(2), F.floor(F.col("n") / 5)), F.lit(MOST_CLUSTERS)).cast("int")
    sizes = stored(points.groupBy("camera_id").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("n_points"))
                   .where(F.col("n") > HOTSPOT_MIN_DETECTIONS).select("camera_id", k.alias("k"), "n_points"), "hotspot-sizes")
    sized = points.join(sizes, "camera_id").withColumn("h", F.xxhash64("camera_id", "x", "y"))
    large = F.col("n_points") > BLOCK_POINTS
    fitted = _fit_groups(sized.where(~large), starts, max_iter, seed)
    if not sizes.where(large).isEmpty():
        fitted = fitted.unionByName(_fit_blocks(sized.where(large), starts, max_iter, seed))
    pairs = F.transform(F.sequence(F.lit(0), F.size("centres") - 1, F.lit(2)), lambda i: F.struct(F.get("centres", i).alias("x"), F.get("centres", i + 1).alias("y")))
    of = points.join(fitted.select("camera_id", pairs.alias("cs")), "camera_id").withColumn("a", _nearest())
    return (of.select("camera_id", F.col("a.i").alias("cluster"), F.col("a.d").alias("d"), "x", "y", "w", F.expr("cs[a.i]").alias("c"))
            .groupBy("camera_id", "cluster", "c")
            .agg(F.sum("w").alias("vehicle_count"), F.sum(F.col("w") * F.col("d")).alias("inertia"),
                 F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
            .select("camera_id", "cluster", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "vehicle_count", "inertia", "x0", "y0", "x1", "y1"))


def camera_hotspots(valid: DataFrame, starts: int = 10, max_iter: int = 300, seed: int = 0) -> DataFrame:
    """D34 per camera: clusters with more than two vehicles, density = members
    / area of their bounding box (1 if it has none)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(1.0))
    return (camera_clusters(valid, starts, max_iter, seed).where(F.col("vehicle_count") > HOTSPOT_MIN_MEMBERS)
            .select("camera_id", "cluster", F.col("x").cast("int").alias("center_x"), F.col("y").cast("int").alias("center_y"),
                    "vehicle_count", F.round(F.col("vehicle_count") / area, 4).alias("density_score")))
