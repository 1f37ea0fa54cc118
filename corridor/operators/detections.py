"""Vehicle detections: filtering, per-frame counts, density grids, tracking
joins and flow (B19, C5, C6, D30-D33, D35, D47, E8, E10).

A frame is one image of one camera; everything per frame is a hash
aggregate keyed by (camera_id, frame_id), and per-frame windows run over a
frame's grid cells, whose count is bounded by the image size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import drop_halo, series_frame, series_window, DEFAULT_CHUNK_ROWS

# Vehicle classes (detector class ids), image size, grid cell,
# default confidence threshold, tracking gate.
VEHICLE_CLASSES = {"car": 2, "motorcycle": 3, "bus": 5, "truck": 7, "bicycle": 1}
COUNTED_TYPES = ("car", "truck", "bus", "motorcycle", "bicycle")
IMAGE_W, IMAGE_H = 1280, 720
GRID_CELL = 10
CONFIDENCE_THRESHOLD = 0.5
TRACK_GATE_PX = 50
PATH_LEN = 20
FRAME_KEYS = ("camera_id", "frame_id")
DIRECTIONS = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")


def vehicle_type(class_id):
    pairs = [x for k, v in VEHICLE_CLASSES.items() for x in (F.lit(v), F.lit(k))]
    return F.create_map(*pairs)[class_id]


def valid_detections(det: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """B19 + C6: confidence above the threshold, vehicle classes only; type,
    integer centre and box area."""
    d = det.where((F.col("confidence") > threshold) & F.col("class_id").isin(*VEHICLE_CLASSES.values()))
    return d.withColumns({
        "type": vehicle_type(F.col("class_id")),
        "cx": F.expr("(x1 + x2) div 2"), "cy": F.expr("(y1 + y2) div 2"),
        "area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")),
    })


def frame_counts(valid: DataFrame) -> DataFrame:
    """D30 + D47: vehicles per type (explicit pivot list), total, density per
    100x100 px and each type's share of the frame."""
    p = valid.groupBy(*FRAME_KEYS).pivot("type", list(COUNTED_TYPES)).count().na.fill(0)
    total = sum((F.col(t) for t in COUNTED_TYPES), F.lit(0))
    p = p.withColumn("total_vehicles", total)
    p = p.withColumn("density", F.col("total_vehicles") / (IMAGE_W * IMAGE_H / 10000.0))
    for t in COUNTED_TYPES:
        p = p.withColumn(f"{t}_share_pct", F.try_divide(F.col(t) * 100.0, F.col("total_vehicles")))
    return p


def density_grid(valid: DataFrame) -> DataFrame:
    """D31 (unsmoothed): area-weighted counts per 10-px cell, normalised by
    the frame's largest cell."""
    gw, gh = IMAGE_W // GRID_CELL, IMAGE_H // GRID_CELL
    cells = (valid.withColumns({"gx": F.least(F.expr(f"cx div {GRID_CELL}"), F.lit(gw - 1)),
                                "gy": F.least(F.expr(f"cy div {GRID_CELL}"), F.lit(gh - 1))})
             .groupBy(*FRAME_KEYS, "gx", "gy")
             .agg(F.sum(F.col("area") / (IMAGE_W * IMAGE_H) * 100).alias("weight")))
    frame = Window.partitionBy(*FRAME_KEYS)   # bounded: at most gw * gh cells per frame
    return cells.withColumn("density", F.coalesce(F.try_divide(F.col("weight"), F.max("weight").over(frame)), F.lit(0.0)))


# The 5-tap smoothing weights (binomial, sum 1).
SMOOTHING = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def _spread(cell: str, size: int) -> Column:
    """Where a cell's weight goes along one axis, as structs (at, k): to its
    neighbours and, near a border, also to where its mirror images (the border
    cell itself is not repeated) reach."""
    x = F.col(cell)
    images = F.array(F.struct(x.alias("at"), F.lit(True).alias("ok")), F.struct((-x).alias("at"), (x >= 1).alias("ok")),
                     F.struct((2 * (size - 1) - x).alias("at"), (x <= size - 2).alias("ok")))
    taps = F.array(*[F.struct(F.lit(d - 2).alias("d"), F.lit(k).alias("k")) for d, k in enumerate(SMOOTHING)])
    to = F.flatten(F.transform(F.filter(images, lambda i: i["ok"]), lambda i: F.transform(
        taps, lambda t: F.struct((i["at"] + t["d"]).alias("at"), t["k"].alias("k")))))
    return F.filter(to, lambda t: t["at"].between(0, size - 1))


def smoothed_grid(grid: DataFrame) -> DataFrame:
    """D31 (smoothed): the 5x5 kernel applied to each frame's grid with
    mirrored borders, then re-normalised.  Only non-empty cells send weight,
    at most 25 copies each away from the border."""
    gw, gh = IMAGE_W // GRID_CELL, IMAGE_H // GRID_CELL
    sp = (grid.select(*FRAME_KEYS, "gy", "weight", F.explode(_spread("gx", gw)).alias("x"))
          .select(*FRAME_KEYS, "weight", "x", F.explode(_spread("gy", gh)).alias("y"))
          .groupBy(*FRAME_KEYS, F.col("x.at").alias("gx"), F.col("y.at").alias("gy"))
          .agg(F.sum(F.col("weight") * (F.col("x.k") * F.col("y.k"))).alias("weight")))
    top = F.max("weight").over(Window.partitionBy(*FRAME_KEYS))
    return sp.withColumn("density", F.coalesce(F.try_divide(F.col("weight"), top), F.lit(0.0)))


def grid_stats(grid: DataFrame) -> DataFrame:
    """Max, mean over all cells of the frame (empty cells are 0) and the
    share of non-empty cells."""
    n_cells = (IMAGE_W // GRID_CELL) * (IMAGE_H // GRID_CELL)
    return grid.groupBy(*FRAME_KEYS).agg(
        F.max("density").alias("max_density"),
        (F.sum("density") / n_cells).alias("mean_density"),
        (F.count_if(F.col("density") > 0) / n_cells).alias("nonzero_share"))


def density_histogram(grid: DataFrame, bins: int = 30) -> DataFrame:
    """Per frame the cells in each of ``bins`` equal bins of the density,
    which lies in [0, 1]; cells without weight are in the first bin."""
    n_cells = (IMAGE_W // GRID_CELL) * (IMAGE_H // GRID_CELL)
    at = F.least(F.floor(F.col("density") * bins), F.lit(bins - 1)).cast("int")
    held = grid.where("density > 0").withColumn("bin", at)
    counts = held.groupBy(*FRAME_KEYS).agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("bin") == i).alias(f"_{i}") for i in range(bins)])
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(i / bins).alias("bin_lo"), F.lit((i + 1) / bins).alias("bin_hi"),
                              (F.col(f"_{i}") + (F.lit(n_cells) - F.col("n") if i == 0 else 0)).alias("count")) for i in range(bins)])
    return counts.select(*FRAME_KEYS, F.explode(rows).alias("b")).select(*FRAME_KEYS, "b.*")


def in_out_counts(valid: DataFrame) -> DataFrame:
    """incoming = centre y < 100; outgoing = centre y > (y2 of the
    frame's first detection) - 100."""
    first_y2 = valid.groupBy(*FRAME_KEYS).agg(F.min_by("y2", "det_id").alias("first_y2"))
    return (valid.join(first_y2, list(FRAME_KEYS))
            .groupBy(*FRAME_KEYS)
            .agg(F.count_if(F.col("cy") < 100).alias("incoming_vehicles"),
                 F.count_if(F.col("cy") > F.col("first_y2") - 100).alias("outgoing_vehicles")))


def flow_rate(counts: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``max(0, n_t - n_prev)`` over each camera's frames in order."""
    f = series_frame(counts.select("camera_id", "frame_id", "total_vehicles"), ["camera_id"], ["frame_id"], 1,
                     chunk_rows)
    w = series_window(["camera_id"])
    return drop_halo(f.withColumn("flow_rate", F.greatest(
        F.lit(0), F.col("total_vehicles") - F.lag("total_vehicles", 1).over(w))))


def track_matches(valid: DataFrame, gate: float = TRACK_GATE_PX) -> DataFrame:
    """Match each detection to the nearest detection of the previous
    frame of the same camera within ``gate`` px.

    Candidates meet through a spatial grid of ``gate``-px cells: previous
    detections are copied to the 3 x 3 neighbouring cells and joined on
    (camera, frame, cell), so only nearby pairs are ever formed.
    """
    g = max(1, math.ceil(gate))  # cells no smaller than the gate
    cur = valid.select(*FRAME_KEYS, "det_id", "cx", "cy",
                       F.floor(F.col("cx") / g).alias("kx"), F.floor(F.col("cy") / g).alias("ky"))
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    prev = (valid.select("camera_id", (F.col("frame_id") + 1).alias("frame_id"),
                         F.col("det_id").alias("prev_det_id"), F.col("track_id").alias("prev_track_id"),
                         F.col("cx").alias("pcx"), F.col("cy").alias("pcy"), F.explode(offs).alias("o"))
            .select("*", (F.floor(F.col("pcx") / g) + F.col("o.dx")).alias("kx"),
                    (F.floor(F.col("pcy") / g) + F.col("o.dy")).alias("ky")).drop("o"))
    pairs = (cur.join(prev, [*FRAME_KEYS, "kx", "ky"])
             .withColumn("distance", F.sqrt((F.col("cx") - F.col("pcx")) ** 2 + (F.col("cy") - F.col("pcy")) ** 2))
             .where(F.col("distance") < gate))
    # the nearest as a minimum, which is taken map-side before the shuffle
    nearest = F.min(F.struct("distance", "prev_det_id", "prev_track_id")).alias("m")
    return (pairs.groupBy(*FRAME_KEYS, "det_id").agg(nearest)
            .select(*FRAME_KEYS, "det_id", "m.prev_det_id", "m.prev_track_id", "m.distance"))


def track_motion(valid: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Displacement of each tracked detection (track_id > 0) from the
    previous detection of the same track: pixel speed and 8-way direction."""
    t = valid.where(F.col("track_id") > 0).select("camera_id", "track_id", "frame_id", "det_id", "cx", "cy")
    f = series_frame(t, ["camera_id", "track_id"], ["frame_id", "det_id"], PATH_LEN - 1, chunk_rows)
    w = series_window(["camera_id", "track_id"])
    dx = F.col("cx") - F.lag("cx", 1).over(w)
    dy = F.lag("cy", 1).over(w) - F.col("cy")          # image y grows downwards
    f = f.withColumns({"dx": dx, "dy": dy,
                       "path": F.collect_list(F.struct("frame_id", "cx", "cy")).over(w.rowsBetween(-(PATH_LEN - 1), 0))})
    f = drop_halo(f)
    angle = F.atan2(F.col("dy"), F.col("dx"))
    sector = F.pmod(F.round(angle / (F.lit(3.141592653589793) / 4)).cast("int"), F.lit(8))
    return f.withColumns({
        "pixel_speed": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2),
        "direction": F.when(F.col("dx").isNotNull() & ((F.col("dx") != 0) | (F.col("dy") != 0)),
                            F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), sector + 1)),
    })


def flow_summary(motion: DataFrame, valid: DataFrame) -> DataFrame:
    """D33 (re-aimed on real displacement): per frame the mean pixel speed of
    moving tracked vehicles, the most common direction (ties: smallest name)
    and the number of tracked vehicles."""
    tracked = valid.groupBy(*FRAME_KEYS).agg(F.count_if(F.col("track_id") > 0).alias("vehicle_trajectories"))
    m = motion.where(F.col("direction").isNotNull())
    speed = m.groupBy(*FRAME_KEYS).agg(F.avg("pixel_speed").alias("average_pixel_speed"))
    dcount = m.groupBy(*FRAME_KEYS, "direction").agg(F.count(F.lit(1)).alias("n"))
    # at most 8 direction rows per frame; ties: alphabetically smallest
    top = (dcount.withColumn("_r", F.row_number().over(Window.partitionBy(*FRAME_KEYS)
                                                          .orderBy(F.desc("n"), "direction")))
           .where(F.col("_r") == 1).select(*FRAME_KEYS, F.col("direction").alias("flow_direction")))
    return (tracked.join(speed, list(FRAME_KEYS), "left").join(top, list(FRAME_KEYS), "left")
            .withColumns({"average_pixel_speed": F.coalesce("average_pixel_speed", F.lit(0.0)),
                          "flow_direction": F.coalesce("flow_direction", F.lit("mixed"))}))


# Congestion hotspots -------------------------------------------------
HOTSPOT_SCHEMA = ("camera_id long, frame_id long, cluster int, center_x int, center_y int, "
                  "vehicle_count int, density_score double")
HOTSPOT_MIN_DETECTIONS = 5
HOTSPOT_MIN_MEMBERS = 2


def _kmeans(points, k, seed=0, n_init=10, max_iter=100):
    import numpy as np
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(n_init):
        centers = [points[rng.integers(len(points))]]
        for _ in range(1, k):                                   # k-means++ seeding
            d2 = np.min(((points[:, None, :] - np.array(centers)[None]) ** 2).sum(-1), axis=1)
            p = d2 / d2.sum() if d2.sum() > 0 else np.full(len(points), 1 / len(points))
            centers.append(points[rng.choice(len(points), p=p)])
        c = np.array(centers, dtype=float)
        for _ in range(max_iter):
            labels = ((points[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([points[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = ((points - c[labels]) ** 2).sum()
        if best is None or inertia < best[0]:
            best = (inertia, labels, c)
    return best[1], best[2]


def _frame_hotspots(pdf):
    import numpy as np
    import pandas as pd
    cols = ["camera_id", "frame_id", "cluster", "center_x", "center_y", "vehicle_count", "density_score"]
    pts = pdf.sort_values("det_id")[["cx", "cy"]].to_numpy(dtype=float)
    if len(pts) <= HOTSPOT_MIN_DETECTIONS:
        return pd.DataFrame([], columns=cols)
    k = min(max(2, len(pts) // 5), 10)
    labels, centers = _kmeans(pts, k)
    out = []
    for j in range(k):
        members = pts[labels == j]
        if len(members) > HOTSPOT_MIN_MEMBERS:
            (x0, y0), (x1, y1) = members.min(0), members.max(0)
            area = (x1 - x0) * (y1 - y0) if (x1 > x0 and y1 > y0) else 1.0
            out.append((int(pdf["camera_id"].iloc[0]), int(pdf["frame_id"].iloc[0]), j, int(centers[j][0]),
                        int(centers[j][1]), len(members), round(len(members) / area, 4)))
    return pd.DataFrame(out, columns=cols)


def congestion_hotspots(valid: DataFrame) -> DataFrame:
    """Per frame, k-means (k = min(max(2, n // 5), 10), best of 10
    seeded k-means++ starts) over the detection centres; clusters with more
    than two vehicles are hotspots with density = members / bounding-box
    area.  One group = one frame, whose size is bounded by what a camera
    image can hold."""
    from ..session import cpu_partitions
    v = valid.select("camera_id", "frame_id", "det_id", "cx", "cy")
    # k-means is CPU work: spread frames over all cores explicitly; frames too
    # small for hotspots go before Python sees them, on the same partitioning
    v = v.repartition(cpu_partitions(valid.sparkSession), *FRAME_KEYS)
    n = F.count(F.lit(1)).over(Window.partitionBy(*FRAME_KEYS))
    v = v.withColumn("_n", n).where(F.col("_n") > HOTSPOT_MIN_DETECTIONS).drop("_n")
    return v.groupBy(*FRAME_KEYS).applyInPandas(_frame_hotspots, HOTSPOT_SCHEMA)
