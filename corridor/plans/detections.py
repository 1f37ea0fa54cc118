"""Registered queries: detections, density grids, tracking and flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections as DT
from ..operators import hotspots as HS
from ..operators import tracking as TK
from ..sources import fixtures as V
from ._registry import query

_V = ("detections",)
CHUNK_ROWS = 1000

_VALID = """
v as (select *, case class_id when 2 then 'car' when 3 then 'motorcycle' when 5 then 'bus' when 7 then 'truck'
                  when 1 then 'bicycle' end as type,
        (x1 + x2) // 2 as cx, (y1 + y2) // 2 as cy, (x2 - x1) * (y2 - y1) as area
      from detections where confidence > 0.5 and class_id in (2, 3, 5, 7, 1))"""


def _valid(spark, sf_dir):
    return DT.valid_detections(V.detections(spark, sf_dir))


@query("b19_valid_detections", views=_V, sql=f"""
with {_VALID}
select det_id, camera_id, frame_id, type, cx::bigint as cx, cy::bigint as cy, area::bigint as area from v""")
def b19_valid_detections(spark, sf_dir):
    return _valid(spark, sf_dir).select("det_id", "camera_id", "frame_id", "type", "cx", "cy", "area")


_COUNT_COLS = ",\n  ".join(f"count_if(type = '{t}')::bigint as {t}" for t in DT.COUNTED_TYPES)
_SHARE_COLS = ",\n  ".join(f"R6({t} * 100.0 / total_vehicles) as {t}_share_pct" for t in DT.COUNTED_TYPES)
_FRAMES = f"""
f as (select camera_id, frame_id, {_COUNT_COLS}, count(*)::bigint as total_vehicles from v group by 1, 2)"""


@query("d30_detections_per_frame", views=_V, sql=f"""
with {_VALID}, {_FRAMES}
select camera_id, frame_id, {", ".join(DT.COUNTED_TYPES)}, total_vehicles,
  R6(total_vehicles / (1280 * 720 / 10000.0)) as density,
  {_SHARE_COLS}
from f""")
def d30_detections_per_frame(spark, sf_dir):
    return DT.frame_counts(_valid(spark, sf_dir))


_GRID = """
g as (select camera_id, frame_id, least(cx // 10, 127) as gx, least(cy // 10, 71) as gy,
        sum(area / (1280 * 720) * 100) as weight from v group by 1, 2, 3, 4),
gn as (select *, weight / max(weight) over (partition by camera_id, frame_id) as density from g)"""


@query("d31_density_grid", views=_V, sql=f"""
with {_VALID}, {_GRID}
select camera_id, frame_id, gx::bigint as gx, gy::bigint as gy, R6(weight) as weight, R6(density) as density from gn""")
def d31_density_grid(spark, sf_dir):
    return DT.density_grid(_valid(spark, sf_dir))


def _axis_sql(cell, size):
    """The 5-tap sum with mirrored borders along one axis, written out as images x taps."""
    return f"""(select i.im, t.d, t.w, case i.im when 0 then {cell} when 1 then -{cell} else {2 * (size - 1)} - {cell} end + t.d as at
     from (values (0), (1), (2)) i(im), (values (-2, 1.0::double / 16), (-1, 4.0::double / 16), (0, 6.0::double / 16),
       (1, 4.0::double / 16), (2, 1.0::double / 16)) t(d, w)
     where i.im = 0 or (i.im = 1 and {cell} >= 1) or (i.im = 2 and {cell} <= {size - 2}))"""


_SMOOTH = f"""
sp as (select g.camera_id, g.frame_id, x.at as gx, y.at as gy, sum(g.weight * (x.w * y.w)) as weight
       from g, lateral {_axis_sql("g.gx", 128)} x, lateral {_axis_sql("g.gy", 72)} y
       where x.at between 0 and 127 and y.at between 0 and 71 group by 1, 2, 3, 4),
sd as (select *, weight / max(weight) over (partition by camera_id, frame_id) as density from sp)"""


@query("d31_density_grid_smoothed", views=_V, sql=f"""
with {_VALID}, {_GRID}, {_SMOOTH}
select camera_id, frame_id, gx::bigint as gx, gy::bigint as gy, R6(weight) as weight, R6(density) as density from sd""")
def d31_density_grid_smoothed(spark, sf_dir):
    """5x5 Gaussian-smoothed grid: 25 weighted neighbour copies per
    non-empty cell, re-summed and normalised per frame."""
    return DT.smoothed_grid(DT.density_grid(_valid(spark, sf_dir)))


@query("d32_grid_stats", views=_V, sql=f"""
with {_VALID}, {_GRID}
select camera_id, frame_id, R6(max(density)) as max_density, R6(sum(density) / 9216) as mean_density,
  R6(count_if(density > 0) / 9216) as nonzero_share
from gn group by 1, 2""")
def d32_grid_stats(spark, sf_dir):
    return DT.grid_stats(DT.density_grid(_valid(spark, sf_dir)))


@query("d32_grid_stats_smoothed", views=_V, sql=f"""
with {_VALID}, {_GRID}, {_SMOOTH}
select camera_id, frame_id, R6(max(density)) as max_density, R6(sum(density) / 9216) as mean_density,
  R6(count_if(density > 0) / 9216) as nonzero_share
from sd group by 1, 2""")
def d32_grid_stats_smoothed(spark, sf_dir):
    """The statistics of the smoothed grid, which is the one on display."""
    return DT.grid_stats(DT.smoothed_grid(DT.density_grid(_valid(spark, sf_dir))))


@query("d28_density_histogram", views=_V, sql=f"""
with {_VALID}, {_GRID}, {_SMOOTH},
b as (select camera_id, frame_id, least(floor(density * 30), 29)::bigint as bin from sd where density > 0),
n as (select camera_id, frame_id, count(*) as n from b group by 1, 2),
c as (select camera_id, frame_id, bin, count(*) as c from b group by 1, 2, 3)
select n.camera_id, n.frame_id, r.bin::bigint as bin, R6(r.bin / 30.0::double) as bin_lo, R6((r.bin + 1) / 30.0::double) as bin_hi,
  (coalesce(c.c, 0) + case when r.bin = 0 then 9216 - n.n else 0 end)::bigint as count
from n cross join range(30) r(bin) left join c on c.camera_id = n.camera_id and c.frame_id = n.frame_id and c.bin = r.bin""")
def d28_density_histogram(spark, sf_dir):
    """30 bins over each frame's smoothed density, empty cells in the first."""
    return DT.density_histogram(DT.smoothed_grid(DT.density_grid(_valid(spark, sf_dir))))


@query("d35_in_out_counts", views=_V, sql=f"""
with {_VALID},
fy as (select camera_id, frame_id, arg_min(y2, det_id) as first_y2 from v group by 1, 2)
select v.camera_id, v.frame_id, count_if(cy < 100)::bigint as incoming_vehicles,
  count_if(cy > first_y2 - 100)::bigint as outgoing_vehicles
from v join fy on v.camera_id = fy.camera_id and v.frame_id = fy.frame_id group by 1, 2""")
def d35_in_out_counts(spark, sf_dir):
    return DT.in_out_counts(_valid(spark, sf_dir))


@query("e8_flow_rate", views=_V, sql=f"""
with {_VALID}, {_FRAMES}
select camera_id, frame_id, total_vehicles,
  row_number() over (partition by camera_id order by frame_id) - 1 as series_pos,
  greatest(0, total_vehicles - lag(total_vehicles) over (partition by camera_id order by frame_id)) as flow_rate
from f""")
def e8_flow_rate(spark, sf_dir):
    f = DT.flow_rate(DT.frame_counts(_valid(spark, sf_dir)), CHUNK_ROWS)
    return f.select("camera_id", "frame_id", "total_vehicles", "series_pos", "flow_rate")


@query("c5_track_matches", views=_V, sql=f"""
with {_VALID},
p as (select c.camera_id, c.frame_id, c.det_id, p.det_id as prev_det_id, p.track_id as prev_track_id,
        sqrt((c.cx - p.cx) ^ 2 + (c.cy - p.cy) ^ 2) as distance
      from v c join v p on c.camera_id = p.camera_id and c.frame_id = p.frame_id + 1
      where sqrt((c.cx - p.cx) ^ 2 + (c.cy - p.cy) ^ 2) < 50),
r as (select *, row_number() over (partition by det_id order by distance, prev_det_id) as rn from p)
select camera_id, frame_id, det_id, prev_det_id, prev_track_id, R6(distance) as distance from r where rn = 1""")
def c5_track_matches(spark, sf_dir):
    return DT.track_matches(_valid(spark, sf_dir))


_MOTION = """
m as (select *, cx - lag(cx) over w as dx, lag(cy) over w - cy as dy,
        count(*) over (w rows between 19 preceding and current row) as path_len,
        first_value(frame_id) over (w rows between 19 preceding and current row) as path_first_frame
      from v where track_id > 0 window w as (partition by camera_id, track_id order by frame_id, det_id)),
mm as (select *, sqrt(dx * dx + dy * dy) as pixel_speed,
         case when dx is not null and (dx <> 0 or dy <> 0) then
           ['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'][((round(atan2(dy, dx) / (pi() / 4))::int % 8) + 8) % 8 + 1]
         end as direction
       from m)"""


@query("e10_track_paths", views=_V, sql=f"""
with {_VALID}, {_MOTION}
select camera_id, track_id, frame_id, det_id, path_len, path_first_frame, R6(pixel_speed) as pixel_speed, direction
from mm""")
def e10_track_paths(spark, sf_dir):
    m = DT.track_motion(_valid(spark, sf_dir), CHUNK_ROWS)
    return m.select("camera_id", "track_id", "frame_id", "det_id", F.size("path").alias("path_len"),
                    F.col("path")[0]["frame_id"].alias("path_first_frame"), "pixel_speed", "direction")


@query("d33_flow_summary", views=_V, sql=f"""
with {_VALID}, {_MOTION},
t as (select camera_id, frame_id, count_if(track_id > 0)::bigint as vehicle_trajectories from v group by 1, 2),
s as (select camera_id, frame_id, avg(pixel_speed) as sp from mm where direction is not null group by 1, 2),
d as (select camera_id, frame_id, direction, count(*) as n from mm where direction is not null group by 1, 2, 3),
top as (select camera_id, frame_id, direction from (select *, row_number() over
          (partition by camera_id, frame_id order by n desc, direction) as r from d) where r = 1)
select t.camera_id, t.frame_id, t.vehicle_trajectories, R6(coalesce(s.sp, 0.0)) as average_pixel_speed,
  coalesce(top.direction, 'mixed') as flow_direction
from t left join s on t.camera_id = s.camera_id and t.frame_id = s.frame_id
  left join top on t.camera_id = top.camera_id and t.frame_id = top.frame_id""")
def d33_flow_summary(spark, sf_dir):
    v = _valid(spark, sf_dir)
    return DT.flow_summary(DT.track_motion(v, CHUNK_ROWS), v).select(
        "camera_id", "frame_id", "vehicle_trajectories", "average_pixel_speed", "flow_direction")


@query("d34_congestion_hotspots", views=_V)
def d34_congestion_hotspots(spark, sf_dir):
    """Per-frame k-means hotspots (property-checked in tests, no oracle)."""
    return DT.congestion_hotspots(_valid(spark, sf_dir))


@query("d34_camera_hotspots", views=_V)
def d34_camera_hotspots(spark, sf_dir):
    """Per-camera k-means hotspots (``d34_camera_invariants`` checks them)."""
    return HS.camera_hotspots(_valid(spark, sf_dir))


@query("j7_track_batch", views=_V)
def j7_track_batch(spark, sf_dir):
    """Tracks of all detections (``j7_track_invariants`` and ``j7_ids_kept`` check them)."""
    return TK.track_detections(_valid(spark, sf_dir))


@query("d47_frame_truck_share", views=_V, sql=f"""
with {_VALID}, {_FRAMES}
select camera_id, frame_id, total_vehicles, truck, R6(truck / total_vehicles) as truck_share,
  truck > total_vehicles * 0.3 as heavy_vehicle_alert
from f""")
def d47_frame_truck_share(spark, sf_dir):
    """Per-frame totals and truck share (the heavy-vehicle rule's input)."""
    c = DT.frame_counts(_valid(spark, sf_dir))
    return c.select("camera_id", "frame_id", "total_vehicles", "truck",
                    F.try_divide(F.col("truck"), F.col("total_vehicles")).alias("truck_share"),
                    (F.col("truck") > F.col("total_vehicles") * 0.3).alias("heavy_vehicle_alert"))
