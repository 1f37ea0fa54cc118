"""Centroid tracking of detections, and its batch form.

One frame of one camera is matched in two stages.  First the detector's own
ids: a detection that carries the id of an active track and lies within the
gate of it belongs to that track.  What is left is matched one to one within
the gate, as many pairs as possible and of those the least total distance.
Unmatched detections open new tracks; a track that no frame has matched for
more than five frames ends.  A detector id belongs to the track that carried
it last.

``track_detections`` tracks whole tables.  A camera's frames depend on one
another, but only through the few tracks that are active at a time, so a
camera is cut into ranges of frames which are tracked in parallel, each from
the tracks that the range before it left at its end in the pass before.
Passes repeat for the ranges whose beginning has changed, until none has: the
result is then that of one walk through the camera.  Tracks are handed over
by place and order alone, not by number, so a vehicle that stays for a whole
day doesn't cost a pass per range; which track is which is resolved after the
last pass by following the hand-overs with doubling steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Gate, eviction age, length of the path that is kept.
GATE_PX = 50.0
EVICT_AFTER_FRAMES = 5
PATH_LEN = 20
RANGE_FRAMES = 512

DETECTION = ["camera_id", "frame_id", "det_id", "cx", "cy"]


class Track:
    """An active track: who it is, where it was seen last and when, the
    detector id that it carries (0: none)."""

    __slots__ = ("label", "cx", "cy", "last", "detector", "seen")

    def __init__(self, label, cx: float, cy: float, last: int, detector: int, seen: int):
        self.label, self.cx, self.cy, self.last, self.detector, self.seen = label, cx, cy, last, detector, seen

    def place(self) -> tuple:
        return self.cx, self.cy, self.last, self.detector


def least_total(cost: np.ndarray, unmatched: float) -> list[int]:
    """For each row its column (or -1) in the assignment of least total cost,
    where a row without a column costs ``unmatched``; no pair: infinite."""
    n, m = cost.shape
    a = np.full((n + 1, m + n + 1), np.inf)
    a[1:, 1:m + 1] = cost
    a[np.arange(1, n + 1), m + np.arange(1, n + 1)] = unmatched  # a column of its own
    u, v = np.zeros(n + 1), np.zeros(m + n + 1)
    row_of = np.zeros(m + n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, way, used = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, int), np.zeros(m + n + 1, bool)
        while True:
            used[j0] = True
            reduced = a[row_of[j0]] - u[row_of[j0]] - v
            better = ~used & (reduced < least)
            least[better], way[better] = reduced[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(free.argmin())
            delta = free[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            row_of[j0], j0 = row_of[j1], j1
    out = [-1] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def _components(pairs: list[tuple[int, int, float]]) -> Iterator[tuple[list[int], list[int], dict]]:
    """Detections and tracks that the pairs connect, part by part."""
    of_det, of_track = {}, {}
    for i, j, d in pairs:
        of_det.setdefault(i, []).append(j)
        of_track.setdefault(j, []).append(i)
    cost = {(i, j): d for i, j, d in pairs}
    seen = set()
    for start in sorted(of_det):
        if start in seen:
            continue
        dets, tracks, open_ = {start}, set(), [start]
        while open_:
            for j in of_det[open_.pop()]:
                if j not in tracks:
                    tracks.add(j)
                    new = [i for i in of_track[j] if i not in dets]
                    dets.update(new)
                    open_ += new
        seen |= dets
        yield sorted(dets), sorted(tracks), cost


def match(tracks: list[Track], dets: list[tuple], gate: float = GATE_PX) -> list[int]:
    """For each detection (det_id, cx, cy, detector) its track's index, or -1."""
    pairs = []
    for i, (_, cx, cy, detector) in enumerate(dets):
        for j, t in enumerate(tracks):
            d = math.hypot(cx - t.cx, cy - t.cy)
            if d < gate:
                pairs.append((i, j, d, detector > 0 and detector == t.detector))
    out, taken = [-1] * len(dets), set()
    for d, j, i in sorted((d, j, i) for i, j, d, same in pairs if same):
        if out[i] < 0 and j not in taken:
            out[i] = j
            taken.add(j)
    rest = [(i, j, d) for i, j, d, _ in pairs if out[i] < 0 and j not in taken]
    for ds, ts, cost in _components(rest):
        if len(ds) == len(ts) == 1:
            out[ds[0]] = ts[0]
            continue
        c = np.array([[cost.get((i, j), np.inf) for j in ts] for i in ds])
        for i, k in zip(ds, least_total(c, gate * (len(ds) + 1))):
            if k >= 0:
                out[i] = ts[k]
    return out


def step(tracks: list[Track], frame: int, dets: list[tuple], label, gate: float = GATE_PX) -> list[tuple[Track, bool]]:
    """Advance ``tracks`` (the oldest first) by one frame of sorted detections
    (det_id, cx, cy, detector).  ``label`` names a new track.  Returns each
    detection's track and whether it was there before."""
    out = []
    for (_, cx, cy, detector), j in zip(dets, match(tracks, dets, gate)):
        if j >= 0:
            t = tracks[j]
            t.cx, t.cy, t.last, t.seen = cx, cy, frame, t.seen + 1
            t.detector = detector if detector > 0 else t.detector
        else:
            t = Track(label(), cx, cy, frame, max(detector, 0), 1)
        out.append((t, j >= 0))
    tracks += [t for t, old in out if not old]
    owner = {t.detector: t for t, _ in out if t.detector}
    for t in tracks:
        if t.detector and owner.get(t.detector, t) is not t:
            t.detector = 0
    tracks[:] = [t for t in tracks if frame - t.last <= EVICT_AFTER_FRAMES]
    return out


# --- batch -----------------------------------------------------------------

def trackable(detections: DataFrame, detector_col: str | None = "track_id", *more: str) -> tuple[DataFrame, DataFrame]:
    """(rows that can be tracked, the others): camera, frame, id and place
    must be there and finite.  The first have the columns of ``DETECTION`` and
    ``detector`` (0 where there is none), and ``more``."""
    sound = F.lit(True)
    for c in DETECTION:
        sound = sound & F.col(c).isNotNull()
    for c in ("cx", "cy"):
        sound = sound & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    sound = F.coalesce(sound, F.lit(False))
    detector = F.coalesce(F.col(detector_col).cast("long"), F.lit(0)) if detector_col else F.lit(0)
    good = detections.where(sound).select(*[F.col(c).cast("long").alias(c) for c in DETECTION[:3]],
                                          *[F.col(c).cast("double").alias(c) for c in DETECTION[3:]], detector.cast("long").alias("detector"), *more)
    return good, detections.where(~sound)


_PLACES = "array<struct<cx:double,cy:double,last:long,detector:long>>"
_DETS = "array<struct<frame_id:long,det_id:long,cx:double,cy:double,detector:long>>"
_LABEL = "born:boolean,n:int"          # a track of this range by number, or of its beginning by slot
_RESULT = (f"camera_id long, rng long, start {_PLACES}, end {_PLACES}, at_end array<struct<{_LABEL},seen:long>>, born long, "
           f"rows array<struct<frame_id:long,det_id:long,{_LABEL},matched:boolean,seen:long>>")


def _track_ranges(gate: float):
    def of_range(camera, rng, dets, start):
        tracks = [Track((False, k), p["cx"], p["cy"], p["last"], p["detector"], 0) for k, p in enumerate(start)]
        rows, born = [], 0

        def label():
            nonlocal born
            born += 1
            return True, born - 1

        i = 0
        while i < len(dets):
            j = i
            while j < len(dets) and dets[j]["frame_id"] == dets[i]["frame_id"]:
                j += 1
            frame, now = dets[i]["frame_id"], [(d["det_id"], d["cx"], d["cy"], d["detector"]) for d in dets[i:j]]
            for d, (t, old) in zip(now, step(tracks, frame, now, label, gate)):
                rows.append((frame, d[0], *t.label, old, t.seen))
            i = j
        return (camera, rng, start, [dict(zip(("cx", "cy", "last", "detector"), t.place())) for t in tracks],
                [(*t.label, t.seen) for t in tracks], born, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pa.list_(pa.struct([("cx", pa.float64()), ("cy", pa.float64()), ("last", pa.int64()), ("detector", pa.int64())]))
        label = [("born", pa.bool_()), ("n", pa.int32())]
        kinds = [pa.int64(), pa.int64(), places, places, pa.list_(pa.struct([*label, ("seen", pa.int64())])), pa.int64(),
                 pa.list_(pa.struct([("frame_id", pa.int64()), ("det_id", pa.int64()), *label, ("matched", pa.bool_()), ("seen", pa.int64())]))]
        names = ["camera_id", "rng", "start", "end", "at_end", "born", "rows"]
        fields = {4: ("born", "n", "seen"), 6: ("frame_id", "det_id", "born", "n", "matched", "seen")}
        for b in batches:
            for r in range(b.num_rows):  # one range at a time: memory is bounded by a range
                got = list(of_range(*(b.column(k)[r].as_py() for k in range(4))))
                for k, f in fields.items():
                    got[k] = [dict(zip(f, x)) for x in got[k]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(got, kinds)], names)
    return run


def track_detections(detections: DataFrame, range_frames: int = RANGE_FRAMES, gate: float = GATE_PX,
                     detector_col: str | None = "track_id") -> DataFrame:
    """J7 on a table: (camera_id, frame_id, det_id, assigned_track, matched,
    path_len) for each trackable detection (equal rows once).  Tracks of a
    camera are numbered from 0 in the order in which they begin."""
    good, _ = trackable(detections, detector_col)
    key = ["camera_id", "rng"]
    by_range = (good.distinct().withColumn("rng", F.floor(F.col("frame_id") / range_frames))
                .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("frame_id", "det_id", "cx", "cy", "detector"))).alias("dets")))
    ranges = stored(by_range, "track-ranges")
    before = F.lag("rng").over(Window.partitionBy("camera_id").orderBy("rng"))  # narrow: two numbers per range
    order = stored(ranges.select(*key, before.alias("before")), "track-order")

    todo = ranges.withColumn("start", F.array().cast(_PLACES))
    passes, now = [], None
    while True:
        done = stored(todo.select(*key, "dets", "start").mapInArrow(_track_ranges(gate), _RESULT), "track-pass")
        passes.append(done)
        fresh = done.select(*key, "start", "end", F.lit(len(passes) - 1).alias("made"))
        if now is not None:
            fresh = fresh.unionByName(now.join(done.select(*key), key, "left_anti"))
        now = stored(fresh, "track-borders")
        left = now.select("camera_id", F.col("rng").alias("before"), F.col("end").alias("next"))
        changed = (order.join(left, ["camera_id", "before"]).join(now.select(*key, "start"), key)
                   .where(~F.col("next").eqNullSafe(F.col("start"))).select(*key, F.col("next").alias("start")))
        changed = stored(changed, "track-changed")
        if changed.isEmpty():
            break
        todo = ranges.join(changed, key)
    final = None
    for k, p in enumerate(passes):
        part = p.join(now.where(F.col("made") == k).select(*key), key, "left_semi")
        final = part if final is None else final.unionByName(part)
    return _numbered(final, order)


def _numbered(final: DataFrame, order: DataFrame) -> DataFrame:
    """Track numbers and path lengths from the ranges' last results."""
    key = ["camera_id", "rng"]
    # what each slot of a range's beginning is in the range before: its number there, or a slot again
    ends = final.select("camera_id", F.col("rng").alias("before"), F.posexplode("at_end").alias("slot", "e"))
    slots = (ends.join(order, ["camera_id", "before"])
             .select("camera_id", "rng", "slot", F.col("before").alias("to"), F.col("e.born").alias("born"), F.col("e.n").alias("n"), F.col("e.seen").alias("seen")))
    slots = stored(slots, "track-slots")
    while not slots.where("not born").isEmpty():
        far = slots.select("camera_id", F.col("rng").alias("to"), F.col("slot").alias("n"), F.col("to").alias("_to"),
                           F.col("born").alias("_born"), F.col("n").alias("_n"), F.col("seen").alias("_seen"))
        open_ = slots.where("not born").join(far, ["camera_id", "to", "n"]).select(
            "camera_id", "rng", "slot", F.col("_to").alias("to"), F.col("_born").alias("born"), F.col("_n").alias("n"), (F.col("seen") + F.col("_seen")).alias("seen"))
        slots = stored(slots.where("born").unionByName(open_), "track-slots")
    # numbers start where the ranges before have ended
    until = Window.partitionBy("camera_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(final.select(*key, "born").withColumn("first", F.coalesce(F.sum("born").over(until), F.lit(0))).drop("born"), "track-first")
    named = (slots.join(first.withColumnRenamed("rng", "to"), ["camera_id", "to"])
             .select("camera_id", "rng", F.col("slot").alias("n"), (F.col("first") + F.col("n")).alias("track"), F.col("seen").alias("earlier")))
    rows = final.select(*key, F.explode("rows").alias("r")).select(*key, "r.*")
    new = rows.where("born").join(first, key).select(*rows.columns, (F.col("first") + F.col("n")).alias("track"), F.lit(0).cast("long").alias("earlier"))
    old = rows.where("not born").join(named, [*key, "n"]).select(*rows.columns, "track", "earlier")
    return new.unionByName(old).select("camera_id", "frame_id", "det_id", F.col("track").cast("long").alias("assigned_track"), "matched",
                                       F.least(F.col("earlier") + F.col("seen"), F.lit(PATH_LEN)).cast("int").alias("path_len"))
