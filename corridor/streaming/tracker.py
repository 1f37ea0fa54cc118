"""Centroid tracker as keyed streaming state (per camera).

State per camera: ``tracks``, a map from track id to its last place, frame,
detector id and last <= 20 centres; ``waiting``, the detections of frames that
are still open; ``meta``, the next id, the last closed frame and the latest
event time.  A frame is matched by ``corridor.operators.tracking.step``: the
detector's ids first, then one to one by the least total distance.  Tracks not
updated for more than 5 frames end, so the state stays bounded however long
the stream runs.

Frames wait in state until the watermark has passed their event time and are
then closed in frame order, so a frame split over Arrow chunks or micro-batches
is tracked as a whole, and frames within the watermark's delay may arrive in
any order.  Detections of a frame that is already closed come too late and are
dropped.  A camera that sends nothing for ``IDLE_MS`` of event time is
forgotten.  Detections without camera, frame, id, place or time take no part;
``untracked`` has them for the quarantine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tracking import PATH_LEN, Track, step, trackable
from .stateful import Waking, hold, state_store_conf

IDLE_MS = 60 * 60 * 1000

OUTPUT_SCHEMA = T.StructType([
    T.StructField("camera_id", T.LongType()), T.StructField("frame_id", T.LongType()),
    T.StructField("det_id", T.LongType()), T.StructField("assigned_track", T.LongType()),
    T.StructField("matched", T.BooleanType()), T.StructField("path_len", T.IntegerType()),
])


class Tracker(Waking):
    def init(self, handle) -> None:
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "track_id long", "cx double, cy double, last long, detector long, seen long, xs array<double>, ys array<double>")
        self.waiting = handle.getListState("waiting", "frame_id long, det_id long, cx double, cy double, detector long, ms long")
        self.meta = handle.getValueState("meta", "next_id long, closed long, last_ms long")

    def advance(self, key, frames, passed, woken):
        next_id, closed, last = self.meta.get() if self.meta.exists() else (0, None, 0)
        held = [tuple(w) for w in self.waiting.get()]
        n_held = len(held)
        for p in frames:
            ms = p["event_ts"].astype("datetime64[us]").astype("int64") // 1000
            held += zip(*(p[c].tolist() for c in ("frame_id", "det_id", "cx", "cy", "detector")), ms.tolist())
        open_, time = {}, {}
        for fid, det_id, cx, cy, detector, ms in held:
            if closed is None or fid > closed:
                open_.setdefault(fid, set()).add((det_id, cx, cy, detector))
                time[fid] = max(time.get(fid, ms), ms)
        last = max([last, *time.values()])
        # a timer set for a frame finds it passed; the one for an idle camera finds none
        idle = woken and not any(t < passed for t in time.values()) and passed > last + IDLE_MS
        ready = []
        for fid in sorted(open_):
            if time[fid] >= passed and not idle:
                break
            ready.append(fid)
        out, camera = [], int(key[0])
        if ready:
            saved = {k[0]: v for k, v in self.tracks.iterator()}
            now = [Track(i, *v[:4], v[4]) for i, v in sorted(saved.items())]
            paths = {i: list(zip(v[5], v[6])) for i, v in saved.items()}
            touched = set()

            def label():
                nonlocal next_id
                next_id += 1
                return next_id - 1

            for fid in ready:
                dets = sorted(open_.pop(fid))
                for d, (t, old) in zip(dets, step(now, fid, dets, label)):
                    paths[t.label] = (paths.get(t.label, []) + [(d[1], d[2])])[-PATH_LEN:]
                    touched.add(t.label)
                    out.append((camera, fid, d[0], t.label, old, len(paths[t.label])))
                closed = fid
            alive = {t.label for t in now}
            for i in saved.keys() - alive:
                self.tracks.removeKey((i,))
            for t in now:
                if t.label in touched or t.place() != tuple(saved[t.label][:4]):
                    xs, ys = zip(*paths[t.label])
                    self.tracks.updateValue((t.label,), (*t.place(), t.seen, list(xs), list(ys)))
        if idle:
            for s in (self.tracks, self.waiting, self.meta):
                s.clear()
            self.wake_at(None)
        else:
            if ready:
                hold(self.waiting, [(fid, *d, time[fid]) for fid in sorted(open_) for d in sorted(open_[fid])])
            elif len(held) > n_held:
                self.waiting.appendList(held[n_held:])
            self.meta.update((next_id, closed, last))
            # held back by an earlier frame, a passed one waits for that frame's time
            self.wake_at(max(time[min(open_)] if open_ else last + IDLE_MS, passed) + 1)
        return [pd.DataFrame(out, columns=OUTPUT_SCHEMA.names)] if out else []


def untracked(detections: DataFrame, detector_col: str | None = "track_id") -> DataFrame:
    """The detections that ``track_stream`` leaves out, for the quarantine."""
    _, bad = trackable(detections.where(F.col("event_ts").isNotNull()), detector_col)
    return bad.unionByName(detections.where(F.col("event_ts").isNull()))


def track_stream(detections: DataFrame, watermark: str = "1 minute", detector_col: str | None = None) -> DataFrame:
    """J7 on a stream of valid detections (camera_id, frame_id, det_id, cx, cy,
    event_ts).  ``detector_col`` holds the detector's own ids (0 or less: none)."""
    state_store_conf(detections.sparkSession)
    if detector_col is None and "track_id" in detections.columns:
        detector_col = "track_id"
    good, _ = trackable(detections.where(F.col("event_ts").isNotNull()), detector_col, "event_ts")
    return (good.withWatermark("event_ts", watermark).groupBy("camera_id")
            .transformWithStateInPandas(Tracker(), OUTPUT_SCHEMA, "Append", "EventTime"))
