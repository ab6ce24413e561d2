"""Object tracks within a video. Each operator walks a video in frame order through `ordered_scan`."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from visorlake.functions.boxes import values_of
from visorlake.operators.filters import filter_candidates
from visorlake.operators.ball import ball_lives
from visorlake.scale import FRAME_SPAN, ordered_scan

XY = ("x1", "y1", "x2", "y2")


def track_ids(frame: int, no: int) -> int:
    """A track is named by the frame and row that started it, so names do not depend on a counter. The row number takes 32 bits, so no two names are equal."""
    return (frame << 32) + no


def build_tracks(dets: DataFrame, gate: float = 4.0, max_skip: int = 8, det_no="det_no", span: int = FRAME_SPAN, **scan) -> DataFrame:
    """Nearest-neighbour tracks per video and class; adds `track_id`.

    Older tracks choose first, then those that a smaller row started; of equally near boxes a track takes the smallest `det_no`, a number from 0 to
    2^32 - 1 that is unique in a frame and class. The reach is `gate` radii per frame since the track was last seen, and a track ends after `max_skip`
    frames without a match.
    """
    shape = T.StructType([*dets.schema.fields, T.StructField("track_id", T.LongType())])

    def fold(key, state, rows: pd.DataFrame):
        live = [list(t) for t in state or []]       # track_id, frame, cx, cy, r
        out = []
        box = rows[list(XY)].to_numpy(float)
        frames, numbers = rows["frame_idx"].to_numpy(), rows[det_no].to_numpy()
        ids = [0] * len(rows)
        lo = 0
        while lo < len(rows):
            k, hi = int(frames[lo]), lo
            while hi < len(rows) and frames[hi] == k:
                hi += 1
            live = [t for t in live if k - t[1] <= max_skip]
            free = list(range(lo, hi))
            for t in live:
                reach = gate * t[4] * (k - t[1])
                best = min(((math.hypot((box[i, 0] + box[i, 2]) / 2 - t[2], (box[i, 1] + box[i, 3]) / 2 - t[3]), i) for i in free), default=None)
                if best is not None and best[0] < reach:
                    i = best[1]
                    free.remove(i)
                    ids[i] = t[0]
                    t[1:] = _spot(k, box[i])
            for i in free:
                ids[i] = track_ids(k, int(numbers[i]))
                live.append([ids[i], *_spot(k, box[i])])
            lo = hi
        out = rows.assign(track_id=ids)
        last = int(frames[-1]) if len(rows) else -1
        return out[shape.fieldNames()], [t for t in live if last - t[1] <= max_skip]

    return ordered_scan(dets, ["video_id", "cls"], "frame_idx", ["frame_idx", det_no], fold, shape, span=span,
                        warmup=max(30 * max_skip, 120), **scan)


def _spot(k: int, b) -> list:
    return [k, float(b[0] + b[2]) / 2, float(b[1] + b[3]) / 2, max(float(b[2] - b[0] + b[3] - b[1]) / 4, 4.0)]


FACE_TRACKS = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("frame_idx", T.IntegerType()),
                            T.StructField("det_no", T.IntegerType()), T.StructField("track_id", T.LongType()),
                            T.StructField("seen", T.IntegerType()), T.StructField("embed_due", T.BooleanType())])


class FaceTracks:
    """Faces followed by overlap: best pairs first, areas within a factor of two, gone after `max_miss`.

    Overlaps at most `tie` below the best one left count as equal to it: the older track goes first, then the earlier face.
    """

    def __init__(self, state=None, min_iou=0.3, ratio=2.0, max_miss=8, reconfirm=90, tie=0.0):
        self.live = [dict(t) for t in state or []]
        self.min_iou, self.ratio, self.max_miss, self.reconfirm, self.tie = min_iou, ratio, max_miss, reconfirm, tie

    def _pair(self, t, d):
        a, b = t["box"], d
        area = [max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1]) for r in (a, b)]
        if min(area) <= 0 or not 1 / self.ratio <= area[0] / area[1] <= self.ratio:
            return 0.0
        inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = sum(area) - inter
        return inter / union if union > 0 else 0.0

    def step(self, frame: int, boxes: list) -> list[tuple[int, int, int, bool]]:
        """(det_no, track_id, frames seen, embedding due) for each face of the frame."""
        pairs = [(self._pair(t, b), ti, di) for ti, t in enumerate(self.live) for di, b in enumerate(boxes)]
        left = sorted((p for p in pairs if p[0] > self.min_iou), key=lambda p: (-p[0], p[1], p[2]))
        owner: dict[int, dict] = {}
        while left:
            _, ti, di = min((p for p in left if p[0] >= left[0][0] - self.tie), key=lambda p: p[1:])
            owner[di] = self.live[ti]
            left = [p for p in left if p[1] != ti and p[2] != di]
        for t in self.live:
            t["miss"] += 1
        for di, t in owner.items():
            t.update(box=[float(v) for v in boxes[di]], miss=0, seen=t["seen"] + 1)
        self.live = [t for t in self.live if t["miss"] <= self.max_miss]
        for di, b in enumerate(boxes):
            if di not in owner:
                owner[di] = dict(id=track_ids(frame, di), box=[float(v) for v in b], miss=0, seen=1, embedded=None)
                self.live.append(owner[di])
        out = []
        for di in range(len(boxes)):
            t = owner[di]
            due = t["embedded"] is None or frame - t["embedded"] >= self.reconfirm
            if due:
                t["embedded"] = frame
            out.append((di, t["id"], t["seen"], due))
        return out


def face_arrays(frames: DataFrame, faces="faces") -> DataFrame:
    """Corner arrays, which cross to Python as plain numbers."""
    return frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("int").alias("frame_idx"),
                         *[values_of(faces, c).alias(c) for c in XY])


def iou_tracker(frames: DataFrame, faces="faces", span: int = FRAME_SPAN, tie: float = 1e-9, **scan) -> DataFrame:
    """Face tracks with the frames at which an embedding is due. `frames` holds every frame, empty ones too.

    Equal overlaps may differ in their last digits, as corners are rounded; within `tie` the older track has the face.
    """
    def fold(key, state, rows: pd.DataFrame):
        tracker, out = FaceTracks(state, tie=tie), []
        for k, *xy in rows[["frame_idx", *XY]].itertuples(index=False):
            out += [(key[0], int(k), *r) for r in tracker.step(int(k), [list(b) for b in zip(*xy)])]
        return pd.DataFrame(out, columns=FACE_TRACKS.fieldNames()), tracker.live

    return ordered_scan(face_arrays(frames, faces), ["video_id"], "frame_idx", ["frame_idx"], fold, FACE_TRACKS, span=span,
                        warmup=300, **scan)


def video_size(frames: DataFrame, size: tuple[int, int], *more: Column) -> DataFrame:
    """Frame size per video, turned when any box of the video does not fit: `_w`, `_h`, and `more` sums of its frames."""
    def reach(col, f):
        return F.coalesce(F.array_max(F.transform(col, lambda b: b[f])), F.lit(0.0))

    mx, my = (F.max(F.greatest(reach("balls", f), reach("clubs", f))) for f in ("x2", "y2"))
    box = frames.groupBy("video_id").agg(mx.alias("_mx"), my.alias("_my"), *more)
    W, H = map(float, size)
    turned = (F.col("_mx") > W) | (F.col("_my") > H)
    wide = F.col("_mx") >= F.col("_my")
    return box.withColumns({"_w": F.when(turned, F.when(wide, max(W, H)).otherwise(min(W, H))).otherwise(W),
                            "_h": F.when(turned, F.when(wide, min(W, H)).otherwise(max(W, H))).otherwise(H)}).drop("_mx", "_my")


def motion_rows(frames: DataFrame, rmax, rmin: float = 5.0, dedup_d: float = 1.0) -> DataFrame:
    """Ball candidates and club centres of each frame as plain arrays."""
    sized = filter_candidates(frames, "balls", rmin=rmin, rmax=rmax, floor=6.0, dedup_d=dedup_d)
    return sized.select(*[c for c in frames.columns if c not in ("balls", "clubs", "holes")],
                        *[values_of("cands", c).alias(f"b{c}") for c in ("x", "y", "r")],
                        F.transform("clubs", lambda b: (b["x1"] + b["x2"]) / 2).alias("kx"),
                        F.transform("clubs", lambda b: (b["y1"] + b["y2"]) / 2).alias("ky"))


def primary_track(frames: DataFrame, fps: float = 30.0, size: tuple[int, int] = (2048, 1536), near: float = 5.0, far: float = 2.5, span: int = FRAME_SPAN, **scan) -> DataFrame:
    """The followed ball per frame, null while it is not seen. `frames`: balls, clubs and `cam` per frame.

    The largest ball starts; afterwards the nearest one within `near` diameters, or `far` once it was missed, goes on. Ties go to the earlier box.
    """
    rows = motion_rows(frames.withColumn("video_id", F.col("video_id").cast("string")), F.lit(58 / 2048.0 * size[0]))
    keep = rows.select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), "cam", "bx", "by", "br")
    lives = ball_lives(keep, fps, near, far, span=span, **scan)
    return lives.select("video_id", "frame_idx", *[F.when(F.col("missing") == 0, F.col(c)).alias(c) for c in ("x", "y", "r")])
