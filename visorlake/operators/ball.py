"""One ball followed through a video, in the coordinates of the frame where its life began."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, types as T

from visorlake.scale import FRAME_SPAN, ordered_steps

STILL = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
LIFE = T.StructType([T.StructField(n, t) for n, t in (
    ("life", T.IntegerType()), ("missing", T.IntegerType()), ("gap", T.IntegerType()),
    ("x", T.DoubleType()), ("y", T.DoubleType()), ("r", T.DoubleType()), ("wx", T.DoubleType()), ("wy", T.DoubleType()), ("raw_step", T.DoubleType()),
    ("all_wx", T.ArrayType(T.DoubleType())), ("all_wy", T.ArrayType(T.DoubleType())))])


def through(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def after(m, n) -> list[float]:
    """The map that applies `n` and then `m`."""
    return [*(m[0] * n[i] + m[1] * n[3 + i] + (m[2] if i == 2 else 0.0) for i in range(3)),
            *(m[3] * n[i] + m[4] * n[3 + i] + (m[5] if i == 2 else 0.0) for i in range(3))]


def back(m, x: float, y: float) -> tuple[float, float]:
    """The point that `m` takes to (x, y); a map without an inverse counts as none."""
    det = m[0] * m[4] - m[1] * m[3]
    if abs(det) < 1e-12:
        return x, y
    x, y = x - m[2], y - m[5]
    return (m[4] * x - m[1] * y) / det, (m[0] * y - m[3] * x) / det


def next_place(life: dict | None, frame: int, found: list[tuple], cam, near: float, far: float, patience: int) -> dict | None:
    """The ball one frame on. `near` and `far` are the reach in diameters while it is seen and while it is missing.

    A life keeps its birth frame, the map from the birth frame to this one, the place in this frame (expected while missing), the radius, the frames
    missed so far and just before a sighting, and the step in the picture if the ball was seen in both frames.
    """
    if life is None:
        if not found:
            return None
        x, y, r = max(found, key=lambda c: c[2])
        return dict(born=frame, map=list(STILL), x=x, y=y, r=r, missing=0, gap=0, step=None)
    moved = cam is not None and len(cam) == 6
    x, y = through(cam, life["x"], life["y"]) if moved else (life["x"], life["y"])
    reach = (far if life["missing"] else near) * 2 * life["r"]
    gaps = [math.hypot(c[0] - x, c[1] - y) for c in found]
    best = min(range(len(found)), key=gaps.__getitem__, default=None)
    now = dict(born=life["born"], map=after(cam, life["map"]) if moved else life["map"], r=life["r"], x=x, y=y, missing=life["missing"] + 1, gap=0, step=None)
    if best is not None and gaps[best] < reach:
        now["x"], now["y"], now["r"] = found[best]
        now["missing"], now["gap"] = 0, life["missing"]
        if not life["missing"]:
            now["step"] = math.hypot(now["x"] - life["x"], now["y"] - life["y"]) / (2 * now["r"])
    return now if now["missing"] <= patience else None


def ball_lives(rows: DataFrame, fps: float, near: float, far: float, patience: float = 2.0, span: int = FRAME_SPAN, **scan) -> DataFrame:
    """Each frame with the life the ball is in, its place in the picture and in the coordinates of the life, and all candidates in the latter.

    `rows`: video_id, frame_idx, cam, and arrays bx, by, br of candidates; more columns pass through. `missing` counts the frames since the last sighting;
    without a ball the columns are null. The fold sees a frame at a time and keeps one ball, so it forgets with the life.
    """
    patient, none = int(patience * fps), (None,) * len(LIFE)

    def step(state, frame, cam, bx, by, br):
        state = next_place(state, frame, list(zip(bx, by, br, strict=True)), cam, near, far, patient)
        if state is None:
            return none, None
        every = [back(state["map"], x, y) for x, y in zip(bx, by, strict=True)]
        return (state["born"], state["missing"], state["gap"], state["x"], state["y"], state["r"], *back(state["map"], state["x"], state["y"]), state["step"],
                [p[0] for p in every], [p[1] for p in every]), state

    return ordered_steps(rows, ["video_id"], "frame_idx", ["frame_idx", "cam", "bx", "by", "br"], step, LIFE, span=span, warmup=int(20 * fps), **scan)
