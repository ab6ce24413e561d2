"""Per-frame signals over bounded look-back or look-ahead, cut into spans so long videos stay parallel."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visorlake.functions.boxes import affine_apply, hypot
from visorlake.scale import FRAME_SPAN, positions, running_sum, span_of, with_halo

BALL_MM = 42.7
MAX_MPS = 8.0


def running_count(frames: DataFrame, hits: DataFrame, span: int = FRAME_SPAN) -> DataFrame:
    """Hits, and made hits, up to and including each frame."""
    per = hits.groupBy("video_id", F.col("hit").alias("frame_idx")).agg(
        F.count(F.lit(1)).alias("_h"), F.count_if("made").alias("_m"))
    both = frames.join(per, ["video_id", "frame_idx"], "left")
    for src, name in (("_h", "hits"), ("_m", "made_hits")):
        both = running_sum(both, ["video_id"], [F.col("frame_idx")], span_of("frame_idx", span), F.coalesce(src, F.lit(0)), name)
    return both.drop("_h", "_m")


def track_gaps(tracks: DataFrame, max_gap: int = 6, slow: float = 1.2, span: int = FRAME_SPAN) -> DataFrame:
    """Neighbouring observations of a track with a short gap and slow motion between them.

    Tracks of fewer than three observations are ignored.
    """
    ident = ["video_id", "cls", "track_id"]
    long_enough = tracks.groupBy(*ident).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3).select(*ident)
    w = W.partitionBy(*ident, "_span").orderBy("frame_idx")
    nxt = F.lead(F.struct("frame_idx", "x1", "y1", "x2", "y2")).over(w)
    pairs = (with_halo(tracks, "frame_idx", ahead=max_gap, span=span).withColumn("_next", nxt).where(F.col("_own") & F.col("_next").isNotNull())
             .withColumn("gap", F.col("_next.frame_idx") - F.col("frame_idx")).where(F.col("gap").between(2, max_gap)))
    size = F.greatest((F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")) / 2, F.lit(8.0))
    move = hypot((F.col("_next.x1") + F.col("_next.x2")) / 2 - (F.col("x1") + F.col("x2")) / 2,
                 (F.col("_next.y1") + F.col("_next.y2")) / 2 - (F.col("y1") + F.col("y2")) / 2)
    return (pairs.where(move / F.col("gap") <= slow * size)
            .join(long_enough, ident, "left_semi").drop("_span", "_own"))


def interpolate_boxes(tracks: DataFrame, max_gap: int = 6, slow: float = 1.2, span: int = FRAME_SPAN) -> DataFrame:
    """Expected box on every missing frame inside the gaps of `track_gaps`."""
    gaps = track_gaps(tracks, max_gap, slow, span)
    steps = gaps.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("gap") - 1)))
    a = F.col("_i") / F.col("gap")
    return steps.select("video_id", "cls", "track_id", (F.col("frame_idx") + F.col("_i")).alias("frame_idx"),
                        *[(F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * a).alias(c) for c in ("x1", "y1", "x2", "y2")])


def ema(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, slice_by: Column, name="ema",
        start_at_first: bool = False) -> DataFrame:
    """Exponential smoothing y = (1 - alpha) y + alpha x, from 0 or from the first value.

    Each group is cut into runs of `n` rows, smoothed from 0 by a weighted prefix sum. `n` is the longest
    run whose weights still fit a double; by then the value two runs back has faded below its precision, so
    the end of the run before is all that is carried in.
    """
    if alpha >= 1.0:                                                           # nothing of the past is kept
        return df.withColumn(name, F.col(value).cast("double"))
    keep = 1.0 - alpha
    n = max(1, int(250 / -math.log10(keep)))
    cut = (positions(df, keys, [F.col(order)], slice_by, "_pos")
           .withColumns({"_run": F.floor((F.col("_pos") - 1) / n), "_r": (F.col("_pos") - 1) % n + 1}))
    ks = [*keys, "_run"]
    term = F.col(value) * F.when((F.col("_pos") == 1) & F.lit(start_at_first), 1.0).otherwise(alpha)
    w = W.partitionBy(*ks).orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_y", F.pow(F.lit(keep), F.col("_r")) * F.sum(term * F.pow(F.lit(keep), -F.col("_r"))).over(w))
    ends = local.where(F.col("_r") == n).select(*keys, (F.col("_run") + 1).alias("_run"), F.col("_y").alias("_carry"))
    return (local.join(ends, ks, "left")
            .withColumn(name, F.col("_y") + F.pow(F.lit(keep), F.col("_r")) * F.coalesce("_carry", F.lit(0.0)))
            .drop("_run", "_pos", "_r", "_y", "_carry"))


def peak_in_window(hits: DataFrame, speed: DataFrame, fps: float = 30.0, secs: float = 0.6, value="mps") -> DataFrame:
    """Largest value in the first `secs` after each hit; 0 when there is none."""
    reach = hits.select("video_id", "hit").withColumn(
        "frame_idx", F.explode(F.sequence(F.col("hit"), F.col("hit") + F.lit(int(secs * fps) - 1))))
    peak = (reach.join(speed.select("video_id", "frame_idx", value), ["video_id", "frame_idx"])
            .groupBy("video_id", "hit").agg(F.max(value).alias("_p")))
    return hits.join(peak, ["video_id", "hit"], "left").withColumn("peak", F.coalesce("_p", F.lit(0.0))).drop("_p")


def lookback_dwell(df: DataFrame, near: Column, lookback: float, at="frame_idx", keys: tuple[str, ...] = ("video_id",),
                   touch: Column | None = None, max_dt: float | None = None, span: int = FRAME_SPAN) -> DataFrame:
    """Rows, or with `max_dt` seconds, with `near` in the last `lookback`; and whether any row is a `touch`."""
    w = W.partitionBy(*keys, "_span").orderBy(at)
    rows = with_halo(df.withColumns({"_near": near, "_touch": F.lit(False) if touch is None else touch}), at,
                     back=2 * lookback if max_dt else lookback, span=span)
    amount = F.lit(1)
    if max_dt is not None:
        starts = df.groupBy(*keys).agg(F.min(at).alias("_t0"))
        alone = F.when(F.col(at) == F.col("_t0"), 0.0).otherwise(max_dt)
        gap = F.least(F.coalesce(F.col(at) - F.lag(at).over(w), alone), F.lit(max_dt))
        rows = rows.join(starts, list(keys)).withColumn("_dt", gap)
        amount = F.col("_dt")
    reach = f"{lookback}D" if isinstance(lookback, float) else f"{lookback}"
    back = f"OVER (PARTITION BY {', '.join(keys)}, _span ORDER BY {at} RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW)"
    return (rows.withColumn("_amount", F.when(F.col("_near"), amount).otherwise(F.lit(0)))
            .withColumns({"dwell": F.expr(f"sum(_amount) {back}"), "touched": F.expr(f"max(_touch) {back}")})
            .where("_own").drop("_span", "_own", "_near", "_touch", "_dt", "_t0", "_amount"))


def ego_speed(track: DataFrame, fps: float = 30.0, span: int = FRAME_SPAN) -> DataFrame:
    """Ball speed in m/s after removing the camera motion from the last frame.

    `track`: video_id, frame_idx, x, y, diameter, cam (the matrix from the last frame, or null). Without a
    matrix, or without a position on both frames, the speed is 0; above 8 m/s it is a wrong match, also 0.
    """
    w = W.partitionBy("video_id", "_span").orderBy("frame_idx")
    rows = with_halo(track, "frame_idx", back=1, span=span).withColumn("_p", F.lag(F.struct("frame_idx", "x", "y")).over(w))
    px, py = affine_apply("cam", F.col("_p.x"), F.col("_p.y"))
    mps = hypot(F.col("x") - px, F.col("y") - py) * fps * (BALL_MM / 1000.0) / F.col("diameter")
    known = (F.col("_p.frame_idx") == F.col("frame_idx") - 1) & F.col("cam").isNotNull() & mps.isNotNull()
    return (rows.where("_own").withColumn("mps", F.when(known & (mps <= MAX_MPS), mps).otherwise(F.lit(0.0)))
            .drop("_span", "_own", "_p"))


def frame_velocity(df: DataFrame, x="x", y="y", name="v", span: int = FRAME_SPAN) -> DataFrame:
    """Displacement since the frame directly before, as {name}x and {name}y; null across gaps."""
    w = W.partitionBy("video_id", "_span").orderBy("frame_idx")
    rows = with_halo(df, "frame_idx", back=1, span=span).withColumn("_p", F.lag(F.struct("frame_idx", F.col(x).alias("x"), F.col(y).alias("y"))).over(w))
    step = F.col("_p.frame_idx") == F.col("frame_idx") - 1
    return (rows.where("_own").withColumns({f"{name}x": F.when(step, F.col(x) - F.col("_p.x")),
                                            f"{name}y": F.when(step, F.col(y) - F.col("_p.y"))}).drop("_span", "_own", "_p"))


def velocity_coherence(df: DataFrame, win: int = 8, min_frac: float = 0.6, tol: float = 0.3, move: float = 0.2,
                       span: int = FRAME_SPAN) -> DataFrame:
    """Whether ball and club share one motion over the last `win` frames, which means the camera moved.

    `df`: vbx, vby, vcx, vcy (null where unknown) and `diameter`.
    """
    both = F.col("vbx").isNotNull() & F.col("vcx").isNotNull()
    gap = F.when(both, hypot(F.col("vbx") - F.col("vcx"), F.col("vby") - F.col("vcy")))
    speed = F.when(both, hypot(F.col("vbx"), F.col("vby")))
    w = W.partitionBy("video_id", "_span").orderBy("frame_idx").rangeBetween(-(win - 1), 0)
    rows = with_halo(df.withColumns({"_gap": gap, "_speed": speed}), "frame_idx", back=win - 1, span=span)
    enough = F.count("_gap").over(w) >= max(2, int(min_frac * win))
    same = (F.avg("_gap").over(w) <= tol * F.col("diameter")) & (F.avg("_speed").over(w) >= move * F.col("diameter"))
    return rows.withColumn("coherent", F.coalesce(enough & same, F.lit(False))).where("_own").drop("_span", "_own", "_gap", "_speed")
