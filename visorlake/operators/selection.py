"""Greedy choice of frames for review: uncertain and unlike those already chosen."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from visorlake.session import settle

FLOOR = 0.05
#: Picks that are measured again in each round before the distances to them are written down.
NEW_PICKS = 64


def select_for_review(frames: DataFrame, total: int, per_video_cap: int | None = None, novelty: float = 1.0, id="id",
                      video="video_id", score="score", vec="descriptor", pool: int = 2_000) -> DataFrame:
    """The `total` frames a one-by-one greedy choice would take, with their `pick` number.

    The gain of a frame is its scaled score times (distance to the nearest chosen frame)^novelty. Distances
    only shrink, so an earlier gain bounds a later one. The distance to the nearest chosen frame is a column: each round Spark measures all
    frames against the last choices only, without a shuffle, and returns the `pool` best frames and the next best gain; choosing among these is
    the same as choosing among all as long as the winner's gain stays above that bound. A frame beyond the
    bound is met in the next round. Only `pool` frames and the choice itself are ever on the driver. Ties
    go to the smaller id.
    """
    lo, hi = frames.agg(F.min(score), F.max(score)).first()
    base = frames.select(id, video, F.col(vec).alias("_v"),
                         ((F.col(score) - lo) / (hi - lo + 1e-6) + FLOOR).alias("_u"), F.lit(float("inf")).alias("_d"))
    shape = T.StructType([*base.schema.fields, T.StructField("_g", T.DoubleType())])
    picks: list[tuple] = []
    per_video: dict = {}

    def gains(known: np.ndarray, gone: set, full: set, started: bool):
        def run(parts):
            for pdf in parts:
                pdf = pdf[~pdf[id].isin(gone) & ~pdf[video].isin(full)]
                if pdf.empty:
                    continue
                d = pdf["_d"].to_numpy(float).copy()
                x = np.stack(pdf["_v"].to_numpy()).astype(float) if len(known) else None
                for row in known:
                    d = np.minimum(d, np.sqrt(((x - row) ** 2).sum(axis=1)))
                yield pdf.assign(_d=d, _g=pdf["_u"].to_numpy() * (np.power(d, novelty) if started else 1.0))
        return run

    written = 0                                                                # picks whose distances are in `base`
    while len(picks) < total:
        known = np.array([p[3] for p in picks[written:]], dtype=float)
        full = {v for v, n in per_video.items() if per_video_cap is not None and n >= per_video_cap}
        scored = base.mapInPandas(gains(known, {p[0] for p in picks[written:]}, full, bool(picks)), shape)
        if len(known) >= NEW_PICKS:
            scored = settle(scored)
            base, written = scored.drop("_g"), len(picks)
            picks = [(*p[:3], None) for p in picks]                            # their vectors are not needed any more
        top = scored.orderBy(F.desc("_g"), id).limit(pool + 1).collect()
        if not top:
            break
        beyond = (top[-1]["_g"], top[-1][id]) if len(top) > pool else None
        picks += _greedy(top[:pool], beyond, total - len(picks), per_video, per_video_cap, novelty, id, video, bool(picks))
    kind = T.StructType([frames.schema[id], frames.schema[video], T.StructField("gain", T.DoubleType()),
                         T.StructField("pick", T.IntegerType())])
    rows = [(i, v, float(g), n) for n, (i, v, g, _) in enumerate(picks)]
    return frames.sparkSession.createDataFrame(rows, kind)


def _greedy(top, beyond, want, per_video, cap, novelty, id, video, started):
    """Choose from one round's pool until the bound is reached; returns (id, video, gain, vector)."""
    ids = [r[id] for r in top]
    vids = [r[video] for r in top]
    x = np.array([r["_v"] for r in top], dtype=float)
    u = np.array([r["_u"] for r in top], dtype=float)
    d = np.array([r["_d"] for r in top], dtype=float)
    free, out = np.ones(len(top), bool), []
    order = np.argsort(np.array(ids, dtype=object), kind="stable")
    while len(out) < want and free.any():
        gain = u * (np.power(d, novelty) if started or out else 1.0)
        best = max((i for i in order if free[i]), key=lambda i: gain[i])
        if beyond is not None and out and (gain[best] < beyond[0] or (gain[best] == beyond[0] and ids[best] > beyond[1])):
            break
        # The first choice ignores novelty, so its bounds say nothing about the second.
        out.append((ids[best], vids[best], float(gain[best]), x[best].tolist()))
        free[best] = False
        per_video[vids[best]] = per_video.get(vids[best], 0) + 1
        if cap is not None and per_video[vids[best]] >= cap:
            free &= np.array([v != vids[best] for v in vids])
        d = np.minimum(d, np.sqrt(((x - x[best]) ** 2).sum(axis=1)))
        if not started and len(out) == 1:
            break
    return out
