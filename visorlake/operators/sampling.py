"""Caps, seeded samples, strides and order-dependent thinning."""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from visorlake.scale import (FRAME_SPAN, hash_slice, ordered_scan, positions, running_sum, seeded, span_of,
                             top_per_group)

LIMITED_TOP = 1000


def cap_per_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int,
                  slice_by: Column | None = None) -> DataFrame:
    """First `n` rows per group; 0 keeps all.

    Up to 1,000 rows Spark's group limit trims each map task. Larger caps need `slice_by`, a column that
    rises with the order, so that a large group is ranked in slices.
    """
    if n == 0:
        return df
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if slice_by is None or n <= LIMITED_TOP:
        return top_per_group(df, keys, order, n)
    return positions(df, keys, order, slice_by, "_pos", upto=n).drop("_pos")


def _among_first(df: DataFrame, n: int, seed: int, id: str) -> Column:
    """Condition for the `n` first rows in seeded order, from the hash and id of the n-th one.

    Only the id column is read to find it, and only the slice that holds it is ranked to the end.
    """
    h = seeded(id, seed=seed)
    ranked = positions(df.select(F.col(id), h.alias("_h")), [], [F.col("_h"), F.col(id)], hash_slice(F.col("_h")), "_pos", upto=n)
    last = ranked.agg(F.max(F.struct("_pos", "_h", id)).alias("m")).first()["m"]
    if last is None:
        return F.lit(False)
    return (h < last["_h"]) | ((h == last["_h"]) & (F.col(id) <= F.lit(last[id])))


def sample_seeded(df: DataFrame, n: int, seed: int = 0, id="sample_id", keys: list[str] | None = None) -> DataFrame:
    """Deterministic sample of `n` rows, overall or per group; 0 keeps all. `id` names each row."""
    if n == 0:
        return df
    if not keys:
        return df.where(_among_first(df, n, seed, id))
    h = df.withColumn("_h", seeded(id, seed=seed))
    return cap_per_group(h, keys, ["_h", id], n, hash_slice(F.col("_h"))).drop("_h")


def split_seeded(df: DataFrame, frac: float, seed: int = 0, id="sample_id") -> DataFrame:
    """Exactly int(frac * rows) rows to `val`, the rest to `train`."""
    n_val = int(df.count() * frac)
    first = _among_first(df, n_val, seed, id) if n_val else F.lit(False)
    return df.withColumn("split", F.when(first, "val").otherwise("train"))


def stride_sample(df: DataFrame, stride: int, phases: list[int], splits: tuple[str, ...] = ("val", "test"),
                  span: int = FRAME_SPAN) -> DataFrame:
    """In the chosen splits keep rows whose rank in the video, modulo `stride`, is one of `phases`.

    Other phases of the same stride give disjoint later batches.
    """
    if stride <= 1:
        return df
    chosen = df.where(F.col("split").isin(*splits))
    ranked = positions(chosen, ["split", "video_id"], [F.col("frame_idx"), F.col("sample_id")], span_of("frame_idx", span), "_pos")
    kept = ranked.where(((F.col("_pos") - 1) % stride).isin(phases)).drop("_pos")
    return kept.unionByName(df.where(~F.col("split").isin(*splits) | F.col("split").isNull()))


def sample_to_target(df: DataFrame, target: int, cap: int, span: int = FRAME_SPAN) -> DataFrame:
    """Even sample of about `target` rows: one stride for all videos, at most `cap` rows of each."""
    stride = max(1, round(df.count() / target))
    ranked = positions(df, ["video_id"], [F.col("frame_idx"), F.col("sample_id")], span_of("frame_idx", span), "_pos")
    off = F.col("_pos") - 1 - stride // 2
    return ranked.where((off >= 0) & (off % stride == 0) & (off / stride < cap)).drop("_pos")


def downsample_fps(df: DataFrame, fps: float, src_fps: Column | float = 30.0) -> DataFrame:
    src = src_fps if isinstance(src_fps, Column) else F.lit(float(src_fps))
    step = F.greatest(F.bround(src / fps, 0).cast("int"), F.lit(1))
    return df.where(F.pmod(F.col("frame_idx"), step) == 0)


def spread_sample(df: DataFrame, n: int, order: str, slice_by: Column) -> DataFrame:
    """Every (rows div n)-th row in order, the first `n` of them."""
    step = max(1, df.count() // n)
    ranked = positions(df, [], [F.col(order)], slice_by, "_pos")
    off = F.col("_pos") - 1
    return ranked.where((off % step == 0) & (off < step * n)).drop("_pos")


def _keep(names: list[str], rows: pd.DataFrame, marks: list[bool]) -> pd.DataFrame:
    return rows[np.array(marks, dtype=bool)][names]


def dedup_consecutive(df: DataFrame, threshold: int = 5, hash="hash", span: int = FRAME_SPAN, **scan) -> DataFrame:
    """Keep a frame when its hash differs from the last kept frame of the video by more than `threshold`."""
    names = df.columns

    def fold(key, state, rows):
        last, marks = state, []
        for h in rows[hash]:
            far = last is None or ((int(h) ^ last) & (2**64 - 1)).bit_count() > threshold
            marks.append(far)
            last = int(h) if far else last
        return _keep(names, rows, marks), last

    return ordered_scan(df, ["video_id"], "frame_idx", ["frame_idx"], fold, df.schema, span=span, warmup=200, **scan)


def dedup_consecutive_pixels(df: DataFrame, threshold: float, thumb="thumb", span: int = 2_000, **scan) -> DataFrame:
    """The same rule on the mean absolute difference of 64x64 thumbnails (keep at >= `threshold`)."""
    names = df.columns

    def fold(key, state, rows):
        last = None if state is None else np.array(state)
        marks = []
        for t in rows[thumb]:
            px = np.asarray(t, dtype=int)
            far = last is None or np.abs(px - last).mean() >= threshold
            marks.append(bool(far))
            last = px if far else last
        return _keep(names, rows, marks), None if last is None else last.tolist()

    scan.setdefault("group_rows", span)
    return ordered_scan(df, ["video_id"], "frame_idx", ["frame_idx"], fold, df.schema, span=span, warmup=100, **scan)


def thin_by_gap(df: DataFrame, gap: int, keys: tuple[str, ...] = ("video_id",), span: int = FRAME_SPAN, **scan) -> DataFrame:
    """Keep a frame that lies at least `gap` after the last kept one."""
    names = df.columns

    def fold(key, state, rows):
        last, marks = state, []
        for k in rows["frame_idx"]:
            far = last is None or k - last >= gap
            marks.append(bool(far))
            last = int(k) if far else last
        return _keep(names, rows, marks), last

    return ordered_scan(df, list(keys), "frame_idx", ["frame_idx"], fold, df.schema, span=span, warmup=50 * gap, **scan)


def best_per_cell(dets: DataFrame, size: int = 8, keys: tuple[str, ...] = ("video_id", "frame_idx"), tie="det_id") -> DataFrame:
    """Most confident box per frame, class and `size`-pixel cell of its centre."""
    cell = [((F.col(a) + F.col(b)) / 2 / size).cast("int").alias(n) for a, b, n in (("x1", "x2", "_gx"), ("y1", "y2", "_gy"))]
    return top_per_group(dets.select("*", *cell), [*keys, "cls", "_gx", "_gy"], [F.desc("conf"), F.col(tie)], 1).drop("_gx", "_gy")


def largest_per_image(boxes: DataFrame, key="sample_id", w="w", h="h", tie="box_no") -> DataFrame:
    return top_per_group(boxes, [key], [F.desc(F.col(w) * F.col(h)), F.col(tie)], 1)


def topk_per_image(boxes: DataFrame, k: int, key="sample_id", score="conf", tie="box_no") -> DataFrame:
    return top_per_group(boxes, [key], [F.desc(score), F.col(tie)], k)


def cumulative_split(df: DataFrame, frac: float, group="video_id", seed: int = 0, order: Column | None = None,
                     slice_by: Column | None = None) -> DataFrame:
    """Walk the videos in hash order; a video goes to `val` while the rows before it are below frac * total."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    h = seeded(group, seed=seed) if order is None else order
    walked = running_sum(sizes.withColumn("_h", h), [], [F.col("_h"), F.col(group)],
                         hash_slice(F.col("_h")) if slice_by is None else slice_by, F.col("_n"), "_before", before=True)
    side = walked.select(group, F.when(F.col("_before") < frac * total, "val").otherwise("train").alias("split"))
    return df.drop("split").join(side, group)


def chunk_clips(df: DataFrame, secs: float, fps: float, span: int = FRAME_SPAN) -> DataFrame:
    """Number the fixed-length chunks of each video's sampled frames."""
    if secs <= 0:                                                              # no limit: one chunk
        return df.withColumn("chunk", F.lit(0).cast("long"))
    n = int(secs * fps)
    ranked = positions(df, ["video_id"], [F.col("frame_idx")], span_of("frame_idx", span), "_pos")
    return ranked.withColumn("chunk", F.floor((F.col("_pos") - 1) / n)).drop("_pos")


def oversample(samples: DataFrame, prefixes: list[str], k: int, labelled="labelled", split="split") -> DataFrame:
    """Copies of chosen labelled training samples up to `k` in total, named `<id>_ov<c>`.

    Names that already carry the tag are neither copied again nor produced twice.
    """
    chosen = (F.col(labelled) & (F.col(split) == "train") & ~F.col("sample_id").contains("_ov")
              & F.col("sample_id").rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"))
    copies = (samples.where(chosen).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
              .withColumn("sample_id", F.concat("sample_id", F.lit("_ov"), F.col("_c").cast("string"))).drop("_c")
              ) if k > 1 else samples.limit(0)
    fresh = copies.join(samples.where(F.col("sample_id").contains("_ov")).select("sample_id"), "sample_id", "left_anti")
    return samples.unionByName(fresh)
