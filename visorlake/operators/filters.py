"""Row filters over boxes, frames and samples."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def filter_detections(boxes: DataFrame, min_score: float = 0.0, min_area: float = 0.0,
                      score="conf", w="w", h="h") -> DataFrame:
    """Boxes with enough confidence and enough relative area."""
    return boxes.where((F.col(score) >= min_score) & (F.col(w) * F.col(h) >= min_area))


def tallest_person(boxes: DataFrame, keys: list[str], top="y1", height="h") -> DataFrame:
    """Height and top edge of the tallest person box per frame (fractions of the image)."""
    return boxes.groupBy(*keys).agg(F.max(height).alias("maxh"), F.max_by(top, F.struct(
        F.col(height), -F.col(top))).alias("top"), F.count(F.lit(1)).alias("n"))


def is_third_person(th_h: float = 0.15, th_top: float = 0.60):
    return (F.col("maxh") > th_h) & (F.col("top") < th_top)


def filter_first_person(frames: DataFrame, persons: DataFrame, keys: list[str], th_h: float = 0.15,
                        th_top: float = 0.60) -> DataFrame:
    """Frames without a large person reaching into the upper part of the image.

    `persons` holds `maxh` and `top` per frame, so the thresholds can be changed without a new pass.
    """
    third = persons.where(is_third_person(th_h, th_top)).select(*keys)
    return frames.join(third, keys, "left_anti")


def filter_complete_landmarks(df: DataFrame, n: int = 21, boxes="bboxes", marks="hand_landmarks") -> DataFrame:
    """Pair boxes with landmarks by position and keep pairs of exactly `n` points.

    Samples left without a pair are dropped.
    """
    pairs = F.filter(F.arrays_zip(F.col(boxes).alias("box"), F.col(marks).alias("pts")),
                     lambda p: p["box"].isNotNull() & (F.size(F.coalesce(p["pts"], F.array())) == n))
    return df.withColumn("hands", pairs).where(F.size("hands") > 0)


def filter_candidates(frames: DataFrame, boxes="balls", rmin: float = 5.0, rmax: float = 58.0,
                      floor: float = 6.0, dedup_d: float = 1.0) -> DataFrame:
    """Radius gate, then drop a candidate that lies within `dedup_d` diameters of an earlier kept one."""
    near = F.transform(boxes, lambda b: F.struct(
        ((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"),
        ((b["x2"] - b["x1"] + b["y2"] - b["y1"]) / 4).alias("r")))
    sized = F.filter(near, lambda c: (c["r"] >= rmin) & (c["r"] <= rmax))
    kind = "array<struct<x:double,y:double,r:double>>"

    def add(kept, c):
        clash = F.exists(kept, lambda k: F.sqrt((c["x"] - k["x"]) * (c["x"] - k["x"])
                                                + (c["y"] - k["y"]) * (c["y"] - k["y"]))
                         < F.greatest(k["r"], c["r"]) * 2 * dedup_d)
        lifted = F.struct(c["x"].alias("x"), c["y"].alias("y"),
                          F.greatest(c["r"], F.lit(floor)).alias("r"))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(lifted).cast(kind)))

    return frames.withColumn("cands", F.aggregate(sized, F.array().cast(kind), add))


def drop_empty_pseudo(samples: DataFrame, n_boxes="n_boxes", origin="origin") -> DataFrame:
    """Automatically labelled samples need a box; hand-labelled empty ones stay as negatives."""
    return samples.where((F.col(n_boxes) > 0) | (F.col(origin) == "hand"))


def background_pool(cache: DataFrame, source: str, box="box", source_col="source") -> DataFrame:
    """Processed samples of one source that are known to hold no box."""
    return cache.where(F.col(box).isNull() & (F.col(source_col) == source))
