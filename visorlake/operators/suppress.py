"""Greedy non-maximum suppression and two-predictor ensembles."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from visorlake.functions.boxes import iou, of
from visorlake.scale import maybe_broadcast
from visorlake.session import Scratch, settle, settle_table

XY = ["x1", "y1", "x2", "y2"]
FEW_BOXES = 128
IMAGE_BOXES = 20_000
#: Boxes whose pairs are on disk at a time.
ROUND_BOXES = 1 << 24


def _area(xy: np.ndarray) -> np.ndarray:
    return np.clip(xy[:, 2] - xy[:, 0], 0, None) * np.clip(xy[:, 3] - xy[:, 1], 0, None)


def _overlaps(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    low, high = np.maximum(one[:2], many[:, :2]), np.minimum(one[2:], many[:, 2:])
    inter = np.prod(np.clip(high - low, 0, None), axis=1)
    union = _area(one[None])[0] + _area(many) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def nms(boxes: DataFrame, iou_thr: float = 0.6, image: tuple[str, ...] = ("sample_id",), score="conf", tie="box_no",
        max_group: int = IMAGE_BOXES, cell: float | None = None) -> DataFrame:
    """Class-wise suppression: the highest score first, overlaps above `iou_thr` with a kept box removed.

    Equal scores go by `tie`, then by the corners; the order is the same in all three ways, and boxes that agree in all of
    these are the same box to it.

    Images of ordinary size are folded as one sorted array per (image, class), inside the JVM. Crowded ones
    use numpy per group, and a class of an image with more than `max_group` boxes goes through
    `nms_rounds`, which never gathers it. Group sizes are counted before any group is built.
    """
    keys = [*image, "cls"]
    sizes = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_BOXES)
    if sizes.isEmpty():
        return _nms_fold(boxes, iou_thr, keys, score, tie)
    sizes = settle(sizes)
    parts = [_nms_fold(boxes.join(sizes, keys, "left_anti").select(*boxes.columns), iou_thr, keys, score, tie),
             _nms_numpy(boxes.join(sizes.where(F.col("_n") <= max_group), keys, "left_semi").select(*boxes.columns),
                        iou_thr, keys, score, tie)]
    huge = sizes.where(F.col("_n") > max_group)
    if not huge.isEmpty():
        parts.append(nms_rounds(boxes.join(huge, keys, "left_semi").select(*boxes.columns), iou_thr, image, score, tie, cell))
    return reduce(DataFrame.unionByName, parts)


def _nms_fold(boxes: DataFrame, iou_thr: float, keys: list[str], score: str, tie: str) -> DataFrame:
    """Walk the score-ordered boxes of a group, keeping those that overlap no kept one."""
    rest = [c for c in boxes.columns if c not in keys]
    row = F.struct((-F.col(score)).alias("_s"), F.col(tie).alias("_t"), *XY, F.struct(*rest).alias("b"))
    groups = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = groups.schema["_rows"].dataType.elementType["b"].dataType

    def add(kept, r):
        clash = F.exists(kept, lambda k: iou(lambda n: k[n], lambda n: r["b"][n]) > iou_thr)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(r["b"])))

    kept = F.aggregate("_rows", F.array().cast(T.ArrayType(kind)), add)
    return groups.select(*keys, F.explode(kept).alias("_b")).select(*[f"_b.{c}" if c in rest else c for c in boxes.columns])


def _nms_numpy(boxes: DataFrame, iou_thr: float, keys: list[str], score: str, tie: str) -> DataFrame:
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, tie, *XY], ascending=[False, True, True, True, True, True], kind="stable")
        xy, alive, kept = pdf[XY].to_numpy(float), np.ones(len(pdf), bool), []
        for i in range(len(pdf)):
            if alive[i]:
                kept.append(i)
                alive[i + 1:] &= _overlaps(xy[i], xy[i + 1:]) <= iou_thr
        return pdf.iloc[kept]

    return boxes.groupBy(*keys).applyInPandas(group, boxes.schema)


def nms_rounds(boxes: DataFrame, iou_thr: float, image: tuple[str, ...] = ("sample_id",), score="conf", tie="box_no",
               cell: float | None = None) -> DataFrame:
    """The same result from rounds over overlap pairs.

    Images are independent of each other, so more than ROUND_BOXES boxes are taken some images after the other: what is on disk besides the result
    is bounded by them, or by the largest image. The input is then read once for each part; settle it first if it is costly.
    """
    parts = -(-boxes.count() // ROUND_BOXES)
    if parts <= 1:
        return _rounds(boxes, iou_thr, image, score, tie, cell, settle)
    kept = []
    for k in range(parts):
        with Scratch(boxes.sparkSession) as scratch:
            own = boxes.where(F.pmod(F.xxhash64(*image), F.lit(parts)) == k)
            kept.append(settle_table(_rounds(own, iou_thr, image, score, tie, cell, scratch.settle, scratch.free_shuffles)))
    return reduce(DataFrame.unionByName, kept)


def _rounds(boxes: DataFrame, iou_thr: float, image: tuple[str, ...], score: str, tie: str, cell: float | None,
            settle: Callable[[DataFrame], DataFrame], free: Callable[[], None] = lambda: None) -> DataFrame:
    """Suppression of some images.

    Overlapping boxes share a grid cell, so pairs come from an equi-join on (image, class, cell). A class of an image with few boxes is one cell. In each
    round a box with no undecided stronger overlap is kept and the boxes it overlaps are removed. Only pairs of
    row numbers go from round to round; a box is kept if no round removed it.
    """
    keys, own, columns = [*image, "cls"], "_row", boxes.columns
    boxes = settle(boxes.withColumn(own, F.monotonically_increasing_id()))     # two boxes may share `tie`
    free()
    size = cell or (boxes.agg(F.percentile_approx(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(0.9)))
                    .first()[0] or 1.0)
    boxes = boxes.withColumn("_cell", F.lit(float(size)))
    if cell is None:                                                           # a few boxes need no grid: all of them share one cell
        many = settle(boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_BOXES).select(*keys, F.lit(True).alias("_many")))
        grid = F.when(F.col("_many"), F.col("_cell")).otherwise(F.lit(float("inf")))
        boxes = (boxes.withColumn("_cell", F.lit(float("inf"))) if many.isEmpty()
                 else boxes.join(maybe_broadcast(many), keys, "left").withColumn("_cell", grid).drop("_many"))

    def cells(df, p):
        def axis(lo, hi):
            return F.sequence(F.floor(F.col(p + lo) / F.col(p + "cell")), F.floor(F.col(p + hi) / F.col(p + "cell")))
        return df.withColumn("_gx", F.explode(axis("x1", "x2"))).withColumn("_gy", F.explode(axis("y1", "y2")))

    def side(p):
        return boxes.select(*keys, F.col(own).alias(p + "id"), F.col(tie).alias(p + "t"), F.col(score).alias(p + "s"), F.col("_cell").alias(p + "cell"), *[F.col(c).alias(p + c) for c in XY])

    def rank(p):
        return F.struct((-F.col(p + "s")).alias("s"), F.col(p + "t").alias("t"), *[F.col(p + c).alias(c) for c in XY], F.col(p + "id").alias("i"))

    stronger = rank("a_") < rank("b_")
    first = [F.col(g) == F.floor(F.greatest(F.col(f"a_{c}"), F.col(f"b_{c}")) / F.least("a_cell", "b_cell")) for g, c in (("_gx", "x1"), ("_gy", "y1"))]   # of the cells that two boxes share
    edges = settle(cells(side("a_"), "a_").join(cells(side("b_"), "b_"), [*keys, "_gx", "_gy"]).where(first[0] & first[1] & stronger)
                   .where(iou(of("a_"), of("b_")) > iou_thr).select("a_id", "b_id"))
    free()
    lost = [edges.select(F.col("b_id").alias(own)).limit(0)]
    while not edges.isEmpty():
        winners = edges.select("a_id").distinct().join(edges.select(F.col("b_id").alias("a_id")), "a_id", "left_anti")
        losers = settle(edges.join(winners, "a_id", "left_semi").select(F.col("b_id").alias(own)).distinct())
        lost.append(losers)
        edges = settle(edges.join(losers.withColumnRenamed(own, "b_id"), "b_id", "left_anti").join(losers.withColumnRenamed(own, "a_id"), "a_id", "left_anti")
                       .select("a_id", "b_id"))
    return boxes.join(reduce(DataFrame.unionByName, lost), own, "left_anti").select(*columns)


def ensemble_labels(a: DataFrame, b: DataFrame, iou_thr: float = 0.6, image: tuple[str, ...] = ("sample_id",),
                    score="conf", tie="box_no", names: tuple[str, str] = ("D", "Y")) -> DataFrame:
    """Union of two predictors' boxes, then suppression; `origin` keeps where a surviving box came from."""
    both = a.withColumn("origin", F.lit(names[0])).unionByName(b.withColumn("origin", F.lit(names[1])))
    ordered = both.withColumn(tie, F.col(tie) * 2 + (F.col("origin") == names[1]).cast("int"))
    return nms(ordered, iou_thr, image, score, tie).withColumn(tie, F.floor(F.col(tie) / 2).cast(a.schema[tie].dataType))
