"""Scores of detectors, keypoint models, classifiers and encoders."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from visorlake.functions.boxes import iou, of
from visorlake.functions.vectors import cosine, l2_normalize
from visorlake.scale import ordered_scan, python_tasks
from visorlake.session import settle

CONF_SLICES = 4096
#: Boxes that a task of `match_detections` joins and sorts, or so.
TASK_ROWS = 500_000
RECALL_STEPS = 100


def pair_separation(pairs: DataFrame, same="same", value="cosine") -> DataFrame:
    """Range and mean of same and different pairs; threshold between the highest different and lowest same."""
    s, d = F.when(F.col(same), F.col(value)), F.when(~F.col(same), F.col(value))
    out = pairs.agg(F.min(s).alias("same_min"), F.max(s).alias("same_max"), F.avg(s).alias("same_mean"),
                    F.min(d).alias("diff_min"), F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"))
    return out.withColumn("threshold", (F.col("diff_max") + F.col("same_min")) / 2)


def binary_metrics(df: DataFrame, truth="truth", pred="pred", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall and F1; empty denominators count as one."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    out = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                                F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, F.lit(1)),
                           "precision": tp / F.greatest(tp + fp, F.lit(1)), "recall": tp / F.greatest(tp + fn, F.lit(1))})
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f1", 2 * pr * rc / F.greatest(pr + rc, F.lit(1e-6)))


def keypoint_metrics(df: DataFrame, pred="pred", truth="truth", radius: float = 0.1) -> DataFrame:
    """Mean error and share within `radius` over the visible points ({x, y} against {x, y, v})."""
    gaps = F.zip_with(pred, truth, lambda p, t: F.when(t["v"] > 0, F.sqrt(
        (p["x"] - t["x"]) * (p["x"] - t["x"]) + (p["y"] - t["y"]) * (p["y"] - t["y"]))))
    seen = F.filter(gaps, lambda g: g.isNotNull())
    per = df.select(F.size(seen).alias("n"), F.aggregate(seen, F.lit(0.0), lambda a, g: a + g).alias("err"),
                    F.size(F.filter(seen, lambda g: g < radius)).alias("ok"))
    return per.agg((F.sum("err") / F.greatest(F.sum("n"), F.lit(1))).alias("mean_error"),
                   (F.sum("ok") / F.greatest(F.sum("n"), F.lit(1))).alias("pck"), F.sum("n").alias("points"))


def match_detections(preds: DataFrame, truth: DataFrame, thresholds: list[float], image="sample_id") -> DataFrame:
    """The predictions that count as true, per IoU threshold: `threshold`, `det_id`, `gt_id`, `cls`, `conf`.

    A prediction claims the truth it overlaps most; of the claims on one truth the most confident wins.
    Both steps are combined maxima by id, so no image is gathered in one place. `preds` has `det_id`
    and `conf`, `truth` has `gt_id`. A claim is one row for all thresholds; only the winners are repeated. The joins and maxima sort
    their rows, so they get a partition for every TASK_ROWS boxes: what a task holds does not grow with the boxes.
    """
    tasks = max(python_tasks(preds), -(-max(preds.count(), truth.count()) // TASK_ROWS))
    ts = truth.select(image, "cls", "gt_id", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = (preds.select(image, "cls", "det_id", "conf", "x1", "y1", "x2", "y2").repartition(tasks, image, "cls").join(ts.repartition(tasks, image, "cls"), [image, "cls"])
             .withColumn("_iou", iou(of(), of("t_"))).where(F.col("_iou") >= min(thresholds)))
    claims = (pairs.select("det_id", "gt_id", "_iou", "conf", "cls").repartition(tasks, "det_id")
              .groupBy("det_id").agg(F.min_by(F.struct("gt_id", "_iou", "conf", "cls"), F.struct(-F.col("_iou"), "gt_id")).alias("c"))
              .select("det_id", "c.*"))
    first = F.struct(-F.col("conf"), "det_id")
    won = (claims.repartition(tasks, "gt_id").groupBy("gt_id")
           .agg(*[F.min_by(F.struct("det_id", "cls", "conf"), F.when(F.col("_iou") >= float(v), first)).alias(f"_{k}") for k, v in enumerate(thresholds)]))
    each = F.array(*[F.struct(F.lit(float(v)).alias("threshold"), F.col(f"_{k}").alias("w")) for k, v in enumerate(thresholds)])
    return (won.select("gt_id", F.explode(F.filter(each, lambda e: e["w"].isNotNull())).alias("e"))
            .select("e.threshold", "gt_id", "e.w.*"))


def precision_recall(preds: DataFrame, truth: DataFrame, thresholds: list[float], image="sample_id") -> DataFrame:
    """Cumulative precision and recall at each confidence value of a class and threshold.

    Detections of equal confidence form one step, so the counts combine before the shuffle; the number of
    detections per step is counted once for all thresholds. A class may hold most detections: running counts
    are taken inside confidence slices and joined with slice totals.
    """
    ks, group = ["threshold", "cls", "_slice"], ["threshold", "cls"]
    true = match_detections(preds, truth, thresholds, image).groupBy(*group, "conf").agg(F.count(F.lit(1)).alias("tp"))
    seen = preds.groupBy("cls", "conf").agg(F.count(F.lit(1)).alias("n"))
    steps = (seen.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
             .join(true, [*group, "conf"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
             .withColumn("_slice", F.floor((1 - F.col("conf")) * CONF_SLICES)))
    inside = W.partitionBy(*ks).orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, 0)
    totals = steps.groupBy(*ks).agg(F.sum("tp").alias("_t"), F.sum("n").alias("_c"))
    head = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*ks, F.coalesce(F.sum("_t").over(head), F.lit(0)).alias("_t0"),
                           F.coalesce(F.sum("_c").over(head), F.lit(0)).alias("_c0"))
    positives = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("n_truth"))
    local = steps.withColumns({"_tp": F.sum("tp").over(inside), "_n": F.sum("n").over(inside)})
    curve = (local.join(starts, ks).join(positives, "cls")
             .withColumns({"tp_cum": F.col("_tp") + F.col("_t0"), "rank": F.col("_n") + F.col("_c0")})
             .withColumns({"recall": F.col("tp_cum") / F.col("n_truth"), "precision": F.col("tp_cum") / F.col("rank")}))
    return curve.select(*ks, "conf", "tp_cum", "rank", "n_truth", "recall", "precision")


def average_precision(curve: DataFrame) -> DataFrame:
    """Area under the interpolated precision envelope on 101 recall points.

    The curve starts at (0, 1) and ends at (1, 0); each recall point falls into exactly one segment.
    """
    ks, group = ["threshold", "cls", "_slice"], ["threshold", "cls"]
    below = W.partitionBy(*ks).orderBy("rank").rowsBetween(0, W.unboundedFollowing)
    tops = curve.groupBy(*ks).agg(F.max("precision").alias("_p"), F.min_by(F.struct("recall", "precision"), "rank").alias("_f"))
    after = W.partitionBy(*group).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    nxt = tops.select(*ks, F.max("_p").over(after).alias("_later"), F.lead("_f").over(W.partitionBy(*group).orderBy("_slice")).alias("_next"))
    env = curve.join(nxt, ks).withColumn("env", F.greatest(F.max("precision").over(below), F.coalesce("_later", F.lit(0.0))))
    # The point after a row: the next row of the slice, else the first of the next slice, else (1, 0).
    step = F.lead(F.struct("recall", "env")).over(W.partitionBy(*ks).orderBy("rank"))
    last = F.struct(F.lit(1.0).alias("recall"), F.lit(0.0).alias("env"))
    crossing = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next.recall").alias("recall"), F.col("_later").alias("env")))
    rows = env.select(*group, "recall", "env", F.coalesce(step, crossing, last).alias("to"))
    first = (env.groupBy(*group).agg(F.min_by("recall", "rank").alias("r0"), F.max("env").alias("e0"))
             .select(*group, F.lit(0.0).alias("recall"), F.lit(1.0).alias("env"),
                     F.struct(F.col("r0").alias("recall"), F.col("e0").alias("env")).alias("to")))
    segs = rows.unionByName(first).where(F.col("to.recall") > F.col("recall"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(RECALL_STEPS)), lambda i: i / RECALL_STEPS)
    inside = F.filter(grid, lambda x: (x >= F.col("recall")) & (x < F.col("to.recall")))
    slope = (F.col("to.env") - F.col("env")) / (F.col("to.recall") - F.col("recall"))
    pts = F.transform(inside, lambda x: (F.col("env") + slope * (x - F.col("recall")))
                      * F.when((x == 0.0) | (x == 1.0), 0.5).otherwise(1.0) / RECALL_STEPS)
    return segs.groupBy(*group).agg(F.sum(F.aggregate(pts, F.lit(0.0), lambda a, v: a + v)).alias("ap"))


def detection_metrics(preds: DataFrame, truth: DataFrame, thresholds: list[float] | None = None, image="sample_id") -> DataFrame:
    """Per class: precision and recall at the best F1, AP at the first threshold and mean AP over all.

    Classes without truth are absent from the result.
    """
    thresholds = thresholds or [round(0.5 + 0.05 * i, 2) for i in range(10)]
    curve = settle(precision_recall(preds, truth, thresholds, image))
    ap = average_precision(curve).groupBy("cls").agg(
        F.max(F.when(F.col("threshold") == thresholds[0], F.col("ap"))).alias("ap50"), (F.sum("ap") / len(thresholds)).alias("ap50_95"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-16))
    best = (curve.where(F.col("threshold") == thresholds[0]).groupBy("cls")
            .agg(F.max_by(F.struct("precision", "recall"), F.struct(f1, -F.col("rank"))).alias("b"), F.max("n_truth").alias("n_truth"))
            .select("cls", "n_truth", "b.precision", "b.recall"))
    classes = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("n_truth"))
    return (classes.join(best.drop("n_truth"), "cls", "left").join(ap, "cls", "left")
            .select("cls", "n_truth", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")]))


def mean_ap(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("ap50").alias("map50"), F.avg("ap50_95").alias("map50_95"))


def metric_deltas(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("cls",),
                  metrics: tuple[str, ...] = ("precision", "recall", "ap50", "ap50_95")) -> DataFrame:
    """After minus before for each class and metric; null where a class is absent on one side."""
    def long(df, name):
        return df.unpivot(list(keys), [F.col(m) for m in metrics], "metric", name)

    both = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def vector_parity(df: DataFrame, a="a", b="b") -> DataFrame:
    """Cosine and mean absolute differences, raw and normalised, of two encoders' vectors per row."""
    def mad(x, y):
        gaps = F.zip_with(x, y, lambda p, q: F.abs(p.cast("double") - q.cast("double")))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size(gaps)

    return df.withColumns({"cosine": cosine(a, b), "mad": mad(F.col(a), F.col(b)),
                           "mad_normalized": mad(l2_normalize(a), l2_normalize(b))})


def identity_templates(df: DataFrame, key="key", order="order", vec="embedding", eps: float = 1e-9) -> DataFrame:
    """Running mean template per identity, brought back to unit length after each vector, and the count."""
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("template", T.ArrayType(T.DoubleType())),
                        T.StructField("count", T.LongType())])

    def fold(k, state, rows: pd.DataFrame):
        mean, n = (np.array(state[0]), state[1]) if state else (None, 0)
        for v in rows[vec]:
            v = np.asarray(v, dtype=float)
            mean = v if mean is None else (mean * n + v) / (n + 1)
            mean = mean / (np.sqrt((mean * mean).sum()) + eps)
            n += 1
        state = [mean.tolist(), n] if mean is not None else None
        return pd.DataFrame({key: [k[0]], "template": [state[0]], "count": [n]}) if n else pd.DataFrame(columns=out.fieldNames()), state

    steps = ordered_scan(df.select(key, F.col(order).alias("_at"), vec), [key], "_at", ["_at"], fold, out, forgets=False)
    return steps.groupBy(key).agg(F.max_by("template", "count").alias("template"), F.max("count").alias("count"))
