"""Equi-joins, bounded interval joins and per-frame matching."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from visorlake.functions.boxes import center_distance, iou, of
from visorlake.functions.vectors import cosine
from visorlake.scale import FRAME_SPAN, maybe_broadcast, ordered_scan, top_per_group, with_halo


def attach_images(labels: DataFrame, images: DataFrame, how: str = "inner", key="sample_id") -> DataFrame:
    """`inner`: labels without an image are dropped. `left`: from images, no label = background."""
    if how == "left":
        return images.join(labels, key, "left")
    return labels.join(images, key, "inner")


def missing_images(labels: DataFrame, images: DataFrame, key="sample_id") -> DataFrame:
    return labels.select(key).distinct().join(images.select(key), key, "left_anti")


def lookup_paths(annotations: DataFrame, index: DataFrame, key="sample_id") -> DataFrame:
    return annotations.join(index.select(key, "path"), key)


def assign_split_by_manifest(samples: DataFrame, manifest: DataFrame, default: str = "train") -> DataFrame:
    """Split of each sample's person; people missing from the manifest get `default`."""
    splits = maybe_broadcast(manifest.select("person", F.col("split").alias("_s")))
    out = samples.join(splits, "person", "left")
    return out.withColumns({"split": F.coalesce("_s", F.lit(default)), "matched": F.col("_s").isNotNull()}).drop("_s")


def unmatched_persons(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    return (samples.join(manifest.select("person"), "person", "left_anti")
            .groupBy("person").agg(F.count(F.lit(1)).alias("frames")))


def exclude_groups(df: DataFrame, used: DataFrame, key="video_id") -> DataFrame:
    """Rows whose group does not occur in `used` at all."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def skip_existing(df: DataFrame, *done: DataFrame, key="sample_id") -> DataFrame:
    """Rows that no earlier output holds."""
    for d in done:
        df = df.join(d.select(key), key, "left_anti")
    return df


def keep_known(df: DataFrame, keys: DataFrame, key="sample_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def pair_similarity(embeddings: DataFrame, key="key", id="id", vec="embedding", *, per_key: int,
                    n_keys: int) -> DataFrame:
    """Cosine of sampled same-key and different-key pairs.

    Keys with the most rows come first; `per_key` rows of each give the same-key pairs and the first row
    of each the different-key pairs, so the self-join sees at most `per_key * n_keys` rows.
    """
    sizes = embeddings.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    chosen = sizes.orderBy(F.desc("_n"), key).limit(n_keys).select(key)
    first = top_per_group(embeddings.join(F.broadcast(chosen), key, "left_semi"), [key], [F.col(id)],
                          per_key, name="rank").select(key, id, "rank", vec)
    a, b = first.alias("a"), first.alias("b")
    same = F.col(f"a.{key}") == F.col(f"b.{key}")
    pairs = a.join(b, F.col(f"a.{id}") < F.col(f"b.{id}"))
    return (pairs.where(same | ((F.col("a.rank") == 1) & (F.col("b.rank") == 1)))
            .select(F.col(f"a.{id}").alias("id_a"), F.col(f"b.{id}").alias("id_b"), same.alias("same"),
                    cosine(f"a.{vec}", f"b.{vec}").alias("cosine")))


def merge_detection_streams(a: DataFrame, b: DataFrame, b_class: int) -> DataFrame:
    """Two predictors' detections of the same frames; the second one always means `b_class`."""
    cols = [c for c in a.columns if c != "cls"]
    return (a.select(*cols, "cls", F.lit("a").alias("origin"))
            .unionByName(b.select(*cols, F.lit(b_class).alias("cls"), F.lit("b").alias("origin"))))


def temporal_support(dets: DataFrame, win: int = 2, radius: float = 6.0, frame="frame_idx",
                     det_id="det_id") -> DataFrame:
    """Number of neighbouring frames (within `win`) holding a box of the class close by, as `support`.

    Each detection is sent to the frames it may support, which turns the range join into an equi-join on
    (video, class, frame): a long video is spread over its frames.
    """
    offsets = F.array(*[F.lit(d) for d in range(-win, win + 1) if d])
    near = (dets.select("video_id", "cls", F.col(frame).alias("_k"), *[F.col(c).alias(f"n_{c}") for c in ("x1", "y1", "x2", "y2")])
            .withColumn("_off", F.explode(offsets))
            .withColumn(frame, (F.col("_k") + F.col("_off")).cast(dets.schema[frame].dataType)))
    own = of()
    size = F.greatest((own("x2") - own("x1") + own("y2") - own("y1")) / 2, F.lit(8.0))
    hits = (dets.join(near, ["video_id", "cls", frame])
            .where(center_distance(own, of("n_"), size) < radius)
            .groupBy(det_id).agg(F.bit_count(F.bit_or(F.expr(f"shiftleft(1, _off + {win})"))).alias("support")))
    return dets.join(hits, det_id, "left").withColumn("support", F.coalesce("support", F.lit(0)).cast("int"))


def drop_unsupported(dets: DataFrame, min_support: int = 1, **kw) -> DataFrame:
    return temporal_support(dets, **kw).where(F.col("support") >= min_support)


def _frames_after(hits: DataFrame, n: Column | int, hit="hit") -> DataFrame:
    """One row per hit and each of the next `n` frames, the hit frame included."""
    return hits.withColumn("frame_idx", F.explode(F.sequence(F.col(hit), F.col(hit) + F.lit(n - 1))))


def status_timeline(frames: DataFrame, hits: DataFrame, fps: float = 30.0) -> DataFrame:
    """HIT, FOLLOW or MADE PUTT after the earliest covering hit, else PREPARE when armed, else IDLE."""
    flash, follow = int(0.4 * fps), int(0.8 * fps)
    cover = (_frames_after(hits.select("video_id", "hit", "made"), flash + follow + 1)
             .groupBy("video_id", "frame_idx").agg(F.min_by(F.struct("hit", "made"), "hit").alias("_h")))
    status = (F.when(F.col("_h.made"), "MADE PUTT")
              .when(F.col("frame_idx") <= F.col("_h.hit") + flash, "HIT")
              .when(F.col("_h").isNotNull(), "FOLLOW")
              .when(F.col("armed"), "PREPARE").otherwise("IDLE"))
    return (frames.join(cover, ["video_id", "frame_idx"], "left")
            .withColumn("status", status).drop("_h"))


def made_putts(hits: DataFrame, track: DataFrame, holes: DataFrame, fps: float = 30.0,
               within_s: float = 2.5, slack: float = 0.35) -> DataFrame:
    """Mark hits whose tracked ball reaches a hole box widened by `slack` in time.

    `track` has x, y per frame and `holes` one corner box per row.
    """
    reach = _frames_after(hits.select("video_id", "hit"), int(within_s * fps))
    ex, ey = (F.col("x2") - F.col("x1")) * slack, (F.col("y2") - F.col("y1")) * slack
    inside = (F.col("x").between(F.col("x1") - ex, F.col("x2") + ex)
              & F.col("y").between(F.col("y1") - ey, F.col("y2") + ey))
    at = ["video_id", "frame_idx"]
    made = (reach.join(track.select(*at, "x", "y").where(F.col("x").isNotNull()), at)
            .join(holes.select(*at, "x1", "y1", "x2", "y2"), at).where(inside)
            .select("video_id", "hit").distinct().withColumn("_m", F.lit(True)))
    return (hits.join(made, ["video_id", "hit"], "left")
            .withColumn("made", F.coalesce("_m", F.lit(False))).drop("_m"))


def latest_event_asof(frames: DataFrame, hits: DataFrame, window: int, span: int = FRAME_SPAN) -> DataFrame:
    """Most recent hit at or before each frame, not older than `window` frames."""
    at = ["video_id", "frame_idx"]
    marks = hits.select("video_id", F.col("hit").alias("frame_idx"), F.col("hit").alias("_hit"))
    both = (frames.withColumn("_row", F.lit(True))
            .unionByName(marks.withColumn("_row", F.lit(False)), allowMissingColumns=True))
    w = (W.partitionBy("video_id", "_span").orderBy("frame_idx")
         .rangeBetween(-window, 0))
    return (with_halo(both, "frame_idx", back=window, span=span)
            .withColumn("last_hit", F.max("_hit").over(w))
            .where(F.col("_own") & F.col("_row")).drop("_span", "_own", "_row", "_hit"))


MATCH = T.StructType([T.StructField("clip_id", T.StringType()), T.StructField("fire", T.DoubleType()),
                      T.StructField("truth", T.DoubleType())])


def match_events(fires: DataFrame, truth: DataFrame, tol: float = 1.0) -> DataFrame:
    """One-to-one matching in fire order, with a verdict per fire and the missed truths.

    `fires`: clip_id, t. `truth`: clip_id, t, real (bool), closed (bool: the clip's list is complete).
    Each fire takes the first free real event within `tol`; the rest are FALSE near a known false event,
    EXTRA in a closed clip, or uncertain. Missed real events come as rows without a fire.
    """
    real = truth.where("real").select("clip_id", F.col("t").cast("double").alias("t"))
    feed = (fires.select("clip_id", F.col("t").cast("double").alias("t"), F.lit(1).alias("kind"),
                         F.col("t").cast("double").alias("at"))
            .unionByName(real.withColumns({"kind": F.lit(0), "at": F.col("t") - tol})))

    def fold(key, state, rows: pd.DataFrame):
        waiting, out = list(state or []), []
        for t, kind in zip(rows["t"], rows["kind"]):
            if kind == 0:
                waiting.append(float(t))
                continue
            waiting = [x for x in waiting if x >= t - tol]
            hit = waiting.pop(0) if waiting and waiting[0] <= t + tol else None
            out.append((key[0], float(t), hit))
        return pd.DataFrame(out, columns=MATCH.fieldNames()), waiting

    feed = feed.withColumn("clip_id", F.col("clip_id").cast("string"))
    matched = ordered_scan(feed, ["clip_id"], "at", ["at", "kind", "t"], fold, MATCH, span=3600,
                           warmup=int(60 + 4 * tol))
    texts = F.col("clip_id").cast("string").alias("clip_id")
    bucket = F.floor(F.col("t") / tol)
    decoys = (truth.where(~F.col("real")).select(texts, F.col("t").alias("_ft"))
              .withColumn("_b", F.explode(F.array(*[F.floor(F.col("_ft") / tol) + d for d in (-1, 0, 1)]))))
    wrong = (matched.where("truth IS NULL").withColumn("_b", F.floor(F.col("fire") / tol))
             .join(decoys, ["clip_id", "_b"]).where(F.abs(F.col("fire") - F.col("_ft")) <= tol)
             .select("clip_id", "fire").distinct().withColumn("_wrong", F.lit(True)))
    closed = truth.groupBy(texts).agg(F.bool_or("closed").alias("_closed"))
    verdict = (F.when(F.col("truth").isNotNull(), "ok").when(F.col("_wrong"), "FALSE")
               .when(F.col("_closed"), "EXTRA").otherwise("uncertain"))
    judged = (matched.join(wrong, ["clip_id", "fire"], "left").join(closed, "clip_id", "left")
              .select("clip_id", "fire", "truth", verdict.alias("verdict")))
    missed = (real.select(texts, F.col("t").alias("truth"))
              .join(matched.where("truth IS NOT NULL").select("clip_id", "truth"), ["clip_id", "truth"], "left_anti")
              .select("clip_id", F.lit(None).cast("double").alias("fire"), "truth", F.lit("missed").alias("verdict")))
    return judged.unionByName(missed)


def join_modulo(samples: DataFrame, annotations: DataFrame, n: int, index="idx", ann_index="idx") -> DataFrame:
    """Sample i takes annotation i mod n."""
    ann = annotations.withColumnRenamed(ann_index, "ann_idx")
    return samples.withColumn("ann_idx", F.pmod(F.col(index), F.lit(n))).join(ann, "ann_idx")


def nearest_object(frames: DataFrame, a="balls", b="clubs") -> DataFrame:
    """For each `a` box of a frame the nearest `b` box: index and distance in `a` diameters."""
    def mid(r, lo, hi):
        return (r[lo] + r[hi]) / 2

    def nearest(p):
        gaps = F.transform(b, lambda q, i: F.struct(
            F.sqrt((mid(q, "x1", "x2") - mid(p, "x1", "x2")) ** 2
                   + (mid(q, "y1", "y2") - mid(p, "y1", "y2")) ** 2).alias("d"), i.alias("i")))
        best = F.array_min(gaps)
        size = (p["x2"] - p["x1"] + p["y2"] - p["y1"]) / 2
        return F.struct(best["i"].alias("index"), best["d"].alias("px"), (best["d"] / size).alias("diameters"))

    return frames.withColumn("nearest", F.transform(a, nearest))


def context_distance(frames: DataFrame, balls="balls", clubs="clubs") -> DataFrame:
    """Distance of the nearest ball to the most confident club head, in club diagonals.

    Null without a club, 99 without a ball.
    """
    ranked = F.transform(clubs, lambda c, i: F.struct(c["conf"].alias("conf"), (-i).alias("i"), c.alias("box")))
    top = F.array_max(ranked)["box"]
    diag = F.greatest(F.sqrt((top["x2"] - top["x1"]) ** 2 + (top["y2"] - top["y1"]) ** 2), F.lit(1e-4))
    gaps = F.transform(balls, lambda b: F.sqrt(
        ((top["x1"] + top["x2"]) / 2 - (b["x1"] + b["x2"]) / 2) ** 2
        + ((top["y1"] + top["y2"]) / 2 - (b["y1"] + b["y2"]) / 2) ** 2) / diag)
    return frames.withColumn("context", F.when(top.isNotNull(), F.coalesce(F.array_min(gaps), F.lit(99.0))))


def assign_detection_to_track(dets: DataFrame, tracks: DataFrame, min_iou: float = 0.5,
                              keys=("video_id", "frame_idx"), det_id="det_id") -> DataFrame:
    """Best-overlapping track of the same frame for each detection above `min_iou`."""
    ts = tracks.select(*keys, "track_id", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    scored = dets.join(ts, list(keys)).withColumn("iou", iou(of(), of("t_"))).where(F.col("iou") > min_iou)
    return scored.groupBy(*keys, det_id).agg(
        F.min_by("track_id", F.struct(-F.col("iou"), "track_id")).alias("track_id"), F.max("iou").alias("iou"))
