"""Hard-example mining: recovered, promoted and confident boxes of a video set."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visorlake.functions.boxes import center_distance, of
from visorlake.operators.joins import temporal_support
from visorlake.operators.sampling import best_per_cell, cap_per_group, thin_by_gap
from visorlake.operators.signals import interpolate_boxes
from visorlake.operators.tracks import build_tracks
from visorlake.scale import span_of
from visorlake.session import settle

XY = ["x1", "y1", "x2", "y2"]
# Order of the tiers at equal confidence (the earlier label stays).
TIERS = ("recovered", "promoted", "confident")


def verify(expected: DataFrame, second: DataFrame, min_conf: float = 0.30, reach: float = 2.0) -> DataFrame:
    """The most confident second-look box of the class within `reach` diameters of each expected box."""
    again = second.where(F.col("conf") >= min_conf).select(
        "video_id", "frame_idx", "cls", F.col("conf").alias("v_conf"), *[F.col(c).alias(f"v_{c}") for c in XY])
    own = of()
    size = F.greatest((own("x2") - own("x1") + own("y2") - own("y1")) / 2, F.lit(8.0))
    hits = (expected.join(again, ["video_id", "frame_idx", "cls"])
            .where(center_distance(own, of("v_"), size) <= reach))
    best = F.max_by(F.struct(*[F.col(f"v_{c}").alias(c) for c in XY], F.col("v_conf").alias("conf")), "v_conf")
    keys = [c for c in expected.columns if c not in (*XY, "conf")]
    return hits.groupBy(*keys, *XY).agg(best.alias("_b")).select(*keys, *[f"_b.{c}" for c in (*XY, "conf")])


def mine_hard_examples(dets: DataFrame, second: DataFrame, fps: float = 30.0, stride: int = 2, conf_keep: float = 0.40,
                       verify_conf: float = 0.30, max_gap: int = 6, min_support: int = 1, support_win: int = 2,
                       sample_every: float = 1.5, cap_per_video: int = 0) -> DataFrame:
    """Labels worth reviewing, one row per box with its tier.

    `dets` and `second` (the verifying detections) hold video_id, frame_idx (processed frame number), cls,
    corners and conf; `dets` also det_no (within the frame) and a unique det_id. Steps: gaps in slow tracks
    filled where the second look agrees; low-confidence track boxes promoted where it agrees; confident
    supported frames sampled in time; with `cap_per_video`, so many earliest frames of a video; on those, every confident
    supported box as well.
    """
    frame = ["video_id", "frame_idx"]
    seen = dets.select(*frame).distinct()
    tracks = settle(build_tracks(dets))
    long_tracks = tracks.groupBy("video_id", "cls", "track_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select("video_id", "cls", "track_id")
    expected = interpolate_boxes(tracks, max_gap).join(seen, frame, "left_semi").select(*frame, "cls", *XY)
    recovered = verify(expected, second, verify_conf).withColumn("tier", F.lit("recovered"))
    weak = tracks.where(F.col("conf") < conf_keep).join(long_tracks, ["video_id", "cls", "track_id"], "left_semi").select(*frame, "cls", *XY)
    promoted = verify(weak, second, verify_conf).withColumn("tier", F.lit("promoted"))
    extra = settle(recovered.unionByName(promoted))
    sound = settle(temporal_support(dets, win=support_win).where((F.col("conf") >= conf_keep) & (F.col("support") >= min_support)))
    gap = max(1, int(round(sample_every * fps / stride)))
    sampled = thin_by_gap(sound.select(*frame).distinct(), gap)
    frames = extra.select(*frame).unionByName(sampled).distinct()
    kept = cap_per_group(frames, ["video_id"], ["frame_idx"], cap_per_video, slice_by=span_of("frame_idx"))
    confident = sound.select(*frame, "cls", *XY, "conf").withColumn("tier", F.lit("confident"))
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    labels = extra.unionByName(confident).join(kept, frame, "left_semi").withColumn("_tier", rank)
    tie = F.struct("_tier", *XY)
    return best_per_cell(labels.withColumn("_tie", tie), 8, tuple(frame), tie="_tie").drop("_tie", "_tier")


def mined_manifest(labels: DataFrame, stride: int = 2) -> DataFrame:
    """One row per kept frame: source frame, tiers and number of labels."""
    return labels.groupBy("video_id", "frame_idx").agg(
        F.array_join(F.array_sort(F.collect_set("tier")), "+").alias("tiers"), F.count(F.lit(1)).alias("n_labels")).withColumn(
        "src_frame", F.col("frame_idx") * stride)


def mining_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("frames"), F.count(F.lit(1)).alias("labels"),
                                          *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
