"""Unions, differences and guarded mixes of sample sets."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from visorlake.functions.boxes import remap_classes
from visorlake.functions.names import stem
from visorlake.operators.sampling import sample_seeded


def union_sources(sources: dict[str, tuple[DataFrame, dict[int, int]]], id="sample_id") -> DataFrame:
    """Union of label tables with a provenance column, per-source class maps and prefixed ids."""
    parts = [remap_classes(df, m).withColumns({"origin": F.lit(name), id: F.concat(F.lit(f"{name}__"), F.col(id).cast("string"))})
             for name, (df, m) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def difference(a: DataFrame, b: DataFrame, path="path") -> DataFrame:
    """Rows of `a` whose file name does not occur in `b`."""
    return (a.withColumn("_base", stem(path)).join(b.select(stem(path).alias("_base")), "_base", "left_anti").drop("_base"))


def mix_with_cap(trusted: DataFrame, auto: DataFrame, frac: float = 0.5, seed: int = 0, id="sample_id") -> DataFrame:
    """Trusted rows plus so many automatic ones that they make up at most `frac` of the result."""
    if frac >= 1.0:
        return trusted.unionByName(auto)
    room = int(frac / (1 - frac) * max(trusted.count(), 1))
    return trusted.unionByName(sample_seeded(auto, room, seed, id) if room else auto.limit(0))


def merge_hand_over_auto(hand: DataFrame, auto: DataFrame, images: DataFrame, held_out: DataFrame | None = None,
                         id="sample_id", group="video_id") -> DataFrame:
    """Hand-labelled rows win; automatic rows only for other frames, with an image and outside held-out videos."""
    new = auto.join(hand.select(id), id, "left_anti").join(images.select(id), id, "left_semi")
    if held_out is not None:
        new = new.join(held_out.select(group).distinct(), group, "left_anti")
    return hand.withColumn("origin", F.lit("hand")).unionByName(new.withColumn("origin", F.lit("auto")))


def protect_class(samples: DataFrame, boxes: DataFrame, cls: int, group="video_id", id="sample_id") -> DataFrame:
    """Drop every sample of any video in which some sample has a box of the class."""
    marked = samples.join(boxes.where(F.col("cls") == cls).select(id), id, "left_semi").select(group).distinct()
    return samples.join(marked, group, "left_anti")
