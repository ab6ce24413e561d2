"""Per-frame detection caches, camera motion, image and media listings."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from visorlake.functions.names import flat_name, safe_id, stem
from visorlake.scale import python_tasks

DET_CACHE = ("fps double, frames array<struct<b: array<array<double>>, c: array<array<double>>, "
             "h: array<array<double>>>>")
RECTS = "array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>"


def _rects(col):
    rows = F.transform(F.coalesce(col, F.array().cast("array<array<double>>")), lambda b: F.struct(
        b[0].alias("x1"), b[1].alias("y1"), b[2].alias("x2"), b[3].alias("y2"),
        F.get(b, F.lit(4)).alias("conf")))
    return rows.cast(RECTS)


def parse_detection_cache(df: DataFrame, text="value") -> DataFrame:
    """`{"fps", "frames": [{"b", "c", "h"}]}` to one row per frame."""
    doc = df.withColumn("_d", F.from_json(text, DET_CACHE)).drop(text).withColumn("fps", F.col("_d.fps"))
    rows = doc.select("*", F.posexplode("_d.frames").alias("frame_idx", "_f")).drop("_d")
    return rows.withColumns({"balls": _rects(F.col("_f.b")), "clubs": _rects(F.col("_f.c")),
                             "holes": _rects(F.col("_f.h"))}).drop("_f")


def read_detection_cache(spark: SparkSession, path) -> DataFrame:
    files = (spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(stem("_metadata.file_path").alias("video_id"), "value"))
    return parse_detection_cache(files)


def read_affines(spark: SparkSession, path) -> DataFrame:
    """Camera matrices per frame; entry i - 1 of the file moves frame i - 1 to frame i."""
    files = (spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(stem("_metadata.file_path").alias("video_id"), "value"))
    return (files.select("video_id", F.posexplode(F.from_json("value", "array<array<double>>")).alias("_i", "cam"))
            .select("video_id", (F.col("_i") + 1).alias("frame_idx"), "cam"))


def attach_affines(frames: DataFrame, cams: DataFrame) -> DataFrame:
    return frames.join(cams, ["video_id", "frame_idx"], "left")


def read_images(spark: SparkSession, root, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Recursive image table with decoded pixels; unreadable files are dropped."""
    return (spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root)
            .select(stem("image.origin").alias("sample_id"), F.col("image.origin").alias("path"),
                    F.col("image.width").alias("width"), F.col("image.height").alias("height"), "image"))


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height that the header of a PNG, GIF, BMP or JPEG file states; None for anything else."""
    number = lambda at, n, order: int.from_bytes(data[at:at + n], order)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return number(16, 4, "big"), number(20, 4, "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return number(6, 2, "little"), number(8, 2, "little")
    if data[:2] == b"BM" and len(data) >= 26:
        tall = int.from_bytes(data[22:26], "little", signed=True)              # negative: rows from the top
        return number(18, 4, "little"), abs(tall)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:               # padding and marks without a length
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):          # a frame header
            return number(at + 7, 2, "big"), number(at + 5, 2, "big")
        else:
            at += 2 + number(at + 2, 2, "big")
    return None


def image_index(spark: SparkSession, root: str | list[str], glob: str = "*.{jpg,jpeg,png}", nested: bool = False) -> DataFrame:
    """Columns sample_id, path, width, height of the images below one or more roots. Sizes come from the headers, no pixel is decoded; files
    without a readable header are dropped.

    An id is the file's stem. With `nested` it is the path below the root, joined by `__`, and with several roots the root's name before it, so equal
    stems in different folders stay apart.
    """
    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        found = [header_size(c) or (None, None) for c in content]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    roots = [root] if isinstance(root, str) else list(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    below = [F.nullif(F.regexp_extract("path", re.escape(r.rstrip("/")) + r"/+(.*)$", 1), F.lit("")) for r in roots]
    names = below if len(roots) == 1 else [F.concat(F.lit(r.rstrip("/").rsplit("/", 1)[-1] + "/"), b) for r, b in zip(roots, below, strict=True)]
    name = flat_name(F.coalesce(*names)) if nested else stem("path")
    return (files.select(name.alias("sample_id"), "path", size("content").alias("_s")).where("_s.width IS NOT NULL")
            .select("sample_id", "path", "_s.width", "_s.height"))


def read_media_catalog(spark: SparkSession, root: str, min_bytes: int = 1_000_000,
                       exts: tuple[str, ...] = ("mp4",), skip: tuple[str, ...] = ("_template_folder",)) -> DataFrame:
    """Video files under `root/<domain>/<person>/...`; file contents are never read.

    Spark deals files to tasks by what opening one costs, some thirty a task; as none is opened, they are put together again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.coalesce(python_tasks(files))
    rel = F.regexp_extract("path", re.escape(root.rstrip("/")) + r"/+(.*)$", 1)
    parts = F.split("rel", "/")
    named = (files.where(F.lower("path").rlike(r"\.(" + "|".join(exts) + r")$") & (F.col("length") >= min_bytes))
             .withColumn("rel", rel))
    return (named.withColumns({"video_id": safe_id("rel"),
                               "domain": F.when(F.size(parts) > 2, parts[0]),
                               "person": F.when(F.size(parts) > 2, F.trim(parts[1]))})
            .where(F.col("person").isNull() | ~F.col("person").isin(*skip)))
