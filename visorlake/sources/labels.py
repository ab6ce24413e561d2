"""Readers for label and annotation files.

Formats that are one document per file are read whole by Spark and parsed with JVM expressions; the
line-oriented block format stays splittable.
"""
from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from visorlake.functions.boxes import keypoints_reshape, polygon_to_box
from visorlake.functions.names import image_name_from_url, stem
from visorlake.scale import running_sum
from visorlake.schemas import ANNOTATION_MAP


def _whole(spark: SparkSession, path, glob: str) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .text(paths, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value")))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def parse_yolo_text(df: DataFrame, text="value", kpts: int = 0) -> DataFrame:
    """Rows of `cls cx cy w h [x y v ...]`. A file without a usable line stays as one row of nulls."""
    least = 5 + 3 * kpts
    parsed = F.filter(F.transform(F.split(text, r"\r?\n"), _tokens), lambda t: F.size(t) >= least)
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode_outer(parsed).alias("box_no", "_t"))
    t = F.col("_t")
    out = rows.withColumns({"cls": t[0].try_cast("double").try_cast("int"),
                            "cx": t[1].cast("double"), "cy": t[2].cast("double"),
                            "w": t[3].cast("double"), "h": t[4].cast("double")})
    if kpts:
        nums = F.transform(F.slice(t, 6, 3 * kpts), lambda v: v.cast("double"))
        out = out.withColumn("keypoints", F.when(t.isNotNull(), keypoints_reshape(nums, kpts)))
    return out.drop("_t")


def _store(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _empty(spark: SparkSession, path, ext: str) -> DataFrame:
    """Files of length zero, which Spark's readers leave out. Folders below the roots are listed by the tasks."""
    folders = []
    for root in [path] if isinstance(path, str) else path:
        store, base = _store(root)
        below = [i.base_name for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
        folders += [(root.rstrip("/"), False)] + [(f"{root.rstrip('/')}/{name}", True) for name in below]

    def scan(parts):
        for pdf in parts:
            for root, deep in zip(pdf["root"], pdf["deep"]):
                store, base = _store(root)
                found = store.get_file_info(fs.FileSelector(base, recursive=bool(deep)))
                empty = [str(i.path) for i in found if i.type == fs.FileType.File and i.size == 0 and i.path.endswith(ext)]
                if empty:
                    yield pd.DataFrame({"path": np.array(empty, dtype=object)})

    rows = spark.createDataFrame(folders, "root string, deep boolean")
    return rows.repartition(min(len(folders), 1000)).mapInPandas(scan, "path string").withColumn("value", F.lit(""))


def read_yolo_labels(spark: SparkSession, path, kpts: int = 0) -> DataFrame:
    """Label files under `path`; an empty file is a background sample."""
    files = _whole(spark, path, "*.txt").unionByName(_empty(spark, path, ".txt"))
    return parse_yolo_text(files.withColumn("sample_id", stem("path")), kpts=kpts)


def read_block_gt(spark: SparkSession, path) -> DataFrame:
    """Blocks of a path line, a count line and that many box lines, as one row per box.

    Images with count 0 stay as one row without a box. The file may be split across tasks: lines are
    ordered by file block and position, and block numbers are prefix sums over the file blocks.
    """
    lines = (spark.read.text(path)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"), F.trim("value").alias("value"))
             .where(F.col("value") != ""))
    numeric = F.forall(_tokens(F.col("value")), lambda t: t.try_cast("double").isNotNull())
    marked = running_sum(lines, ["file"], [F.col("_line")], F.col("_block"),
                         (~numeric).cast("long"), "block_no")
    w = W.partitionBy("file", "block_no").orderBy("_block", "_line")
    placed = marked.withColumns({
        "rel_path": F.first("value").over(w),
        "_n": F.nth_value("value", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).cast("int"),
        "_pos": F.row_number().over(w) - 2})
    t = _tokens(F.col("value"))
    is_box = (F.col("_pos") >= 1) & (F.col("_pos") <= F.col("_n"))
    placeholder = (F.col("_pos") == 0) & (F.col("_n") == 0)
    return (placed.where((is_box & (F.size(t) >= 4)) | placeholder)
            .select("file", "rel_path", stem("rel_path").alias("sample_id"),
                    F.when(is_box, F.col("_pos") - 1).cast("int").alias("box_no"),
                    *[F.when(is_box, t[i].cast("double")).alias(n)
                      for i, n in enumerate(("x1", "y1", "w", "h"))]))


def parse_annotation_map(df: DataFrame, text="value") -> DataFrame:
    """`{uuid: {bboxes, hand_landmarks, user_id}}` to one row per sample."""
    return (df.select(*[c for c in df.columns if c != text],
                      F.explode(F.from_json(text, ANNOTATION_MAP)).alias("sample_id", "a"))
            .select("*", "a.bboxes", "a.hand_landmarks", "a.user_id").drop("a"))


def read_annotation_map(spark: SparkSession, path) -> DataFrame:
    return parse_annotation_map(_whole(spark, path, "*.json").withColumn("group", stem("path")))


def image_dims(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2:at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack(">HH", data[at + 5:at + 9])
            return wide, high
        at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def header_size(data: pd.Series) -> pd.DataFrame:
    dims = [image_dims(bytes(d)) if d is not None else None for d in data]
    return pd.DataFrame({"width": [d[0] if d else None for d in dims],
                         "height": [d[1] if d else None for d in dims]}).astype("Int32")


def read_coco_parquet(spark: SparkSession, path, cls: int = 0, limit: int = 0) -> DataFrame:
    """Nested `image` and `objects.bbox` (or `bboxes`) rows to normalised centre boxes."""
    df = spark.read.parquet(path)
    fields = df.schema["objects"].dataType.fieldNames()
    boxes = F.coalesce(*[F.col(f"objects.{f}") for f in ("bbox", "bboxes") if f in fields])
    sound = F.filter(boxes, lambda b: (b[2] > 0) & (b[3] > 0))
    bytes_col = F.col("image.bytes") if isinstance(df.schema["image"].dataType, T.StructType) else F.col("image")
    rows = df.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.row_index").alias("row_no"),
                     bytes_col.alias("_bytes"), sound.alias("_boxes")).where(F.size("_boxes") > 0)
    sized = (rows.withColumn("_dim", header_size("_bytes")).drop("_bytes")
             .where(F.col("_dim.width").isNotNull())
             .withColumn("sample_id", F.format_string("%s_%06d", stem("path"), "row_no")))
    if limit:
        sized = sized.orderBy("path", "row_no").limit(limit)
    b, wide, high = F.col("_b"), F.col("_dim.width"), F.col("_dim.height")
    return (sized.select("sample_id", "path", "_dim", F.posexplode("_boxes").alias("box_no", "_b"))
            .select("sample_id", "path", "box_no", F.lit(cls).alias("cls"),
                    ((b[0] + b[2] / 2) / wide).alias("cx"), ((b[1] + b[3] / 2) / high).alias("cy"),
                    (b[2] / wide).alias("w"), (b[3] / high).alias("h"),
                    wide.alias("width"), high.alias("height")))


QUAD_JSON = "size array<int>, objects array<struct<data: array<array<double>>, tags: array<string>>>"


def parse_quad_json(df: DataFrame, text="value", qr_cls: int = 0, other_cls: int = 1) -> DataFrame:
    """Objects of at least three points; the class follows from any tag that contains `qr`."""
    doc = df.withColumn("_d", F.from_json(text, QUAD_JSON)).drop(text)
    objs = (doc.withColumns({"width": F.get("_d.size", F.lit(0)), "height": F.get("_d.size", F.lit(1))})
            .select("*", F.posexplode("_d.objects").alias("box_no", "_o")).drop("_d")
            .where(F.size("_o.data") >= 3))
    qr = F.exists(F.coalesce(F.col("_o.tags"), F.array()), lambda t: F.lower(t).contains("qr"))
    pts = F.transform("_o.data", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return polygon_to_box(objs.withColumn("points", pts)
                          .withColumn("cls", F.when(qr, qr_cls).otherwise(other_cls)).drop("_o"))


def read_quad_json(spark: SparkSession, path, qr_cls: int = 0, other_cls: int = 1) -> DataFrame:
    files = _whole(spark, path, "*.json").withColumn("sample_id", stem(stem("path")))
    return parse_quad_json(files, qr_cls=qr_cls, other_cls=other_cls)


def parse_polygon_text(df: DataFrame, text="value") -> DataFrame:
    """All numbers of a file, eight to a quad; comment lines and words are skipped."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: ~F.trim(s).startswith("#"))
    nums = F.filter(F.transform(F.split(F.array_join(lines, " "), r"\s+"), lambda t: t.try_cast("double")),
                    lambda v: v.isNotNull())
    n = F.floor(F.size("_n") / 8).cast("int")
    quads = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
            F.get(F.col("_n"), q * 8 + i * 2).alias("x"), F.get(F.col("_n"), q * 8 + i * 2 + 1).alias("y")))))
    out = (df.withColumn("_n", nums).drop(text).withColumn("_q", quads)
           .select("*", F.posexplode("_q").alias("box_no", "points")).drop("_n", "_q"))
    return polygon_to_box(out).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def read_polygon_txt(spark: SparkSession, path) -> DataFrame:
    files = _whole(spark, path, "*.txt").withColumn("sample_id", stem("path"))
    return parse_polygon_text(files.where(~F.lower(F.element_at(F.split("path", "/"), -1)).contains("note")))


def parse_calibration(k_docs: DataFrame, xyz_docs: DataFrame, doc="doc") -> DataFrame:
    """Camera matrices and joints of documents that each hold one JSON array, matched by position."""
    def entries(docs, name):
        return docs.select(doc, F.posexplode(F.from_json("value", "array<array<array<double>>>")).alias("idx", name))

    return entries(k_docs, "k").join(entries(xyz_docs, "xyz"), [doc, "idx"])


def read_calibration(spark: SparkSession, k_path: str, xyz_path: str) -> DataFrame:
    k, xyz = (spark.read.text(p, wholetext=True).withColumn("doc", F.lit(0)) for p in (k_path, xyz_path))
    return parse_calibration(k, xyz).drop("doc")


EXPORT = ("id bigint, data struct<image: string>, annotations array<struct<was_cancelled: boolean, "
          "completed_by: bigint, result: array<struct<type: string, value: struct<x: double, y: double, "
          "width: double, height: double, rectanglelabels: array<string>>>>>>")


def parse_annotation_export(tasks: DataFrame, names: list[str]) -> DataFrame:
    """First live annotation of each task as rectangles in percent; an empty one is a negative row.

    Tasks without a live annotation are not samples; `export_report` counts them.
    """
    live = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    index = F.create_map(*[F.lit(v) for kv in ((n, i) for i, n in enumerate(names)) for v in kv])
    first = tasks.withColumn("_live", live).where(F.size("_live") > 0).withColumn("_r", F.get("_live", F.lit(0))["result"])
    boxes = F.filter("_r", lambda r: (r["type"] == "rectanglelabels")
                     & F.array_contains(F.array(*map(F.lit, names)), F.get(r["value"]["rectanglelabels"], F.lit(0))))
    name = image_name_from_url("data.image")
    v = F.col("_b.value")
    return (first.select(name.alias("image"), stem(name).alias("sample_id"),
                         F.posexplode_outer(boxes).alias("box_no", "_b"))
            .select("sample_id", "image", "box_no", index[v["rectanglelabels"][0]].alias("cls"),
                    v["x"].alias("px"), v["y"].alias("py"), v["width"].alias("pw"), v["height"].alias("ph")))


def read_annotation_export(spark: SparkSession, path, names: list[str], lines: bool = False) -> DataFrame:
    """`lines=True` reads one task per line, which Spark can split; otherwise one JSON array per file."""
    reader = spark.read.schema(EXPORT)
    return parse_annotation_export((reader if lines else reader.option("multiLine", True)).json(path), names)


def export_report(tasks: DataFrame) -> DataFrame:
    live = F.exists("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(live).alias("labeled"),
                     F.count_if(~F.coalesce(live, F.lit(False))).alias("skipped"))
