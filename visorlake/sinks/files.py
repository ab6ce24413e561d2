"""Writers for label files, annotation tasks, manifests and split datasets."""
from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from visorlake.functions.boxes import clip
from visorlake.scale import maybe_broadcast, python_tasks


def six(c: Column) -> Column:
    """Six decimals, rounded like the reference text format."""
    return F.regexp_replace(F.format_number(c, 6), ",", "")


def yolo_lines(boxes: DataFrame, samples: DataFrame, key="sample_id", order="box_no",
               cols=("cls", "cx", "cy", "w", "h")) -> DataFrame:
    """One label text per sample; samples without boxes get an empty one."""
    cls, *nums = cols
    line = F.concat_ws(" ", F.col(cls).cast("string"), *[six(F.col(c)) for c in nums])
    if "keypoints" in boxes.columns:
        pts = F.transform("keypoints", lambda p: F.concat_ws(" ", six(p["x"]), six(p["y"]), p["v"].cast("string")))
        line = F.concat_ws(" ", line, F.array_join(pts, " "))
    texts = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda s: s["line"]), "\n")
    return (samples.select(key).join(texts, key, "left")
            .select(key, F.coalesce(F.concat(body, F.lit("\n")), F.lit("")).alias("text")))


def polygon_lines(polys: DataFrame, key="sample_id", order="poly_no") -> DataFrame:
    """`cls x1 y1 x2 y2 ...` for polygons of at least three points."""
    pts = F.flatten(F.transform("points", lambda p: F.array(six(p["x"]), six(p["y"]))))
    line = F.concat_ws(" ", F.col("cls").cast("string"), F.array_join(pts, " "))
    rows = (polys.where(F.size("points") >= 3).groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("_l")))
    return rows.select(key, F.concat(F.array_join(F.transform("_l", lambda s: s["line"]), "\n"),
                                     F.lit("\n")).alias("text"))


def write_each(df: DataFrame, root: str, name="sample_id", text="text", ext=".txt") -> None:
    """One text or binary file per row, from the executors; names may lead into folders. A retried task rewrites the same files.

    A file takes far longer than its bytes say, so rows are dealt to a given number of tasks.
    """
    def put(rows: Iterator) -> None:
        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        store.create_dir(base, recursive=True)
        made = set()
        for row in rows:
            folder = str(row[name]).rpartition("/")[0]
            if folder and folder not in made:
                store.create_dir(f"{base}/{folder}", recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{base}/{row[name]}{ext}") as f:
                f.write(row[text].encode() if isinstance(row[text], str) else bytes(row[text]))

    df.select(name, text).repartition(python_tasks(df)).foreachPartition(put)


def write_yolo_labels(boxes: DataFrame, samples: DataFrame, path: str) -> None:
    write_each(yolo_lines(boxes, samples), path)


def write_polygons(polys: DataFrame, path: str) -> None:
    write_each(polygon_lines(polys), path)


def annotation_tasks(boxes: DataFrame, samples: DataFrame, names: list[str], model_version: str,
                     prefix: str = "/data/local-files/?d=images/") -> DataFrame:
    """Task documents with pre-annotated rectangles in percent. `samples` has sample_id, width, height."""
    label = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("cls")), F.col("cls").cast("string"))

    def pct(c):
        return clip(c * 100, 0.0, 100.0)

    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    result = F.struct(
        F.concat(F.lit("p"), F.col("box_no").cast("string")).alias("id"),
        F.lit("rectanglelabels").alias("type"), F.lit("label").alias("from_name"),
        F.lit("image").alias("to_name"), F.col("width").alias("original_width"),
        F.col("height").alias("original_height"), F.lit(0).alias("image_rotation"),
        F.struct(pct(cx - w / 2).alias("x"), pct(cy - h / 2).alias("y"), pct(w).alias("width"),
                 pct(h).alias("height"), F.lit(0).alias("rotation"),
                 F.array(label).alias("rectanglelabels")).alias("value"))
    joined = samples.select("sample_id", "width", "height").join(boxes, "sample_id", "left")
    grouped = joined.groupBy("sample_id").agg(F.array_sort(F.collect_list(
        F.when(F.col("box_no").isNotNull(), F.struct(F.col("box_no").alias("n"), result.alias("r"))))).alias("_r"))
    return grouped.select(
        F.struct(F.concat(F.lit(prefix), F.col("sample_id").cast("string"), F.lit(".jpg")).alias("image")).alias("data"),
        F.array(F.struct(F.lit(model_version).alias("model_version"),
                         F.transform("_r", lambda s: s["r"]).alias("result"))).alias("predictions"))


def write_annotation_tasks(boxes, samples, path: str, names: list[str], model_version: str,
                           prefix: str = "/data/local-files/?d=images/") -> None:
    annotation_tasks(boxes, samples, names, model_version, prefix).write.mode("overwrite").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split_dataset(samples: DataFrame, boxes: DataFrame, path: str, by: tuple[str, ...] = ("split",)) -> None:
    """Path references and boxes by split (or split and label folder); images are not copied."""
    samples.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/images")
    splits = samples.select("sample_id", *by)
    (boxes.join(maybe_broadcast(splits), "sample_id").write.mode("overwrite")
     .partitionBy(*by).parquet(f"{path}/labels"))


def write_image_lists(samples: DataFrame, path: str, names: dict[int, str], title: str = "dataset") -> str:
    """`train.txt` and `val.txt` folders of image paths plus the dataset config text."""
    for split in ("train", "val"):
        samples.where(F.col("split") == split).select("path").write.mode("overwrite").text(f"{path}/{split}.txt")
    config = (f"train: {path}/train.txt\nval: {path}/val.txt\nnames:\n"
              + "".join(f"  {i}: {n}\n" for i, n in sorted(names.items())))
    store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with store.open_output_stream(f"{base}/{title}.yaml") as f:
        f.write(config.encode())
    return config
