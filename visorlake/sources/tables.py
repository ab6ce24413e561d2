"""Dataset configs, manifests, frame lists and the annotation tool's tables."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from visorlake.sources.labels import read_yolo_labels


def parse_dataset_config(text: str) -> dict:
    """Config text with `train`, `val` and `test` as lists and `names` as {id: name}."""
    doc = yaml.safe_load(text)
    base = (doc.get("path") or "").rstrip("/")
    out = dict(doc)
    for split in ("train", "val", "test"):
        roots = doc.get(split) or []
        roots = [roots] if isinstance(roots, str) else list(roots)
        out[split] = [r if r.startswith("/") or not base else f"{base}/{r}" for r in roots]
    names = doc.get("names") or {}
    out["names"] = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()}
    return out


def read_dataset_config(spark: SparkSession, path: str, kpts: int = 0) -> tuple[dict, DataFrame]:
    """The config and the labels of all its splits, one union with a `split` column."""
    with open(path) as f:
        conf = parse_dataset_config(f.read())
    parts = [read_yolo_labels(spark, "/labels".join(root.rsplit("/images", 1)), kpts).withColumn("split", F.lit(s))
             for s in ("train", "val", "test") for root in conf[s]]
    return conf, reduce(DataFrame.unionByName, parts)


def read_manifest(spark: SparkSession, path) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    out = df.select(*[F.trim(c).alias(c.strip()) for c in df.columns])
    kinds = {"videos": "int", "size_mb": "double", "minutes": "double"}
    return out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in out.columns})


def read_frame_list(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where(F.col("path") != "")


@dataclass
class AnnotationTables:
    annotations: DataFrame
    users: DataFrame
    projects: DataFrame | None
    has_time: bool
    tasks: DataFrame | None = None


# Preferred table names and the columns that identify each table.
WANTED = {
    "annotation": (["task_completion", "annotation", "tasks_annotation"], ["completed_by_id", "was_cancelled"]),
    "user": (["htx_user", "users_user", "auth_user"], ["email"]),
    "project": (["project"], ["id", "title"]),
    "task": (["task"], ["id", "project_id"]),
}


def _find(tables: dict[str, DataFrame], kind: str) -> DataFrame | None:
    preferred, columns = WANTED[kind]
    ordered = [n for n in preferred if n in tables] + sorted(n for n in tables if n not in preferred)
    return next((tables[n] for n in ordered if set(columns) <= set(tables[n].columns)), None)


def bind_annotation_tables(tables: dict[str, DataFrame]) -> AnnotationTables:
    """Find the annotation, user, project and task tables and give annotations a project and a time."""
    ann, users, projects, tasks = (_find(tables, k) for k in ("annotation", "user", "project", "task"))
    if ann is None or users is None:
        raise ValueError("no annotation or user table among: " + ", ".join(sorted(tables)))
    if "project_id" not in ann.columns:
        if tasks is None:
            raise ValueError("annotations carry no project and there is no task table")
        ann = ann.join(tasks.select(F.col("id").alias("task_id"), "project_id"), "task_id")
    time = next((c for c in ("updated_at", "created_at") if c in ann.columns), None)
    ann = ann.withColumn("_at", F.col(time) if time else F.lit(None).cast("timestamp"))
    names = ("first_name", "last_name")
    users = users.select("id", "email", *[F.col(c) if c in users.columns else F.lit(None).cast("string").alias(c)
                                          for c in names])
    return AnnotationTables(ann, users, projects, time is not None, tasks)
