"""Session settings and the shared checkpoint folder."""
from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "visorlake") -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _checkpoint_ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="visorlake-ckpt-")
    sc.setCheckpointDir(shared)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the files."""
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def _tables(spark: SparkSession) -> str:
    _checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle_table(df: DataFrame) -> DataFrame:
    """As `settle`, for loops: a table in the shared folder, whose real size is all that the optimizer knows of it.

    A checkpoint keeps the estimated size of the plan behind it. Estimates of joins multiply, so in a loop of joins the digits of that number double
    from round to round. The files go with the application.
    """
    spark = df.sparkSession
    path = _tables(spark)
    df.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables as those of `settle_table` that go when the block ends, and with them the shuffle files of what was computed in it.

    Spark keeps the files of a shuffle until the driver's next garbage collection after the last reference to it, which may be half an hour.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, _tables(spark), 0

    def __enter__(self) -> Scratch:
        files, at = _file_system(self.spark, self.path)
        files.deleteOnExit(at)
        return self

    def settle(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def free_shuffles(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __exit__(self, *error) -> None:
        files, at = _file_system(self.spark, self.path)
        files.delete(at, True)
        self.free_shuffles()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="visorlake-py-")) / package.name
    sc.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
    _shipped.add(sc.applicationId)
