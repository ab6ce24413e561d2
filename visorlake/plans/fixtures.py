"""Views of the given tables in the shape of the operators' inputs.

Each text runs unchanged on Spark and on the checking engine, except `hash`, which has one per engine.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

VIEWS = {
    "samples": """
        SELECT o_orderkey AS sample_id, o_custkey AS video_id,
          CAST(15 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) AS INT) AS frame_idx,
          o_orderpriority AS source, CAST(640 AS INT) AS width, CAST(480 AS INT) AS height FROM orders""",
    "boxes": """
        SELECT sample_id, box_no, sample_id * 100 + box_no AS det_id, k, cls, x1, y1, x1 + w AS x2, y1 + h AS y2, w, h, conf FROM (
          SELECT l_orderkey AS sample_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS box_no, l_partkey AS k, CAST(l_suppkey % 3 AS INT) AS cls,
            CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST((l_suppkey * 7 + l_linenumber * 31) % 440 AS DOUBLE) AS y1,
            CAST(l_quantity AS DOUBLE) + 8 AS w, CAST((l_partkey + 3 * l_linenumber) % 40 + 8 AS DOUBLE) AS h,
            CAST((l_partkey * 37 + l_suppkey * 11) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS conf FROM lineitem) b""",
    "entities": """
        SELECT c_custkey AS entity,
          CASE WHEN c_custkey % 9 = 0 THEN 'Indoor+Outdoor' WHEN c_nationkey % 2 = 0 THEN 'Indoor' ELSE 'Outdoor' END AS domains,
          CAST(c_custkey * 13 % 47 + 1 AS INT) AS weight FROM customer""",
    "frames": """
        SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx,
          event_id, event_type AS cls_name, CAST(event_id % 3 AS INT) AS cls, CAST(event_id * 97 % 640 AS DOUBLE) AS x,
          CAST(event_id * 61 % 480 AS DOUBLE) AS y, CAST(event_id % 12 + 5 AS DOUBLE) AS r,
          CAST(event_id * 37 % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS conf, value FROM events""",
    # Six objects a frame that wander over their neighbours' places, on a grid, so that distances and overlaps tie; twelve frames are missing after every ten.
    "crowd": """
        SELECT video_id, CAST(j + floor(j / 10) * 12 AS INT) AS frame_idx, CAST(det_no AS INT) AS det_no, event_id, CAST(event_id % 2 AS INT) AS cls,
          CAST(200 + det_no * 40 + event_id * 97 % 5 * 10 AS DOUBLE) AS x, CAST(200 + event_id * 61 % 3 * 10 AS DOUBLE) AS y,
          CAST(event_id % 3 + 6 AS DOUBLE) AS r, event_id % 7 <> 0 AND j % 13 <> 5 AS shown FROM (
          SELECT video_id, event_id, CAST(floor(no / 6) AS BIGINT) AS j, no % 6 AS det_no FROM (
            SELECT CAST(floor(user_id / 4) AS BIGINT) AS video_id, event_id,
              row_number() OVER (PARTITION BY CAST(floor(user_id / 4) AS BIGINT) ORDER BY event_id) - 1 AS no FROM events) e1) e2""",
    "annotations": """
        SELECT o_orderkey AS id, o_custkey AS task_id, CAST(o_orderkey % 60 AS BIGINT) AS completed_by_id,
          CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS was_cancelled, o_orderdate AS updated_at FROM orders""",
    "tasks": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS project_id FROM customer",
    "projects": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation",
    "users": """
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS first_name,
          CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'L' END AS last_name,
          concat('u', CAST(s_suppkey AS VARCHAR(20)), '@example.com') AS email FROM supplier""",
}

# Two still scenes: the 13 low bits of an order number, each some places apart, over two patterns 18 bits apart.
_SPREAD = " + ".join(f"CAST(floor(v / {2 ** i}) AS BIGINT) % 2 * {2 ** (4 * i)}" for i in range(13))
VIEWS["scenes"] = f"""
    SELECT sample_id, scene, scene * 67253750426763264 + {_SPREAD} AS hash FROM (
      SELECT o_orderkey AS sample_id, o_custkey % 2 AS scene, o_orderkey * 7919 % 5003 AS v FROM orders) o"""

# Bit i of a hash is component i above the median of components 2 to 64; copies 1 to 3 of a vector differ from it
# in one to three bits. `lo` holds bits 0 to 31 and `hi` bits 32 to 63 of the BIGINT.
HASH_CHECK = """
    SELECT vec_id * 4 + c AS sample_id, vec_id,
      (CASE WHEN hi2 >= 2147483648 THEN hi2 - 4294967296 ELSE hi2 END) * 4294967296 + lo2 AS hash FROM (
      SELECT vec_id, c,
        CASE WHEN c >= 2 THEN xor(CASE WHEN c >= 1 THEN xor(lo, CAST(1 AS BIGINT) << CAST(vec_id % 16 AS INT)) ELSE lo END,
                                  CAST(1 AS BIGINT) << CAST(16 + vec_id % 16 AS INT))
             WHEN c >= 1 THEN xor(lo, CAST(1 AS BIGINT) << CAST(vec_id % 16 AS INT)) ELSE lo END AS lo2,
        CASE WHEN c >= 3 THEN xor(hi, CAST(1 AS BIGINT) << CAST(vec_id % 32 AS INT)) ELSE hi END AS hi2
      FROM (SELECT vec_id,
          CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > m THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INT) ELSE 0 END)) AS BIGINT) AS lo,
          CAST(list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > m THEN CAST(1 AS BIGINT) << CAST(i - 33 AS INT) ELSE 0 END)) AS BIGINT) AS hi
        FROM (SELECT vec_id, embedding, list_sort(embedding[2:64])[32] AS m FROM embeddings) e1) e2
      CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c) copies) h"""


def check_sql(text: str) -> str:
    """Replace `$name` by the view's text."""
    text = text.replace("$hash", f"({HASH_CHECK})")
    for name in sorted(VIEWS, key=len, reverse=True):
        text = text.replace(f"${name}", f"({VIEWS[name]})")
    return text


class Fixtures:
    """The given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for t in TABLES:
            text = text.replace(f"FROM {t}", f"FROM parquet.`{self.folder}/{t}.parquet`")
        return self.spark.sql(text)

    samples = cached_property(lambda self: self._view("samples"))
    entities = cached_property(lambda self: self._view("entities"))
    frames = cached_property(lambda self: self._view("frames"))
    annotations = cached_property(lambda self: self._view("annotations"))
    tasks = cached_property(lambda self: self._view("tasks"))
    projects = cached_property(lambda self: self._view("projects"))
    users = cached_property(lambda self: self._view("users"))
    scenes = cached_property(lambda self: self._view("scenes"))
    crowd = cached_property(lambda self: self._view("crowd"))

    @cached_property
    def boxes(self) -> DataFrame:
        """The rows of the view. They are numbered before the other columns are computed, so only what is read is shuffled, and a filter on samples comes first."""
        read = ["l_orderkey AS sample_id", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
        order = W.partitionBy("sample_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        b = self.table("lineitem").selectExpr(*read).withColumn("box_no", (F.row_number().over(order) - 1).cast("int"))
        b = b.selectExpr("sample_id", "box_no", "l_partkey AS k", "CAST(l_suppkey % 3 AS INT) AS cls", "CAST(l_partkey % 600 AS DOUBLE) AS x1",
                         "CAST((l_suppkey * 7 + l_linenumber * 31) % 440 AS DOUBLE) AS y1", "CAST(l_quantity AS DOUBLE) + 8 AS w",
                         "CAST((l_partkey + 3 * l_linenumber) % 40 + 8 AS DOUBLE) AS h",
                         "CAST((l_partkey * 37 + l_suppkey * 11) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS conf")
        return b.selectExpr("sample_id", "box_no", "sample_id * 100 + box_no AS det_id", "k", "cls", "x1", "y1", "x1 + w AS x2", "y1 + h AS y2", "w", "h", "conf")

    @cached_property
    def hashes(self) -> DataFrame:
        e = self.table("embeddings").withColumn("m", F.array_sort(F.slice("embedding", 2, 63))[31])

        def half(lo):
            return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda acc, i: acc + F.when(
                F.get("embedding", i + lo) > F.col("m"), F.expr("1L")).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2.0), i).cast("long"))

        def bit(n):
            return F.pow(F.lit(2.0), n).cast("long")

        v, c, none = F.col("vec_id"), F.col("c"), F.lit(0).cast("long")
        h = (e.select("vec_id", half(0).alias("lo"), half(32).alias("hi"), F.explode(F.array(*map(F.lit, range(4)))).alias("c"))
             .withColumns({"lo": F.col("lo").bitwiseXOR(F.when(c >= 1, bit(v % 16)).otherwise(none)).bitwiseXOR(F.when(c >= 2, bit(v % 16 + 16)).otherwise(none)),
                           "hi": F.col("hi").bitwiseXOR(F.when(c >= 3, bit(v % 32)).otherwise(none))}))
        return h.select((v * 4 + c).alias("sample_id"), "vec_id", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("hash"))

    @cached_property
    def points(self) -> DataFrame:
        """21 {x, y} landmarks from the first 42 components."""
        return self.table("embeddings").select("vec_id", "label", "embedding", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(
            F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y"))).alias("points"))

    @cached_property
    def scene(self) -> DataFrame:
        """Samples with their balls (class 0) and clubs (class 1) as arrays in box order."""
        b = self.boxes
        rect = F.struct(F.col("box_no"), F.struct("x1", "y1", "x2", "y2", "conf").alias("b"))
        per = b.groupBy("sample_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("cls") == c, rect))), lambda s: s["b"]).alias(n)
                                           for c, n in ((0, "balls"), (1, "clubs"))])
        return per

    @cached_property
    def live(self) -> DataFrame:
        """One ball per event frame, a club near it on every other frame, and small camera shifts."""
        f = self.frames
        ball = F.struct((F.col("x") - F.col("r")).alias("x1"), (F.col("y") - F.col("r")).alias("y1"), (F.col("x") + F.col("r")).alias("x2"),
                        (F.col("y") + F.col("r")).alias("y2"), F.col("conf"))
        club = F.struct((F.col("x") + 5).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 25).alias("x2"), (F.col("y") + 20).alias("y2"), F.col("conf"))
        e = F.col("event_id")
        cam = F.when(e % 13 != 0, F.array(F.lit(1.0), F.lit(0.0), (e % 5).cast("double"), F.lit(0.0), F.lit(1.0), (e % 3).cast("double")))
        no = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>")
        return f.withColumns({"balls": F.when(e % 7 != 0, F.array(ball)).otherwise(no), "clubs": F.when(e % 2 == 0, F.array(club)).otherwise(no), "cam": cam})
