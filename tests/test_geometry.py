"""Inverse pairs, invariants and edge cases of the column functions."""
import math
import random

import pytest
from pyspark.sql import functions as F

from visorlake.functions import boxes as B, decode as D, names as N, vectors as V
from visorlake.functions.register import register_functions

POINTS = "array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def rects(spark):
    rng = random.Random(1)
    rows = [(i, *sorted((rng.uniform(0, 600), rng.uniform(0, 600))), *sorted((rng.uniform(0, 400), rng.uniform(0, 400)))) for i in range(200)]
    return spark.createDataFrame([(i, a, c, b, d, 640 + i % 5 * 100, 480) for i, a, b, c, d in rows],
                                 "id int, x1 double, y1 double, x2 double, y2 double, width int, height int")


def close(df, names, other):
    gap = sum((F.abs(F.col(n) - F.col(f"{other}{n}")) for n in names), F.lit(0.0))
    return df.agg(F.max(gap)).first()[0] < 1e-9


def keep(df):
    return df.withColumns({f"o_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")})


def test_inverse_pairs(rects):
    xy = ("x1", "y1", "x2", "y2")
    assert close(B.unletterbox(B.letterbox(keep(rects), 512), 512), xy, "o_")
    centred = B.box_xyxy_to_center(keep(rects)).where("cx IS NOT NULL")
    assert close(B.box_center_to_xyxy(centred), xy, "o_")
    c = centred.withColumns({f"o_{n}": F.col(n) for n in ("cx", "cy", "bw", "bh")})
    assert close(B.box_from_percent(B.box_to_percent(c)), ("cx", "cy", "bw", "bh"), "o_")


def test_distance_features_ignore_rotation_and_mirroring(spark):
    rng = random.Random(2)
    pts = [(rng.random(), rng.random()) for _ in range(21)]
    a = math.radians(73)
    turned = [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in pts]
    df = spark.createDataFrame([(pts, turned, [(-x, y) for x, y in pts])], f"a {POINTS}, b {POINTS}, c {POINTS}")
    a, b, c = df.select(*[V.pairwise_distance_features(n).alias(n) for n in "abc"]).first()
    assert len(a) == 210 and max(abs(x - y) for x, y in zip(a, b)) < 1e-9 and max(abs(x - y) for x, y in zip(a, c)) < 1e-9


def test_similarity_recovers_a_known_transform(spark):
    src = [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (2.0, 5.0)]
    dst = [(2 * x - 1 * y + 7, 1 * x + 2 * y - 3) for x, y in src]
    df = spark.createDataFrame([(src, dst), ([(1.0, 1.0)] * 4, dst)], f"s {POINTS}, d {POINTS}")
    good, bad = [r.m for r in df.select(B.fit_similarity("s", "d").alias("m")).collect()]
    assert tuple(good) == pytest.approx((2.0, 1.0, 7.0, -3.0)) and bad is None


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([([(0.1, 0.2, 1), (0.7, 0.4, 0), (0.5, 0.9, 1)],)], "k array<struct<x:double,y:double,v:int>>")
    twice = B.keypoints_flip(B.keypoints_flip("k", [1, 0, 2]), [1, 0, 2])
    k, t = df.select("k", twice.alias("t")).first()
    assert [tuple(p) for p in t] == [pytest.approx(tuple(p)) for p in k]


def test_composed_affine_equals_two_steps(spark):
    df = spark.createDataFrame([([1.1, 0.2, 3.0, -0.1, 0.9, 2.0], [0.8, 0.0, 1.0, 0.3, 1.2, -4.0], 5.0, 6.0), (None, [0.8, 0.0, 1.0, 0.3, 1.2, -4.0], 5.0, 6.0)],
                               "p array<double>, q array<double>, x double, y double")
    x, y = B.affine_apply("p", F.col("x"), F.col("y"))
    two = B.affine_apply("q", x, y)
    one = B.affine_apply(B.affine_compose(F.col("p"), F.col("q")), F.col("x"), F.col("y"))
    for r in df.select(*two, *one).collect():
        assert (r[0], r[1]) == pytest.approx((r[2], r[3]))


def test_names(spark):
    df = spark.createDataFrame([("d_Joy_clip_f000030", "a/images/b/images/x.jpg", "s 1/v#2.mp4"), ("plain", "images/y.png", "v.mp4")], "n string, p string, v string")
    rows = df.select(N.video_id("n"), N.frame_index("n"), N.person_field("n"), N.label_path("p"), N.safe_id("v")).collect()
    assert tuple(rows[0]) == ("d_Joy_clip", 30, "Joy", "a/images/b/labels/x.txt", "s_1_v_2")
    assert tuple(rows[1]) == ("plain", 0, "?", "labels/y.txt", "v")
    urls = spark.createDataFrame([("/data/local-files/?d=images/a%20b_f000030.jpg",), ("http://h/x/y.jpg?z=1",), ("p/q.png",)], "u string")
    assert [r[0] for r in urls.select(N.image_name_from_url("u")).collect()] == ["a b_f000030.jpg", "y.jpg", "q.png"]


def test_decoders_drop_weak_and_inverted_rows(spark):
    rows = [[0.1, 0.1, 0.4, 0.5, 0.9, 1.0], [0.5, 0.1, 0.4, 0.5, 0.9, 0.0], [0.1, 0.1, 0.4, 0.5, 0.2, 0.0], [-0.2, 0.0, 1.7, 1.0, 0.6, 9.0]]
    df = spark.createDataFrame([(rows,)], "rows array<array<double>>")
    assert [(r.row_no, r.cls, r.x1, r.x2) for r in D.decode_fixed_rows(df, classes=2).collect()] == [(0, 1, 0.1, 0.4), (3, 1, 0.0, 1.0)]
    grid = [[[0.4, 0.4, 0.4, 0.4, -5.0, 3.0], [0.1] * 4 + [-5.0, -5.0]], [[0.1] * 4 + [-4.0, -3.0], [-1.0, 0.2, -1.0, 0.2, 5.0, 5.0]]]
    got = D.decode_grid_head(spark.createDataFrame([([grid],)], "heads array<array<array<array<double>>>>")).collect()
    assert [(r.cls, round(r.x1, 3), round(r.x2, 3)) for r in got] == [(1, 0.05, 0.45)]


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT hamming(5L, 3L) h, dot(array(1D, 2D), array(3D, 4D)) d, box_iou(0D, 0D, 2D, 2D, 1D, 0D, 3D, 2D) i, box_iou(0D, 0D, 0D, 0D, 0D, 0D, 0D, 0D) z").first()
    assert (r.h, r.d, round(r.i, 6), r.z) == (2, 11.0, round(1 / 3, 6), 0.0)
    quads = spark.sql("SELECT * FROM quad_boxes('# 1 2\nSETS\n1 1 4 1 4 5 1 5\n7 7 7 7 7 7 7 7 3')").collect()
    assert [tuple(q) for q in quads] == [(0, 1.0, 1.0, 4.0, 5.0)]
