"""Seeded samples, splits, strides and copies: sizes, determinism, disjointness."""
from pyspark.sql import functions as F

from visorlake.operators import sampling as S, sets as G


def frames(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("video_id"),
                                 (F.col("id") * 7 % n).cast("int").alias("frame_idx"), F.lit("val").alias("split"))


def ids(df):
    return {r.sample_id for r in df.select("sample_id").collect()}


def test_seeded_samples_have_exact_size_and_repeat(spark):
    df = frames(spark)
    for n in (1, 50, 2999, 3000, 5000):
        a = ids(S.sample_seeded(df, n, seed=4))
        assert len(a) == min(n, 3000) and a == ids(S.sample_seeded(df.repartition(5), n, seed=4))
    assert ids(S.sample_seeded(df, 100, seed=1)) != ids(S.sample_seeded(df, 100, seed=2))
    assert ids(S.sample_seeded(df, 0)) == set(range(3000)) and ids(S.sample_seeded(df, 40)) < ids(S.sample_seeded(df, 90))


def test_split_seeded_counts(spark):
    for frac, n in ((0.0, 0), (0.04, 120), (0.5, 1500)):
        assert S.split_seeded(frames(spark), frac, seed=3).where("split = 'val'").count() == n


def test_caps_hold_for_a_hot_group(spark):
    df = frames(spark)
    for n in (5, 1200):
        capped = S.cap_per_group(df, ["video_id"], ["frame_idx"], n, slice_by=F.floor(F.col("frame_idx") / 100))
        want = {r.video_id: min(n, r.n) for r in df.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert {r.video_id: r.n for r in capped.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()} == want


def test_stride_phases_are_disjoint_and_complete(spark):
    df = frames(spark)
    parts = [ids(S.stride_sample(df, 4, [p], span=64)) for p in range(4)]
    assert sum(map(len, parts)) == 3000 and set().union(*parts) == set(range(3000))


def test_cumulative_split_keeps_videos_whole(spark):
    s = S.cumulative_split(frames(spark), 0.2, seed=5)
    assert s.groupBy("video_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty() and s.count() == 3000


def test_oversample_is_idempotent(spark):
    s = spark.createDataFrame([("qa1", True, "train"), ("qb2", True, "train"), ("zz", True, "train"), ("qa3", False, "train"), ("qa4", True, "val")],
                              "sample_id string, labelled boolean, split string")
    once = S.oversample(s, ["qa", "qb"], 3)
    assert ids(once) == {"qa1", "qa1_ov1", "qa1_ov2", "qb2", "qb2_ov1", "qb2_ov2", "zz", "qa3", "qa4"}
    assert ids(S.oversample(once, ["qa", "qb"], 3)) == ids(once) and S.oversample(once, ["qa", "qb"], 3).count() == once.count()


def test_mix_caps_the_automatic_share(spark):
    t, a = frames(spark, 300), frames(spark, 3000).where("sample_id >= 300")
    assert G.mix_with_cap(t, a, 0.25).count() == 400
    assert G.mix_with_cap(t, a.limit(20), 0.25).count() == 320 and G.mix_with_cap(t, a, 1.0).count() == 3000
