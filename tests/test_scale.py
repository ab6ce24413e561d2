"""Skew-safe helpers against plain Python on small tables with one hot key."""
import random
from unittest import mock

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from visorlake.operators import metrics, sampling, signals
from visorlake import scale
from visorlake.scale import ordered_scan, ordered_steps, positions, running_sum, span_of, with_halo


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    hot = [("a", i, rng.randint(0, 9)) for i in sorted(rng.sample(range(900), 600))]
    return hot + [(k, i, rng.randint(0, 9)) for k in "bcd" for i in sorted(rng.sample(range(900), 40))]


def by_key(rows):
    out = {}
    for k, i, v in sorted(rows):
        out.setdefault(k, []).append((i, v))
    return out


def test_positions_and_running_sum(spark, rows):
    df = spark.createDataFrame(rows, "k string, i int, v int")
    pos = {(r.k, r.i): r.pos for r in positions(df, ["k"], [F.col("i")], span_of("i", 50)).collect()}
    cum = {(r.k, r.i): r.c for r in running_sum(df, ["k"], [F.col("i")], span_of("i", 50), F.col("v"), "c").collect()}
    before = {(r.k, r.i): r.c for r in running_sum(df, ["k"], [F.col("i")], span_of("i", 50), F.col("v"), "c", before=True).collect()}
    for k, seq in by_key(rows).items():
        total = 0
        for n, (i, v) in enumerate(seq, 1):
            assert pos[k, i] == n and before[k, i] == total
            total += v
            assert cum[k, i] == total
    assert len(pos) == len(rows)


def test_halo_gives_each_row_its_neighbours(spark, rows):
    df = with_halo(spark.createDataFrame(rows, "k string, i int, v int"), "i", back=7, ahead=3, span=40).toPandas()
    assert df["_own"].sum() == len(rows)
    for (k, span), part in df.groupby(["k", "_span"]):
        have = set(part["i"])
        for i in part[part["_own"]]["i"]:
            assert {j for kk, j, _ in rows if kk == k and i - 7 <= j <= i + 3} <= have


OUT = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("y", T.LongType())])


def drifting():
    """A fold whose state never settles: spans must be redone one after the other."""
    def fold(key, state, pdf):
        y, out = state or 0, []
        for i, v in zip(pdf["i"], pdf["v"]):
            y = (y * 31 + int(v)) % 1_000_003
            out.append((key[0], int(i), y))
        return pd.DataFrame(out, columns=["k", "i", "y"]), y
    return fold


def forgetful():
    """A fold that forgets after three rows: spans agree after the warm-up."""
    def fold(key, state, pdf):
        last, out = list(state or []), []
        for i, v in zip(pdf["i"], pdf["v"]):
            last = (last + [int(v)])[-3:]
            out.append((key[0], int(i), sum(last)))
        return pd.DataFrame(out, columns=["k", "i", "y"]), last
    return fold


@pytest.mark.parametrize("fold", [drifting, forgetful])
@pytest.mark.parametrize("group_rows", [10_000, 100])
def test_ordered_scan_equals_one_pass(spark, rows, fold, group_rows):
    df, fold = spark.createDataFrame(rows, "k string, i int, v int"), fold()
    got = {(r.k, r.i): r.y for r in ordered_scan(df, ["k"], "i", ["i"], fold, OUT, span=120, warmup=30, group_rows=group_rows).collect()}
    want = {}
    for k, seq in by_key(rows).items():
        out, _ = fold((k,), None, pd.DataFrame(seq, columns=["i", "v"]))
        want.update({(k, i): y for _, i, y in out.itertuples(index=False)})
    assert got == want


def test_sorted_groups_survive_small_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        test_ordered_scan_equals_one_pass(spark, rows, drifting, 10_000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")


def test_thin_and_dedup_hot_video_in_spans(spark):
    rng = random.Random(2)
    frames = [(0, i, rng.choice([0, 1, 3, 255, 1 << 40, -1])) for i in range(700)] + [(1, i, 7) for i in range(0, 90, 3)]
    df = spark.createDataFrame(frames, "video_id int, frame_idx int, hash long")

    def plain(rule):
        keep, last = set(), {}
        for v, i, h in frames:
            if v not in last or rule(last[v], (i, h)):
                keep.add((v, i))
                last[v] = (i, h)
        return keep

    for rows_limit in (10_000, 50):
        thin = sampling.thin_by_gap(df, 11, span=64, group_rows=rows_limit)
        assert {(r.video_id, r.frame_idx) for r in thin.collect()} == plain(lambda a, b: b[0] - a[0] >= 11)
        dedup = sampling.dedup_consecutive(df, 5, span=64, group_rows=rows_limit)
        assert {(r.video_id, r.frame_idx) for r in dedup.collect()} == plain(
            lambda a, b: bin((a[1] ^ b[1]) & (2**64 - 1)).count("1") > 5)


@pytest.mark.parametrize("alpha,first", [(0.45, False), (0.1, True), (0.9, False)])
def test_ema_matches_recurrence(spark, alpha, first):
    rng = random.Random(9)
    data = [("v", i, rng.uniform(0, 100)) for i in range(1500)] + [("w", i * 40, rng.uniform(0, 1)) for i in range(30)]
    df = spark.createDataFrame(data, "k string, i int, x double")
    got = {(r.k, r.i): r.ema for r in signals.ema(df, ["k"], "i", "x", alpha, span_of("i", 100), start_at_first=first).collect()}
    y = {}
    for k, i, x in data:
        y[k] = x if first and k not in y else (1 - alpha) * y.get(k, 0.0) + alpha * x
        assert got[k, i] == pytest.approx(y[k], rel=1e-9)


def test_look_up_with_a_hot_key(spark):
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(3000)] + [(None, 7)], "k int, v int")
    table = spark.createDataFrame([(k, str(k)) for k in range(0, 3000, 2)] + [(1, "hot")], "k int, name string")
    want = sorted(map(tuple, rows.join(table, "k", "left").collect()), key=repr)
    for share in (1000, 10):
        got = scale.look_up(rows, table, ["k"], share)
        assert got.columns == ["k", "v", "name"] and sorted(map(tuple, got.collect()), key=repr) == want


def test_rows_of_a_unit_reach_the_fold_together(spark):
    shape = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("n", T.LongType())])
    df = spark.createDataFrame([(k, i, no) for k in "ab" for i in range(40) for no in range(5 if i != 20 else 23)], "k string, i int, no int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ordered_scan(df, ["k"], "i", ["i", "no"], lambda key, state, pdf: (pdf.assign(n=pdf.groupby("i")["i"].transform("size")), None), shape).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    assert len(got) == 2 * (39 * 5 + 23) and all(r.n == (5 if r.i != 20 else 23) for r in got)


def test_spans_are_spread_over_tasks(spark):
    """Thousands of spans are a few kilobytes; they must not end up in one Python task for that."""
    rows = [(v, i, (v * 7919 + i * 104729) % 5003) for v in range(40) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, hash long")
    cut = sampling.dedup_consecutive(df, threshold=2, span=20, group_rows=50)
    whole = sampling.dedup_consecutive(df, threshold=2)
    assert cut.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_matching_takes_partitions_by_boxes(spark):
    """What a task of the matching sorts is bounded by the number of partitions, and the matches do not depend on it."""
    rng = random.Random(2)
    rows = [(i // 8, i % 2, i, rng.random(), 10.0 * (i % 4) + rng.randint(0, 3), 5.0, 10.0 * (i % 4) + 12, 20.0) for i in range(800)]
    truth = spark.createDataFrame(rows, "sample_id int, cls int, gt_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    preds = truth.withColumnRenamed("gt_id", "det_id").withColumn("x1", F.col("x1") + F.col("det_id") % 3)
    few = metrics.match_detections(preds, truth, [0.5, 0.75])
    with mock.patch.object(metrics, "TASK_ROWS", 25):
        many = metrics.match_detections(preds, truth, [0.5, 0.75])
    assert many.rdd.getNumPartitions() == 32 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 500


@pytest.mark.parametrize("group_rows", [10_000, 100])
def test_ordered_steps_equal_one_pass(spark, rows, group_rows):
    """The rows' other columns pass through; a group over `group_rows` is cut into spans."""
    def step(state, i, v, many):
        state = (state or 0) + v + sum(many or []) if v else 0                  # forgets at each zero
        return (state, [float(state)] * (v % 3) if v else None), state

    more = T.StructType([T.StructField("y", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame([(k, i, v, [v, 1] if v % 2 else None, [k]) for k, i, v in rows], "k string, i int, v int, many array<int>, kept array<string>")
    got = {(r.k, r.i): (r.y, r.z, r.kept) for r in ordered_steps(df, ["k"], "i", ["i", "v", "many"], step, more, span=120, warmup=30, group_rows=group_rows).collect()}
    want = {}
    for k, group in by_key(rows).items():
        state = None
        for i, v in group:
            (y, z), state = step(state, i, v, [v, 1] if v % 2 else None)
            want[k, i] = y, z, [k]
    assert got == want


def test_python_values():
    for rows, kind in (([1, 2, None], pa.int32()), ([1, 2], pa.int64()), ([None, None], pa.list_(pa.float64())), ([[1.5], [], None, [2.0, 3.0]], pa.list_(pa.float64())),
                       ([[1.0], [2.0, 4.0]], pa.list_(pa.float64())), ([[1.0, None], []], pa.list_(pa.float64())), (["a", None], pa.string()), ([], pa.list_(pa.int32()))):
        column = pa.array(rows, kind)
        assert scale.python_values(column) == rows and scale.python_values(column[1:]) == rows[1:]
