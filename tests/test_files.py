"""Golden files per format, written by hand, with malformed and empty cases."""
import json
import struct
import zlib
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from visorlake.functions import pixels as X
from visorlake.plans import flows
from visorlake.plans.registry import all_queries
from visorlake.sinks import files as K
from visorlake.sources import frames as SF, labels as SL, tables as ST


def png(px: np.ndarray) -> bytes:
    """A PNG of RGB pixels."""
    h, w, _ = px.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_yolo_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.4 0.1 0.2\n2.0 0.1 0.1 0.2 0.2 \n1 0.5 0.5 0.1\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.txt").write_text("\n1 0.3 0.3 0.1 0.1\n")
    got = {(r.sample_id, r.box_no, r.cls, r.cx) for r in SL.read_yolo_labels(spark, str(tmp_path)).collect()}
    assert got == {("a", 0, 0, 0.5), ("a", 1, 2, 0.1), ("b", None, None, None), ("c", 0, 1, 0.3)}


def test_yolo_keypoints(spark, tmp_path):
    (tmp_path / "k.txt").write_text("0 0.5 0.5 0.2 0.2 0.1 0.2 2 0.3 0.4 0\n0 0.5 0.5 0.2 0.2 0.1 0.2 2\n")
    rows = SL.read_yolo_labels(spark, str(tmp_path), kpts=2).collect()
    assert len(rows) == 1 and [tuple(p) for p in rows[0].keypoints] == [(0.1, 0.2, 1), (0.3, 0.4, 0)]


def test_block_gt(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("e/a.jpg\n2\n1 2 3 4 0 0\n5 6 0 8 1 0\ne/none.jpg\n0\n0 0 0 0 0 0\n\ne/b.jpg\n1\n9 9 9 9 0 0\n")
    got = [(r.sample_id, r.box_no, r.x1) for r in SL.read_block_gt(spark, str(tmp_path)).orderBy("rel_path", "box_no").collect()]
    assert got == [("a", 0, 1.0), ("a", 1, 5.0), ("b", 0, 9.0), ("none", None, None)]


def test_block_gt_split_file(spark, tmp_path):
    text = "".join(f"d/{i}.jpg\n{i % 4}\n" + ("".join(f"{j} 1 2 3\n" for j in range(i % 4)) or "0 0 0 0\n") for i in range(4000))
    (tmp_path / "gt.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = SL.read_block_gt(spark, str(tmp_path))
        assert df.count() == sum(max(1, i % 4) for i in range(4000))
        per = {r.sample_id: r.n for r in df.groupBy("sample_id").agg(F.count("box_no").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert per == {str(i): i % 4 for i in range(4000)}


def test_annotation_map(spark, tmp_path):
    hand = [[0.1, 0.2]] * 21
    (tmp_path / "fist.json").write_text(json.dumps({"u1": {"bboxes": [[0, 0, 1, 1], [0, 0, 1, 1]], "hand_landmarks": [hand, hand[:20]], "user_id": "x"},
                                                    "u2": {"bboxes": [[0, 0, 1, 1]], "hand_landmarks": None, "user_id": "y"}}))
    from visorlake.operators.filters import filter_complete_landmarks
    df = SL.read_annotation_map(spark, str(tmp_path))
    assert {r["group"] for r in df.collect()} == {"fist"}
    kept = filter_complete_landmarks(df).collect()
    assert [(r.sample_id, len(r.hands)) for r in kept] == [("u1", 1)]


def test_quad_json_and_polygons(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "i.jpg.json").write_text(json.dumps({"size": [640, 480], "objects": [
        {"data": [[1, 2], [5, 2], [5, 9], [1, 9]], "tags": ["QR"]}, {"data": [[1, 2], [3, 4]], "tags": []}, {"data": [[0, 0], [2, 0], [2, 2]]}]}))
    got = [(r.sample_id, r.cls, r.x2, r.y2) for r in SL.read_quad_json(spark, str(tmp_path / "q")).orderBy("box_no").collect()]
    assert got == [("i", 0, 5.0, 9.0), ("i", 1, 2.0, 2.0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.txt").write_text("# 1 2 3\nSETS\n1 1 4 1 4 5 1 5\n7 7 7 7 7 7 7 7\n1 2\n")
    (tmp_path / "p" / "Notes.txt").write_text("1 1 4 1 4 5 1 5")
    got = [(r.sample_id, r.x1, r.y2) for r in SL.read_polygon_txt(spark, str(tmp_path / "p")).collect()]
    assert got == [("one", 1.0, 5.0)]


def test_calibration(spark, tmp_path):
    k = [[[10.0, 0.0, 5.0], [0.0, 10.0, 5.0], [0.0, 0.0, 1.0]]] * 2
    xyz = [[[i * 0.1, 0.2, 1.0] for i in range(21)], [[0.1, 0.2, 0.0]] * 21]
    (tmp_path / "k.json").write_text(json.dumps(k))
    (tmp_path / "x.json").write_text(json.dumps(xyz))
    from visorlake.functions.boxes import project_points
    df = SL.read_calibration(spark, str(tmp_path / "k.json"), str(tmp_path / "x.json"))
    rows = project_points(df).collect()
    assert df.count() == 2 and [r.idx for r in rows] == [0]
    assert rows[0].cx == pytest.approx(15.0) and rows[0].side == pytest.approx(28.0)


def test_annotation_export(spark, tmp_path):
    def task(name, *anns):
        return {"data": {"image": f"/data/local-files/?d=images/{name}.jpg"}, "annotations": list(anns)}

    def rect(label, x, kind="rectanglelabels"):
        return {"type": kind, "value": {"x": x, "y": 20, "width": 5, "height": 5, "rectanglelabels": [label]}}
    (tmp_path / "e.json").write_text(json.dumps([
        task("a", {"was_cancelled": True, "result": [rect("ball", 1)]}, {"was_cancelled": False, "result": [rect("ball", 10), rect("dog", 2), rect("club", 3, "other")]}),
        task("b", {"was_cancelled": True, "result": []}), task("c", {"was_cancelled": False, "result": []})]))
    got = {(r.sample_id, r.cls, r.px) for r in SL.read_annotation_export(spark, str(tmp_path), ["ball", "club"]).collect()}
    assert got == {("a", 0, 10.0), ("c", None, None)}
    tasks = spark.read.schema(SL.EXPORT).option("multiLine", True).json(str(tmp_path))
    assert SL.export_report(tasks).first().asDict() == {"tasks": 3, "labeled": 2, "skipped": 1}


def test_detection_cache_and_affines(spark, tmp_path):
    for d in ("d", "c"):
        (tmp_path / d).mkdir()
    (tmp_path / "d" / "v.json").write_text(json.dumps({"fps": 30.0, "frames": [{"b": [[0, 0, 4, 4]], "c": [[1, 1, 2, 2, 0.5]]}, {"b": [], "c": []}, {"b": [[1, 1, 3, 3]], "c": []}]}))
    (tmp_path / "c" / "v.json").write_text(json.dumps([[1, 0, 5, 0, 1, 0], None]))
    df = SF.attach_affines(SF.read_detection_cache(spark, str(tmp_path / "d")), SF.read_affines(spark, str(tmp_path / "c"))).orderBy("frame_idx").collect()
    assert [(r.frame_idx, len(r.balls), len(r.clubs), len(r.holes)) for r in df] == [(0, 1, 1, 0), (1, 0, 0, 0), (2, 1, 0, 0)]
    assert df[0].cam is None and df[1].cam[2] == 5.0 and df[2].cam is None


def test_config_manifest_and_lists(spark, tmp_path):
    conf = ST.parse_dataset_config("path: /d\ntrain: [a/images, /b/images]\nval: c/images\nnames:\n  0: ball\n  1: club\n")
    assert conf["train"] == ["/d/a/images", "/b/images"] and conf["val"] == ["/d/c/images"] and conf["names"] == {0: "ball", 1: "club"}
    assert ST.parse_dataset_config("train: x\nnames: [p, q]\n")["names"] == {0: "p", 1: "q"}
    for split in ("train", "val"):
        (tmp_path / split / "labels").mkdir(parents=True)
        (tmp_path / split / "labels" / "s.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    (tmp_path / "d.yaml").write_text(f"path: {tmp_path}\ntrain: train/images\nval: val/images\nnames: [ball]\n")
    assert sorted(r.split for r in ST.read_dataset_config(spark, str(tmp_path / "d.yaml"))[1].collect()) == ["train", "val"]
    (tmp_path / "m.csv").write_text("person,videos,split\n Joy , 4, val \nMax,2,train\n")
    assert [(r.person, r.videos, r.split) for r in ST.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("Joy", 4, "val"), ("Max", 2, "train")]
    (tmp_path / "l.txt").write_text("a.jpg\n\n  b.jpg \n")
    assert [r.path for r in ST.read_frame_list(spark, str(tmp_path / "l.txt")).collect()] == ["a.jpg", "b.jpg"]


def test_bind_tables_by_columns(spark):
    ann = spark.createDataFrame([(1, 5, 7, 0)], "id long, task_id long, completed_by_id long, was_cancelled int")
    users = spark.createDataFrame([(7, "a@b")], "id long, email string")
    tasks = spark.createDataFrame([(5, 3)], "id long, project_id long")
    t = ST.bind_annotation_tables({"zz": ann, "people": users, "jobs": tasks})
    assert t.annotations.first().project_id == 3 and not t.has_time and t.projects is None
    with pytest.raises(ValueError):
        ST.bind_annotation_tables({"people": users})


def test_label_and_polygon_writers(spark, tmp_path):
    boxes = spark.createDataFrame([("a", 1, 1, 0.25, 0.5, 0.1, 0.1234565), ("a", 0, 0, 0.5, 0.5, 0.5, 0.5)], "sample_id string, box_no int, cls int, cx double, cy double, w double, h double")
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    K.write_yolo_labels(boxes, samples, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").read_text() == "0 0.500000 0.500000 0.500000 0.500000\n1 0.250000 0.500000 0.100000 %.6f\n" % 0.1234565
    assert (tmp_path / "out" / "b.txt").read_text() == ""
    polys = spark.createDataFrame([("a", 0, 2, [(0.0, 0.1), (0.2, 0.3), (0.4, 0.5)]), ("a", 1, 2, [(0.0, 0.0), (1.0, 1.0)])], "sample_id string, poly_no int, cls int, points array<struct<x:double,y:double>>")
    K.write_polygons(polys, str(tmp_path / "poly"))
    assert (tmp_path / "poly" / "a.txt").read_text() == "2 0.000000 0.100000 0.200000 0.300000 0.400000 0.500000\n"


def test_images_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (40, 48, 3), dtype=np.uint8)
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "one.png").write_bytes(png(px))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    green = np.zeros((20, 20, 3), np.uint8)
    green[..., 1] = 200
    (tmp_path / "green.png").write_bytes(png(green))
    df = SF.read_images(spark, str(tmp_path))
    got = {r.sample_id: r for r in df.select("sample_id", "width", "height", X.phash("image").alias("h"), X.sharpness("image").alias("s"), X.green_fraction("image").alias("g"),
                                             X.appearance_descriptor("image").alias("d"), F.size(X.thumbnail("image")).alias("t")).collect()}
    assert set(got) == {"one", "green"} and (got["one"].width, got["one"].height) == (48, 40)
    y = (px[..., 0].astype(int) * 77 + px[..., 1].astype(int) * 150 + px[..., 2].astype(int) * 29) >> 8
    lap = [4 * y[i, j] - y[i, j - 1] - y[i, j + 1] - y[i - 1, j] - y[i + 1, j] for i in range(1, 39) for j in range(1, 47)]
    assert got["one"].s == pytest.approx(np.var(lap)) and got["green"].s == 0.0
    assert got["green"].g == 1.0 and got["one"].g < 0.4
    assert len(got["one"].d) == 268 and np.linalg.norm(got["one"].d) == pytest.approx(1.0, abs=1e-4) and got["one"].t == 64 * 64 * 3


def test_image_index_reads_headers(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xff\xe1\x00\x04\xff\xc0" + b"\xff\xc2\x00\x11\x08\x01\x02\x03\x04" + bytes(12)
    gif, bmp = b"GIF89a\x05\x00\x06\x00" + bytes(5), b"BM" + bytes(16) + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True)
    assert [SF.header_size(x) for x in (jpeg, gif, bmp, b"", b"\xff\xd8\xff", b"BM", jpeg[:24])] == [(772, 258), (5, 6), (7, 9), None, None, None, None]
    px = np.zeros((3, 4, 3), np.uint8)
    for root, folder in (("one", "x"), ("one", "y"), ("two", "x")):
        (tmp_path / root / folder).mkdir(parents=True)
        (tmp_path / root / folder / "same.png").write_bytes(png(px))
    (tmp_path / "one" / "cut.png").write_bytes(png(px)[:12])
    roots = [str(tmp_path / r) for r in ("one", "two")]
    ids = lambda *a, **k: sorted(r.sample_id for r in SF.image_index(spark, *a, **k).collect())
    assert ids(roots, nested=True) == ["one__x__same", "one__y__same", "two__x__same"]
    assert ids(roots[0], nested=True) == ["x__same", "y__same"] and ids(roots[0]) == ["same", "same"]
    assert {(r.width, r.height) for r in SF.image_index(spark, roots).collect()} == {(4, 3)}


def test_phash_is_stable_under_small_changes():
    rng = np.random.default_rng(2)
    base = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    px = np.repeat(base[..., None], 3, axis=2)
    near = np.clip(px.astype(int) + rng.integers(-2, 3, px.shape), 0, 255).astype(np.uint8)
    other = np.repeat(np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)[..., None], 3, axis=2)
    d = lambda a, b: bin((X.phash_one(a) ^ X.phash_one(b)) & (2**64 - 1)).count("1")
    assert d(px, near) <= 4 < 12 < d(px, other)


def test_media_catalog(spark, tmp_path):
    for p, n in (("Indoor/Joy/a b.mp4", 30), ("Outdoor/Max/x.mp4", 5), ("Indoor/_template_folder/t.mp4", 40), ("Indoor/Joy/n.txt", 50)):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * n)
    got = [(r.person, r.domain, r.video_id, r.length) for r in SF.read_media_catalog(spark, str(tmp_path / "root"), min_bytes=10).collect()]
    assert got == [("Joy", "Indoor", "Indoor_Joy_a_b", 30)]


def test_media_catalog_of_many_files_takes_few_tasks(spark, tmp_path):
    """Files that are only listed need no task for every thirty of them."""
    names = spark.range(600, numPartitions=1).selectExpr("concat('In/p', id % 3, '/c', id) AS sample_id", "repeat('x', 20) AS text")
    K.write_each(names, str(tmp_path / "root"), ext=".mp4")
    files = SF.read_media_catalog(spark, str(tmp_path / "root"), min_bytes=10)
    assert files.rdd.getNumPartitions() <= 8 and files.count() == 600 and files.select("person").distinct().count() == 3


def test_export_is_written_compressed(spark, tmp_path):
    """A task document repeats its names for every box; written plainly, the documents are most of what the query moves."""
    folder = "/root/testdata/sf0.001"
    with mock.patch.object(flows, "scratch", lambda fx: str(tmp_path)):
        rows = all_queries()["s08_read_annotation_export"](spark, folder).count()
    size = sum(f.stat().st_size for f in (tmp_path / "export").iterdir())
    assert rows > 100 and size < 200 * spark.read.parquet(f"{folder}/orders.parquet").count()


def test_class_ids_of_any_length(spark):
    df = spark.createDataFrame([("a", "12345 0.1 0.2 0.3 0.4\n1e1 0 0 1 1\n2.0 0 0 1 1\nx 0 0 1 1")], "sample_id string, value string")
    assert [r.cls for r in SL.parse_yolo_text(df).orderBy("box_no").collect()] == [12345, 10, 2, None]


def test_image_measures_hold_numbers_not_lists():
    """A batch of vectors takes the room of its numbers (twice while it is built), and no image is copied."""
    import tracemalloc

    import pyarrow as pa
    n, data = 400, bytes(range(256)) * 3
    img = pa.array([{"height": 16, "width": 16, "nChannels": 3, "data": data}] * n)
    run = X._over_images(X.thumb_one, T.IntegerType(), many=True).func
    tracemalloc.start()
    got = run(img[10:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n - 10 and got[5].as_py() == X.thumb_one(X.to_array(16, 16, 3, data)).tolist()
    assert peak < 2.2 * 64 * 64 * 3 * 4 * n
    assert len(run(img[:0])) == 0
