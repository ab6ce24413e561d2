"""Streams give the same rows in any number of batches, after a restart, and as the batch form."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from visorlake.schemas import LIVE
from visorlake.streaming import live as L
from visorlake.streaming.posture import posture_states
from visorlake.streaming.strikes import FOLLOWED, hit_states


def live_rows():
    """15 fps: a ball at rest with a club near, gone at 3 s; a far later row moves the watermark past all."""
    rows, t0 = [], pd.Timestamp("2024-01-01")
    for cam in ("a", "b"):
        for i in range(150):
            t = t0 + pd.Timedelta(seconds=i / 15)
            seen = i < 45 or cam == "b"
            ball = [(0.49, 0.49, 0.53, 0.53, 0.9)] if seen else []
            rows.append((cam, t.to_pydatetime(), ball, [(0.5, 0.5, 0.55, 0.55, 0.9)] if i < 44 else [], 0.0, 0.0))
    return rows + [("z", (t0 + pd.Timedelta(seconds=60)).to_pydatetime(), [], [], 0.0, 0.0)]


def write_parts(spark, rows, path, n):
    for k in range(n):
        part = rows[k * len(rows) // n:(k + 1) * len(rows) // n]
        spark.createDataFrame(part, LIVE).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, make, files):
    L.use_state_store(spark)
    stream = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", files).parquet(source)
    q = (make(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{out}/rows").where("camera_id <> 'z'").collect()), key=repr)


def test_hit_counter_batches_restart_and_batch_form(spark, tmp_path):
    rows = sorted(live_rows(), key=lambda r: r[1])
    write_parts(spark, rows, str(tmp_path / "one"), 1)
    one = run(spark, str(tmp_path / "one"), str(tmp_path / "o1"), L.stream_hit_counter, 1)
    half = len(rows) // 2
    write_parts(spark, rows[:half], str(tmp_path / "two"), 1)
    run(spark, str(tmp_path / "two"), str(tmp_path / "o2"), L.stream_hit_counter, 1)
    write_parts(spark, rows[half:], str(tmp_path / "two"), 2)
    restarted = run(spark, str(tmp_path / "two"), str(tmp_path / "o2"), L.stream_hit_counter, 1)
    batch = sorted(map(tuple, L.stream_hit_counter(spark.createDataFrame(rows, LIVE)).where("camera_id <> 'z'").collect()), key=repr)
    write_parts(spark, rows, str(tmp_path / "ten"), 10)
    ten = run(spark, str(tmp_path / "ten"), str(tmp_path / "o10"), L.stream_hit_counter, 1)
    assert one == restarted == ten == batch and len(one) == 300
    fired = [r for r in one if r[4]]
    assert [(r[0], r[2]) for r in fired] == [("a", 1)]
    assert max(r[2] for r in one if r[0] == "b") == 0


def random_clip(seed, n=400):
    """A ball that rests, rolls, vanishes and comes back under a camera that turns at times, with dropped frames, a stray ball and a club."""
    import random

    r = random.Random(seed)
    t, x, y, v, pan, what, left, rows = 0, 320.0, 320.0, (0, 0), (0, 0), "rest", 30, []
    for _ in range(n):
        t += int(5e7 * r.choice([1] * 30 + [1.03, 4, 50]))
        left -= 1
        if left <= 0:
            what, left = r.choice(["rest", "rest", "roll", "gone", "gone"]), r.randint(10, 50)
            v, pan = (r.uniform(-25, 25), r.uniform(-25, 25)), (r.uniform(-6, 6), r.uniform(-6, 6)) if r.random() < 0.25 else (0, 0)
            x, y = (r.uniform(60, 580), r.uniform(60, 580)) if what == "rest" and r.random() < 0.5 else (x, y)
        x, y = x + pan[0] + v[0] * (what == "roll"), y + pan[1] + v[1] * (what == "roll")
        balls = [(x + r.uniform(-1, 1), y, 8 + r.uniform(-1, 1))] * (what != "gone" and r.random() < 0.96) + [(r.uniform(0, 640), r.uniform(0, 640), 6.0)] * (r.random() < 0.05)
        clubs = [(x + 15, y + 10)] * (what != "roll" and r.random() < 0.7)
        rows.append((t, *([b[i] for b in balls] for i in range(3)), *([k[i] for k in clubs] for i in range(2)), *map(float, pan)))
    return pd.DataFrame(rows, columns=["ts", "bx", "by", "br", "kx", "ky", "dx", "dy"])


@pytest.mark.parametrize("seed", range(5))
def test_hits_in_any_pieces(seed):
    clip, got = random_clip(seed), []
    for size in (400, 61, 1):
        memory, out = None, []
        for at in range(0, len(clip), size):
            part, memory = hit_states(memory, clip[at:at + size].reset_index(drop=True))
            out += list(part.itertuples(index=False, name=None))
            assert len(memory["t"]) == 0 or memory["t"][-1] - memory["t"][0] <= 5.5e9          # only the last seconds are kept
        got.append(out)
    assert got[0] == got[1] == got[2] and {o[3] for o in got[0]} == {"SEARCH", "TRACK", "ADDRESS", "PEND"}
    fires = [o[2] for o in got[0] if o[1]]
    assert [o[0] for o in got[0] if o[1]] == list(range(1, len(fires) + 1)) and all(b - a >= 2.5 for a, b in zip(fires, fires[1:], strict=False))
    assert set(FOLLOWED) <= set(memory)


@pytest.mark.parametrize("x0,dx,dy,hits", [(100.0, 0.0, 0.0, 1), (100.0, -25.0, 0.0, 0), (320.0, -25.0, 0.0, 1), (320.0, 0.0, 25.0, 1), (320.0, 20.0, 0.0, 1), (600.0, 10.0, 10.5, 0)])
def test_a_ball_that_the_camera_leaves_is_no_hit(x0, dx, dy, hits):
    """A ball rests for three seconds with a club at it and vanishes, while the camera moves: out over a near side border it does not count."""
    rows = []
    for i in range(120):
        seen, moves = i < 60, 60 <= i < 70
        rows.append((i * 50_000_000, *([[v] if seen else [] for v in (x0, 500.0, 12.0)]), *([[v] if seen else [] for v in (x0 + 20, 510.0)]), dx * moves, dy * moves))
    out, _ = hit_states(None, pd.DataFrame(rows, columns=["ts", "bx", "by", "br", "kx", "ky", "dx", "dy"]))
    assert out["count"].iloc[-1] == hits == out["fired"].sum()


def test_late_rows_are_dropped_and_order_restored(spark, tmp_path):
    rows = sorted(live_rows(), key=lambda r: r[1])
    mixed = [r for k in range(0, len(rows), 20) for r in reversed(rows[k:k + 20])]     # under a second out of order
    write_parts(spark, mixed, str(tmp_path / "in"), 3)
    got = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), L.stream_hit_counter, 1)
    batch = sorted(map(tuple, L.stream_hit_counter(spark.createDataFrame(rows, LIVE)).where("camera_id <> 'z'").collect()), key=repr)
    assert got == batch


def test_address_detector_batch(spark):
    t0 = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(60):
        seen = i < 20 or i >= 35
        rows.append(("c", (t0 + pd.Timedelta(seconds=i / 10)).to_pydatetime(), 0.6 if seen else None, 0.3, 0.4 if seen else None, 0.6, i % 3 == 0))
    df = spark.createDataFrame(rows, "camera_id string, ts timestamp, shoulder_x double, shoulder_y double, hip_x double, hip_y double, club_low boolean")
    out = L.stream_address_detector(df).orderBy("ts").toPandas()
    assert out[out["confirmed"]].index.tolist() == [4, 39]           # held 0.4 s, once per approach
    assert set(out["state"][21:25]) == {"PROMPT"} and out["state"][30] == "SEARCHING"


def slow_posture(frames):
    """The states frame by frame, from all frames before: `frames` of (ns, person, leaning, low, x, y)."""
    out, runs, prompts = [], [], []
    for i, (t, person, leaning, low, x, y) in enumerate(frames):
        clubs = [f[0] for f in frames[:i + 1] if f[3]]
        posture = leaning and bool(clubs) and t - clubs[-1] <= 1_000_000_000
        if not runs or runs[-1][0] != posture:
            runs.append((posture, []))
        runs[-1][1].append((t, x, y))
        run = runs[-1][1]
        if posture:
            near = [r for r in run if t - r[0] <= 400_000_000]
            still = max(max(r[k] for r in near) - min(r[k] for r in near) for k in (1, 2)) <= 0.04
            new = not prompts and len(near) > 2 and still and t - run[0][0] >= 400_000_000
            prompts += [t] * new
            out.append(("PROMPT" if prompts else "POSTURE", new))
            continue
        away = t - run[0][0] >= 600_000_000
        prompts = [] if away else prompts
        out.append((("HUMAN" if person else "SEARCHING") if away or len(runs) == 1 else [o[0] for o in out][-len(run)], False))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_posture_in_any_pieces(seed):
    import random

    r = random.Random(seed)
    frames, t, person, low, x = [], 0, True, True, 0.5
    for _ in range(400):
        t += r.choice([33, 66, 100, 100, 250, 700]) * 1_000_000
        person, low = (not person if r.random() < 0.08 else person), (not low if r.random() < 0.1 else low)
        x += r.choice([0, 0, 0.01, -0.01, 0.05]) * (r.random() < 0.2)
        frames.append((t, person, person and r.random() < 0.97, low and r.random() < 0.5, round(x, 3), 0.6))
    want = slow_posture(frames)
    assert {s for s, _ in want} == {"SEARCHING", "HUMAN", "POSTURE", "PROMPT"} and any(new for _, new in want)
    columns = ["ts", "person", "leaning", "club_low", "hip_x", "hip_y"]
    for size in (1, 7, 400):
        memory, got = None, []
        for at in range(0, len(frames), size):
            part, memory = posture_states(memory, pd.DataFrame(frames[at:at + size], columns=columns))
            got += list(zip(part["state"], part["confirmed"].tolist(), strict=True))
        assert got == want


def test_address_detector_streams_as_its_batch_form(spark, tmp_path):
    t0, rows = pd.Timestamp("2024-01-01"), []
    for cam in ("a", "b"):
        for i in range(120):
            seen = i % 50 < 35
            rows.append((cam, (t0 + pd.Timedelta(milliseconds=100 * i)).to_pydatetime(), 0.6 if seen else None, 0.3, 0.4 if seen else None, 0.6, i % 3 == 0))
    schema = T.StructType.fromDDL("camera_id string, ts timestamp, shoulder_x double, shoulder_y double, hip_x double, hip_y double, club_low boolean")
    end = [("z", (t0 + pd.Timedelta(seconds=60)).to_pydatetime(), None, None, None, None, False)]
    rows.sort(key=lambda r: r[1])
    want = sorted(map(tuple, L.stream_address_detector(spark.createDataFrame(rows, schema)).collect()))
    L.use_state_store(spark)
    for n in (1, 3, 10):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        for k in range(n):
            part = rows[k * len(rows) // n:(k + 1) * len(rows) // n] + (end if k == n - 1 else [])
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = (L.stream_address_detector(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet")
             .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start())
        q.awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(f"{out}/rows").where("camera_id <> 'z'").collect())) == want


def test_changes_and_throttle(spark):
    t0 = pd.Timestamp("2024-01-01")
    rows = [("k", (t0 + pd.Timedelta(milliseconds=200 * i)).to_pydatetime(), v) for i, v in enumerate("aabbbaacca")]
    df = spark.createDataFrame(rows, "camera_id string, ts timestamp, value string")
    assert [r.value for r in L.emit_changes(df).orderBy("ts").collect()] == list("abaca")
    assert L.throttle(df, 0.5).count() == 4


def test_gallery_enrols_reinforces_and_waits(spark, tmp_path):
    v = {"p": [1.0, 0.0, 0.0], "q": [0.0, 1.0, 0.0], "g": [0.27, 0.0, 0.9628]}
    rows = [("g", pd.Timestamp("2024-01-01").to_pydatetime(), i, v[k], known) for i, (k, known) in enumerate([("p", False), ("p", True), ("q", True), ("q", False), ("g", False)])]
    schema = T.StructType.fromDDL("gallery_id string, ts timestamp, face_id long, embedding array<float>, known boolean")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    L.use_state_store(spark)
    q = (L.stream_gallery(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "l")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [(r.decision, r.person_id) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("face_id").collect()]
    assert got == [("enrol", 1), ("reinforce", 1), ("keep", None), ("enrol", 2), ("keep", None)]


def test_identities_do_not_depend_on_the_batches(spark, tmp_path):
    import random

    r = random.Random(3)
    t0, people = pd.Timestamp("2024-01-01"), [[r.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(str(i % 2), (t0 + pd.Timedelta(milliseconds=100 * (i // 2))).to_pydatetime(), i, [x + r.gauss(0, 0.6) for x in people[r.randrange(6)]], r.random() < 0.3) for i in range(120)]
    end = [("z", (t0 + pd.Timedelta(seconds=60)).to_pydatetime(), -1, [0.0] * 5, True)]
    schema = T.StructType.fromDDL("gallery_id string, ts timestamp, face_id long, embedding array<float>, known boolean")
    L.use_state_store(spark)
    got = []
    for n in (1, 3, 8):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        for k in range(n):
            part = rows[k * len(rows) // n:(k + 1) * len(rows) // n]
            spark.createDataFrame(part[::-1] + (end if k == n - 1 else []), schema).coalesce(1).write.mode("append").parquet(source)
        q = (L.stream_gallery(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "2 seconds").writeStream.format("parquet")
             .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start())
        q.awaitTermination()
        got.append(sorted(map(tuple, spark.read.parquet(f"{out}/rows").where("gallery_id <> 'z'").collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows) and {x[4] for x in got[0]} == {"enrol", "reinforce", "keep"}


def test_incremental_files_resume(spark, tmp_path):
    schema = T.StructType.fromDDL("video string, n int")
    src = tmp_path / "in"
    src.mkdir()

    def guard(df):
        return df.mapInPandas(L.guarded(lambda r: {"video": r["video"], "n": 10 // int(r["n"])}, ["video", "n"]), "video string, n int, error string")

    for k, n in enumerate((1, 2, 0)):
        (src / f"{k}.json").write_text(f'{{"video": "v{k}", "n": {n}}}')
        L.incremental_files(spark, str(src), schema, str(tmp_path / "out"), str(tmp_path / "log"), process=guard).awaitTermination()
    rows = {r.video: (r.n, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert rows["v0"] == (10, None) and rows["v1"] == (5, None) and "zero" in rows["v2"][1]


def test_failure_records_are_run_again(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema, fields = T.StructType.fromDDL("video string, n int"), T.StructType.fromDDL("video string, part int")
    paths = str(tmp_path / "done"), str(tmp_path / "failed")
    for k, n in enumerate((1, 0, 5)):
        (src / f"{k}.json").write_text(f'{{"video": "v{k}", "n": {n}}}')
        L.incremental_items(spark, str(src), schema, lambda r: {"video": r["video"], "part": 10 // int(r["n"])}, fields, *paths, str(tmp_path / "log")).awaitTermination()
    bad = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    rows = lambda path, kind: sorted((r[0], r[1], r["attempt"]) for r in L.read_attempts(spark, path, kind).collect())
    assert rows(paths[0], fields) == [("v0", 10, 0), ("v2", 2, 0)] and rows(paths[1], bad) == [("v1", 0, 0)]
    assert L.retry_failures(spark, lambda r: {"video": r["video"], "part": -1}, schema, fields, *paths) == 1
    assert rows(paths[0], fields) == [("v0", 10, 0), ("v1", -1, 1), ("v2", 2, 0)] and rows(paths[1], bad) == [("v1", 0, 0)]
    before = rows(paths[0], fields), rows(paths[1], bad)
    assert L.retry_failures(spark, lambda r: {"video": r["video"], "part": -2}, schema, fields, *paths) == 2       # nothing failed in the last attempt
    assert (rows(paths[0], fields), rows(paths[1], bad)) == before


def test_latest_per_interval_batch(spark):
    rows = [("c", pd.Timestamp("2024-01-01 00:00:00.1").to_pydatetime(), "m", 1), ("c", pd.Timestamp("2024-01-01 00:00:00.7").to_pydatetime(), "m", 2),
            ("c", pd.Timestamp("2024-01-01 00:00:00.9").to_pydatetime(), "old", 3)]
    df = spark.createDataFrame(rows, "camera_id string, ts timestamp, model_id string, n int")
    assert [r.n for r in L.latest_per_interval(df, "1 second", "m").collect()] == [2]


def test_many_waiting_rows_lie_on_shelves(spark, tmp_path, monkeypatch):
    """Cameras with more waiting rows than fit a list, in any order of arrival: same rows as the batch form, in several cuts of the stream."""
    rows = live_rows()
    for n, files in ((1, 1), (5, 2), (5, 1)):
        monkeypatch.setattr(L, "HELD", 20)
        monkeypatch.setattr(L, "CHUNK", 7)
        mixed = sorted(rows[:-1], key=lambda r: hash_of(r[1]) if n == 1 else r[1]) + rows[-1:]
        source = f"{tmp_path}/in{n}{files}"
        write_parts(spark, mixed, source, n)
        got = run(spark, source, f"{tmp_path}/out{n}{files}", L.stream_hit_counter, files)
        want = sorted(map(tuple, L.stream_hit_counter(spark.read.schema(LIVE).parquet(source)).where("camera_id <> 'z'").collect()), key=repr)
        assert len(got) == 300 and got == want


def hash_of(t):
    return t.microsecond * 7919 % 1009


class Store:
    """State of one key in memory: a value, list or map."""

    def __init__(self):
        self.v = {}

    get = lambda self: self.v.get(0)
    update = put = lambda self, x: self.v.update({0: x})
    clear = lambda self: self.v.clear()
    appendList = lambda self, x: self.v.update({0: [*self.v.get(0, []), *x]})
    getValue = lambda self, k: self.v.get(k)
    updateValue = lambda self, k, x: self.v.update({k: x})
    removeKey = lambda self, k: self.v.pop(k)
    keys = lambda self: iter(list(self.v))
    getValueState = getListState = getMapState = lambda self, *a: Store()
    registerTimer = deleteTimer = lambda self, t: None


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_rows_that_arrive_together_wait_as_one_value():
    """The rows of a key cross to the state store once, not one by one, and come back as they were."""
    columns = T.StructType.fromDDL("ts timestamp, n long, x array<double>, s string, b boolean")
    seen = []
    p = L.InOrder(lambda key, state, rows: (seen.append(rows), (rows, 0))[1], columns)
    p.init(Store())
    times = pd.date_range("2024-01-01", periods=90, freq="s")
    rows = pd.DataFrame({"ts": times[::-1], "n": range(90), "x": [np.array([i, i / 3]) for i in range(90)], "s": [None if i % 9 == 0 else str(i) for i in range(90)], "b": [i % 2 == 0 for i in range(90)]})
    assert list(p.handleInputRows(("c",), iter([rows[:60], rows[60:]]), Mark(0))) == [] and len(p.waiting.get()) == 2
    list(p.handleExpiredTimer(("c",), Mark(times[-1].value // 1_000_000), None))
    got, want = seen[0], rows[::-1]
    assert got["ts"].tolist() == [t.value for t in times] and got["n"].tolist() == want["n"].tolist() and got["s"].tolist() == want["s"].tolist()
    assert got["x"].tolist() == [list(v) for v in want["x"]] and got["b"].tolist() == want["b"].tolist()


def test_a_task_has_some_shelves_of_a_camera_in_memory(monkeypatch):
    """No list, piece or shelf grows with the rows that wait; what is not due yet stays."""
    monkeypatch.setattr(L, "HELD", 100)
    monkeypatch.setattr(L, "CHUNK", 25)
    columns = T.StructType.fromDDL("ts timestamp, n long")
    sizes = []

    def fold(key, state, rows):
        sizes.append(len(rows))
        return rows.copy(), (state or 0) + len(rows)

    p = L.InOrder(fold, columns)
    p.init(Store())
    times = pd.date_range("2024-01-01", periods=3000, freq="s")
    order = [(i * 1103) % 3000 for i in range(3000)]
    pieces = (pd.DataFrame({"ts": [times[i] for i in order[k:k + 50]], "n": order[k:k + 50]}) for k in range(0, 3000, 50))
    assert list(p.handleInputRows(("c",), pieces, Mark(0))) == [] and not p.waiting.v and p.shelves.v
    held, pieces_of = [], p._pieces
    p._pieces = lambda *a: (held.append(len(x)) or x for x in pieces_of(*a))
    ms = lambda i: times[i].value // 1_000_000
    first = pd.concat(p.handleExpiredTimer(("c",), Mark(ms(1234)), None))
    rest = pd.concat(p.handleExpiredTimer(("c",), Mark(ms(2999) + 5000), None))
    assert first["n"].tolist() == list(range(1235)) and rest["n"].tolist() == list(range(1235, 3000))
    assert max(sizes) <= 25 and max(held) <= 100 and not p.shelves.v and not p.parts.v and p._load() == 3000
