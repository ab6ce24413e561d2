"""Structured Streaming operators: ordered keyed state, live counts and incremental files."""
from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from visorlake.functions.boxes import values_of
from visorlake.operators import ball, tracks
from visorlake.operators.filters import filter_candidates
from visorlake.operators.tracks import FaceTracks
from visorlake.scale import ordered_scan
from visorlake.session import settle
from visorlake.streaming import posture, rules, strikes
from visorlake.streaming.posture import MEMORY, POSTURE, posture_states
from visorlake.streaming.rules import Gallery
from visorlake.streaming.strikes import ONLINE, hit_states

# The process in which a stream sets up its state sees no files added to the session, so the state classes travel by value.
for _module in (sys.modules[__name__], posture, rules, strikes, ball, tracks):
    cloudpickle.register_pickle_by_value(_module)

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
XY = ("x1", "y1", "x2", "y2")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of the operators below lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _plain(v):
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v]
    if isinstance(v, np.generic):
        return v.item()
    return v.value if isinstance(v, pd.Timestamp) else v


def _plain_rows(pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    """The rows as plain values, column by column; times as nanoseconds."""
    cols = []
    for c in (pdf[n] for n in names):
        kind = c.dtype.kind
        cols.append(c.to_numpy("datetime64[ns]").astype("int64").tolist() if kind == "M" else [_plain(v) for v in c] if kind == "O" else c.tolist())
    return list(zip(*cols, strict=True))


def _packed(rows: list[tuple]) -> tuple[bytes]:
    """Rows as one value of the state: a value crosses to the state store in the time of a row."""
    return (pickle.dumps(rows),)


def _unpacked(value: tuple) -> list[tuple]:
    return pickle.loads(bytes(value[0]))


#: Rows handed to a fold at a time.
CHUNK = 10_000
#: Rows of a key that wait in one list; when there are more, they wait on shelves by time.
HELD = 40_000


class InOrder(StatefulProcessor):
    """Feeds each key's rows to `fold` in time order.

    Rows wait until the watermark passes them, packed: in a list, or, once a key has more than `HELD`, on shelves by time, of which
    a task has at most so many rows in memory, however many wait (rows of one and the same time stay together). They are read only when some are due. Due rows
    are sorted and folded once, in pieces; a row older than what was folded is dropped. `fold(key, state, rows)` returns output rows and
    the new state: fields of `memory`, or a JSON-able value without. It is forgotten when event time has moved `forget_ms` past
    the key's last row.
    """

    def __init__(self, fold: Callable, columns: T.StructType, ts: str = "ts", tie: str | None = None, forget_ms: int | None = None, memory: str | None = None):
        self.fold, self.names, self.ts, self.tie, self.forget_ms = fold, columns.fieldNames(), columns.fieldNames().index(ts), tie, forget_ms
        self.kind = T.StructType.fromDDL(memory) if memory else T.StructType([T.StructField("s", T.StringType())])
        self.typed = memory is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", self.kind)
        self.times = handle.getValueState("times", "folded long, due long, listed long, width long, wake long")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.shelves = handle.getMapState("shelves", "no long", "parts int, n long")
        self.parts = handle.getMapState("parts", "no long, part int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self._times()
        for pdf in rows:
            self._wait(at, _plain_rows(pdf, self.names))
        yield from self._advance(key, at, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._times(), timerValues)

    def _times(self) -> dict:
        """The last time folded, a time no waiting row is before, rows in the list, nanoseconds of a shelf (None without shelves) and the timer."""
        return dict(zip(("folded", "due", "listed", "width", "wake"), self.times.get() or (None, None, 0, None, None), strict=True))

    def _load(self):
        v = self.memory.get()
        if v is None:
            return None
        return dict(zip(self.kind.fieldNames(), v, strict=True)) if self.typed else json.loads(v[0])

    def _save(self, state) -> None:
        self.memory.update(tuple(state[n] for n in self.kind.fieldNames()) if self.typed else (json.dumps(state),))

    def _listed(self) -> list[tuple]:
        return [r for piece in self.waiting.get() for r in _unpacked(piece)]

    def _wait(self, at: dict, new: list[tuple]) -> None:
        if not new:
            return
        times = [r[self.ts] for r in new]
        at["due"] = min(times) if at["due"] is None else min(at["due"], *times)
        if at["width"] is None and at["listed"] + len(new) > HELD:
            if at["listed"]:
                new = [*self._listed(), *new]
                self.waiting.clear()
                times = [r[self.ts] for r in new]
            at["listed"], at["width"] = 0, max((max(times) - min(times)) * CHUNK // len(new), 1)
        if at["width"] is None:
            self.waiting.appendList([_packed(new)])
            at["listed"] += len(new)
            return
        for no, rows in self._dealt(new, 0, at["width"]):
            parts, n = self.shelves.getValue((no,)) or (0, 0)
            self.parts.updateValue((no, parts), _packed(rows))
            self.shelves.updateValue((no,), (parts + 1, n + len(rows)))

    def _dealt(self, rows: list[tuple], start: int, width: int) -> list[tuple[int, list]]:
        dealt: dict[int, list] = {}
        for r in rows:
            dealt.setdefault((r[self.ts] - start) // width, []).append(r)
        return sorted(dealt.items())

    def _taken(self, no: int, parts: int) -> Iterator[list[tuple]]:
        for part in range(parts):
            rows = _unpacked(self.parts.getValue((no, part)))
            self.parts.removeKey((no, part))
            yield rows

    def _pieces(self, no: int, parts: int, n: int, start: int, width: int) -> Iterator[list[tuple]]:
        """The rows of a shelf by time, at most `HELD` at once; a fuller one, whose rows came in disorder, is dealt part by part to narrower ones first."""
        if n <= HELD or width == 1:
            yield [r for rows in self._taken(no, parts) for r in rows]
            return
        step, own = max(width * CHUNK // n, 1), {}
        for rows in self._taken(no, parts):
            for sub, some in self._dealt(rows, start, step):
                if sub not in own:
                    self.spare -= 1
                    own[sub] = [self.spare, 0, 0]
                self.parts.updateValue((own[sub][0], own[sub][1]), _packed(some))
                own[sub][1:] = own[sub][1] + 1, own[sub][2] + len(some)
        for sub in sorted(own):
            yield from self._pieces(*own[sub], start + sub * step, step)

    def _due(self, at: dict, mark: int) -> Iterator[list[tuple]]:
        """The rows that the watermark has passed, in order, taken from where they wait; `at` is brought up to the rest."""
        self.spare = -(1 << 62)                                                # names of narrower shelves, which no time has
        tie, folded = self.names.index(self.tie) if self.tie else self.ts, at["folded"]

        def split(held):
            due = sorted((r for r in held if r[self.ts] // 1_000_000 <= mark and (folded is None or r[self.ts] > folded)), key=lambda r: (r[self.ts], r[tie]))
            return due, [r for r in held if r[self.ts] // 1_000_000 > mark]

        at["due"] = None
        if at["width"] is None:
            due, rest = split(self._listed())
            if rest:
                self.waiting.put([_packed(rest)])
                at["due"] = min(r[self.ts] for r in rest)
            else:
                self.waiting.clear()
            at["listed"] = len(rest)
            yield due
            return
        for no in sorted(k[0] for k in self.shelves.keys()):
            if no * at["width"] // 1_000_000 > mark:
                at["due"] = no * at["width"] if at["due"] is None else at["due"]
                return
            parts, n, kept, left = *self.shelves.getValue((no,)), 0, 0
            for held in self._pieces(no, parts, n, no * at["width"], at["width"]):
                due, rest = split(held)
                if rest:
                    self.parts.updateValue((no, kept), _packed(rest))
                    kept, left = kept + 1, left + len(rest)
                    at["due"] = min(r[self.ts] for r in rest) if at["due"] is None else at["due"]
                yield due
            if kept:
                self.shelves.updateValue((no,), (kept, left))
            else:
                self.shelves.removeKey((no,))
        if at["due"] is None:
            at["width"] = None

    def _advance(self, key, at, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        if at["due"] is not None and at["due"] // 1_000_000 <= mark:
            state, some = None, False
            for due in self._due(at, mark):
                for lo in range(0, len(due), CHUNK):
                    state, some = state if some else self._load(), True
                    out, state = self.fold(key, state, pd.DataFrame(due[lo:lo + CHUNK], columns=self.names))
                    if len(out):
                        yield out
                at["folded"] = due[-1][self.ts] if due else at["folded"]
            if some:
                self._save(state)
        wake = None if at["due"] is None else at["due"] // 1_000_000
        if wake is None and self.forget_ms is not None and at["folded"] is not None:
            wake = at["folded"] // 1_000_000 + self.forget_ms
            if wake <= mark:
                self.memory.clear()
                at["folded"] = wake = None
        wake = None if wake is None else max(wake, mark + 1)
        if at["wake"] is not None and at["wake"] != wake:
            self.handle.deleteTimer(at["wake"])
        if wake is not None and at["wake"] != wake:
            self.handle.registerTimer(wake)
        at["wake"] = wake
        if at["folded"] is None and at["due"] is None:
            self.times.clear()
        else:
            self.times.update(tuple(at.values()))

    def close(self) -> None:
        pass


def _apply(df: DataFrame, key: str, fold, schema: T.StructType, delay: str, tie=None, forget_ms=None, memory=None) -> DataFrame:
    """Keyed ordered fold: stateful on a stream, `ordered_scan` on a table, same rows out."""
    cols = [c for c in df.columns if c != key]
    if not df.isStreaming:
        at = F.unix_micros("ts") / 1e6

        def batch(k, state, rows):
            return fold(k, state, rows.assign(ts=rows["ts"].astype("datetime64[ns]").astype("int64")))

        return ordered_scan(df.withColumn("_at", at), [key], "_at", ["_at"] + ([tie] if tie else []), batch, schema, span=1800, warmup=60)
    return (df.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        InOrder(fold, df.select(*cols).schema, tie=tie, forget_ms=forget_ms, memory=memory), outputStructType=schema, outputMode="Append", timeMode="EventTime"))


def _with_times(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Output rows whose `ts` is in nanoseconds."""
    out = pd.DataFrame(rows, columns=schema.fieldNames())
    return out.assign(ts=pd.to_datetime(out["ts"].to_numpy("int64")))


HITS = T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                     T.StructField("count", T.IntegerType()), T.StructField("state", T.StringType()),
                     T.StructField("fired", T.BooleanType()), T.StructField("fire_s", T.DoubleType())])


def stream_hit_counter(frames: DataFrame, delay: str = "2 seconds", forget_ms: int | None = 86_400_000) -> DataFrame:
    """Hit count, state and fire time per camera frame. Columns: camera_id, ts, balls, clubs (fractions of the picture), dx, dy.

    Candidates for the ball and the places of the clubs are columns; the operator follows the ball and keeps its last seconds and the open claim in typed
    state (`hit_states`). On a stream, a camera without frames for `forget_ms` is forgotten and counts from zero afterwards; None keeps it.
    """
    w, none = F.lit(ONLINE["width"]), F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>")
    boxes = frames.withColumns({a: F.filter(F.coalesce(a, none), lambda b: b.isNotNull()) for a in ("balls", "clubs")})
    sized = filter_candidates(boxes, "balls", rmin=ONLINE["r_least"] / ONLINE["width"], rmax=ONLINE["r_most"] / ONLINE["width"], floor=0.0, dedup_d=ONLINE["apart_d"])
    flat = sized.select(F.col("camera_id").cast("string").alias("camera_id"), "ts", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("dx", "dy")],
                        *[F.transform(values_of("cands", k), lambda v: v * w).alias(f"b{k}") for k in "xyr"],
                        *[F.zip_with(values_of("clubs", f"{k}1"), values_of("clubs", f"{k}2"), lambda p, q: (p + q) / 2 * w).alias(f"k{k}") for k in "xy"])

    def fold(key, state, rows):
        out, state = hit_states(state, rows)
        return out.assign(camera_id=str(key[0]), ts=pd.to_datetime(rows["ts"].to_numpy()))[HITS.fieldNames()], state

    return _apply(flat, "camera_id", fold, HITS, delay, forget_ms=forget_ms, memory=strikes.MEMORY)


ADDRESS = T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                        T.StructField("state", T.StringType()), T.StructField("confirmed", T.BooleanType())])


def stream_address_detector(frames: DataFrame, delay: str = "2 seconds", forget_ms: int | None = 3_600_000) -> DataFrame:
    """Posture state per frame. Columns: camera_id, ts, shoulder_x/y, hip_x/y (null when unseen), club_low.

    Whether somebody is there and leans are columns; the operator keeps runs of frames (`posture_states`) in typed state. A camera without
    frames for `forget_ms` starts anew.
    """
    seen = F.col("shoulder_x").isNotNull() & F.col("shoulder_y").isNotNull() & F.col("hip_x").isNotNull() & F.col("hip_y").isNotNull()
    steep = F.greatest(F.abs(F.col("shoulder_y") - F.col("hip_y")), F.lit(1e-4))
    leaning = seen & (F.abs(F.col("shoulder_x") - F.col("hip_x")) > POSTURE["lean"] * steep)
    flat = frames.select(F.col("camera_id").cast("string").alias("camera_id"), "ts", seen.alias("person"), F.coalesce(leaning, F.lit(False)).alias("leaning"),
                         F.coalesce("club_low", F.lit(False)).alias("club_low"), *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("hip_x", "hip_y")])

    def fold(key, state, rows):
        out, state = posture_states(state, rows)
        return out.assign(camera_id=str(key[0]), ts=pd.to_datetime(rows["ts"].to_numpy()))[ADDRESS.fieldNames()], state

    return _apply(flat, "camera_id", fold, ADDRESS, delay, forget_ms=forget_ms, memory=MEMORY)


FACES = T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                      T.StructField("det_no", T.IntegerType()), T.StructField("track_id", T.LongType()),
                      T.StructField("embed_due", T.BooleanType())])


def stream_face_tracker(frames: DataFrame, delay: str = "2 seconds", forget_ms: int | None = 3_600_000) -> DataFrame:
    """Face tracks per camera on a stream. Columns: camera_id, ts, frame_idx, faces. Idle cameras are forgotten."""
    flat = frames.select(F.col("camera_id").cast("string").alias("camera_id"), "ts", F.col("frame_idx").cast("int").alias("frame_idx"),
                         *[values_of("faces", c).alias(c) for c in XY])

    def fold(key, state, rows):
        tracker, out = FaceTracks(state), []
        for ts, frame, *xy in zip(*(rows[c] for c in ("ts", "frame_idx", *XY)), strict=True):
            out += [(str(key[0]), ts, d, t, due) for d, t, _, due in tracker.step(int(frame), [list(b) for b in zip(*xy)])]
        return _with_times(out, FACES), tracker.live

    return _apply(flat, "camera_id", fold, FACES, delay, forget_ms=forget_ms)


IDENTITIES = T.StructType([T.StructField("gallery_id", T.StringType()), T.StructField("face_id", T.LongType()),
                           T.StructField("person_id", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
                           T.StructField("decision", T.StringType())])


class GalleryState(StatefulProcessor):
    """One growing gallery per key; identities live in a map state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.people = handle.getMapState("people", "id int", "label string, template array<double>, count int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: [v[0], np.array(v[1]), v[2]] for k, v in self.people.iterator()} if self.people.exists() else {}
        gallery, out = Gallery(known), []
        touched = set()
        pdf = pd.concat(list(rows)).sort_values(["ts", "face_id"], kind="stable")
        for r in pdf.itertuples(index=False):
            pid, sim, what = gallery.observe(r.embedding, bool(r.known))
            if what != "keep":
                touched.add(pid)
            out.append((str(key[0]), int(r.face_id), pid, sim, what))
        for pid in touched:
            label, template, n = gallery.people[pid]
            self.people.updateValue((pid,), (label, [float(v) for v in template], n))
        yield pd.DataFrame(out, columns=IDENTITIES.fieldNames()).astype({"person_id": "Int32"})

    def close(self) -> None:
        pass


class OrderedGallery(InOrder):
    """A gallery that sees its faces in time order, however the stream is cut; only the people a piece of the stream changed are written."""

    def __init__(self, columns: T.StructType):
        super().__init__(self.observe_all, columns, tie="face_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.people = handle.getMapState("people", "id int", "label string, template array<double>, count int")

    def observe_all(self, key, gallery: Gallery, rows: pd.DataFrame):
        out = []
        for face, vec, known in zip(rows["face_id"], rows["embedding"], rows["known"], strict=True):
            person, similarity, what = gallery.observe(vec, bool(known))
            if what != "keep":
                gallery.changed.add(person)
            out.append((str(key[0]), int(face), person, similarity, what))
        return pd.DataFrame(out, columns=IDENTITIES.fieldNames()).astype({"person_id": "Int32"}), gallery

    def _load(self) -> Gallery:
        gallery = Gallery({k[0]: [v[0], np.array(v[1]), v[2]] for k, v in self.people.iterator()} if self.people.exists() else {})
        gallery.changed = set()
        return gallery

    def _save(self, gallery: Gallery) -> None:
        for person in gallery.changed:
            label, template, n = gallery.people[person]
            self.people.updateValue((person,), (label, [float(v) for v in template], n))


def stream_gallery(faces: DataFrame, delay: str | None = None) -> DataFrame:
    """Match, reinforce or enrol each face. Columns: gallery_id, ts, face_id, embedding, known (its track has an identity).

    A gallery is one state key, since every face may change it; separate sites get separate galleries. With `delay`, faces wait until the
    watermark passes them and are taken by time and face id, so identities do not depend on the batches; without, a batch is taken as it comes.
    """
    flat = faces.select(F.col("gallery_id").cast("string").alias("gallery_id"), "ts", F.col("face_id").cast("long").alias("face_id"),
                        F.col("embedding").cast("array<double>").alias("embedding"), "known")
    if delay is not None:
        waiting = flat.select("ts", "face_id", "embedding", "known").schema
        return (flat.withWatermark("ts", delay).groupBy("gallery_id")
                .transformWithStateInPandas(OrderedGallery(waiting), outputStructType=IDENTITIES, outputMode="Append", timeMode="EventTime"))
    return (flat.groupBy("gallery_id").transformWithStateInPandas(GalleryState(), outputStructType=IDENTITIES, outputMode="Append", timeMode="None"))


def stream_leaderboard(annotations: DataFrame) -> DataFrame:
    """Live annotations per user, refreshed every trigger (complete output)."""
    return (annotations.where(F.col("was_cancelled") == 0).groupBy(F.col("completed_by_id").alias("user_id"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_at")))


def stream_active_annotators(annotations: DataFrame, window: str = "300 seconds", slide: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """Distinct users with a live annotation per sliding window, exactly.

    State has two levels: one row per window and user, then one count per window; both end with the watermark.
    """
    rows = annotations.where(F.col("was_cancelled") == 0)
    rows = rows.withWatermark("updated_at", delay) if rows.isStreaming else rows
    users = rows.groupBy(F.window("updated_at", window, slide), "completed_by_id").agg(F.count(F.lit(1)).alias("n"))
    return users.groupBy("window").agg(F.count("completed_by_id").alias("active")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "active")


def emit_changes(df: DataFrame, key="camera_id", value="value", delay: str = "2 seconds", forget_ms: int | None = 86_400_000) -> DataFrame:
    """A key's value when it differs from the last one emitted. On a stream a key without rows for `forget_ms` is forgotten, so its next value is emitted; None keeps it."""
    return _gate(df, key, value, delay, lambda old, v, t: old is None or old["value"] != v, forget_ms)


def throttle(df: DataFrame, every_s: float = 0.5, key="camera_id", value="value", delay: str = "2 seconds") -> DataFrame:
    """At most one row of a key per `every_s` seconds. A key is forgotten once that time has passed, which changes nothing."""
    return _gate(df, key, value, delay, lambda old, v, t: old is None or t - old["at"] >= every_s * 1e9, int(every_s * 1000) + 1)


def _gate(df, key, value, delay, passes, forget_ms) -> DataFrame:
    flat = df.select(F.col(key).cast("string").alias(key), "ts", F.col(value).cast("string").alias(value))
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField(value, T.StringType())])

    def fold(k, state, rows):
        last, out = state, []
        for t, v in zip(rows["ts"], rows[value]):
            if passes(last, v, t):
                last = {"value": v, "at": int(t)}
                out.append((str(k[0]), t, v))
        return _with_times(out, schema), last

    return _apply(flat, key, fold, schema, delay, tie=value, forget_ms=forget_ms, memory="value string, at long")


def latest_per_interval(frames: DataFrame, interval: str = "1 second", model: str | None = None, key="camera_id", delay: str = "2 seconds") -> DataFrame:
    """Newest frame per camera and interval; rows of other models are dropped first."""
    rows = frames.where(F.col("model_id") == model) if model is not None else frames
    rows = rows.withWatermark("ts", delay) if frames.isStreaming else rows
    others = [c for c in frames.columns if c != key]
    return (rows.groupBy(key, F.window("ts", interval)).agg(F.max_by(F.struct(*others), F.struct("ts", F.xxhash64(*[F.col(c) for c in others if c != "ts"]))).alias("f"))
            .select(key, F.col("window.start").alias("interval_start"), "f.*"))


def guarded(fn: Callable[[dict], dict], fields: list[str]) -> Callable:
    """Wrap a per-item function for `mapInPandas`: a failing item becomes a row with its error text. An item is a dict of the row's columns."""
    def run(parts):
        for pdf in parts:
            out = []
            for values in zip(*(pdf[c] for c in pdf.columns), strict=True):
                item = dict(zip(pdf.columns, values, strict=True))
                try:
                    out.append({**fn(item), "error": None})
                except Exception as err:
                    out.append({**{f: item.get(f) for f in fields}, "error": str(err)})
            yield pd.DataFrame(out, columns=[*fields, "error"]).astype(object)
    return run


def _sorted_out(rows: DataFrame, fn: Callable[[dict], dict], fields: T.StructType, sink: str, failures: str, at: str) -> None:
    """Run `fn` on every row once; results go to `sink`, rows that failed go to `failures` as they are, with their error. A repeated call writes the same files."""
    kept = rows.columns
    both = T.StructType([*fields.fields, *[T.StructField(f"_in_{f.name}", f.dataType) for f in rows.schema.fields], T.StructField("error", T.StringType())])

    def run(parts):
        for pdf in parts:
            done = next(guarded(fn, fields.fieldNames())([pdf]))
            items = pdf.rename(columns={c: f"_in_{c}" for c in kept})
            yield pd.concat([done[fields.fieldNames()], items.reset_index(drop=True), done[["error"]]], axis=1)[both.fieldNames()]

    out = settle(rows.mapInPandas(run, both))
    out.where("error IS NULL").select(*fields.fieldNames()).write.mode("overwrite").parquet(f"{sink}/{at}")
    out.where("error IS NOT NULL").select(*[F.col(f"_in_{c}").alias(c) for c in kept], "error").write.mode("overwrite").parquet(f"{failures}/{at}")


def incremental_items(spark: SparkSession, source: str, schema: T.StructType, fn: Callable[[dict], dict], fields: T.StructType, sink: str, failures: str,
                      checkpoint: str, fmt: str = "json", files_per_batch: int = 1000, glob: str | None = None) -> StreamingQuery:
    """`fn` on every item of the files not seen before. Results and failure records are two outputs of one checkpoint: an item is in one of them.

    `fn` gives the columns `fields`; a failure record is the item with its error, so `retry_failures` can run it again.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)
    return (files.writeStream.foreachBatch(lambda rows, batch: _sorted_out(rows, fn, fields, sink, failures, f"attempt=0/batch={batch}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def retry_failures(spark: SparkSession, fn: Callable[[dict], dict], schema: T.StructType, fields: T.StructType, sink: str, failures: str) -> int:
    """Run the failure records of the last attempt again, as a new attempt; returns its number. Earlier records stay as a history."""
    found = read_attempts(spark, failures, T.StructType([*schema.fields, T.StructField("error", T.StringType())]))
    last = max(df.agg(F.max("attempt")).first()[0] or 0 for df in (found, read_attempts(spark, sink, fields)))
    _sorted_out(found.where(F.col("attempt") == last).select(*schema.fieldNames()), fn, fields, sink, failures, f"attempt={last + 1}/batch=0")
    return last + 1


def read_attempts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Results or failure records with the columns attempt and batch."""
    own = T.StructType([*schema.fields, T.StructField("attempt", T.IntegerType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(own).option("basePath", path).parquet(path)


def incremental_files(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, fmt: str = "json",
                      process: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000, glob: str | None = None) -> StreamingQuery:
    """Process only files not seen before and stop. The checkpoint remembers them across restarts."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)
    out = process(files) if process else files
    return (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
