"""Queries of tracks, events, streams, predictors and file formats."""
import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F, types as T

from visorlake.functions import names as N
from visorlake.functions.register import register_functions
from visorlake.operators import gallery, gestures, hits, joins, mining, predict as U, signals, tracks
from visorlake.plans.registry import query, rounded
from visorlake.plans.relations import event_boxes
from visorlake.session import settle
from visorlake.sinks import files as K
from visorlake.sources import frames as SF, labels as SL, tables as ST
from visorlake.streaming import live as L


def scratch(fx) -> str:
    """A new folder every executor can reach, removed when the application ends."""
    shared = fx.spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not fx.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = f"{shared}/visorlake-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="visorlake-")
    path = fx.spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(fx.spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


# ---- tracks and events -------------------------------------------------------------------------


@query("c08_build_tracks", """
    WITH RECURSIVE d AS MATERIALIZED (SELECT video_id, cls, frame_idx, event_id, x, y, greatest(r, 4.0) AS r, row_number() OVER (PARTITION BY video_id, cls ORDER BY frame_idx) AS n FROM $frames q),
    s(video_id, cls, n, frame_idx, event_id, track_id, live) AS (SELECT DISTINCT video_id, cls, CAST(0 AS BIGINT), CAST(0 AS INT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, k INT, x DOUBLE, y DOUBLE, r DOUBLE)[]) FROM d
      UNION ALL SELECT video_id, cls, n, frame_idx, event_id, coalesce(own.id, CAST(frame_idx AS BIGINT) * 4294967296),
        CASE WHEN own IS NULL THEN list_append(kept, {'id': CAST(frame_idx AS BIGINT) * 4294967296, 'k': frame_idx, 'x': x, 'y': y, 'r': r})
          ELSE list_transform(kept, lambda t: CASE WHEN t.id = own.id THEN {'id': t.id, 'k': frame_idx, 'x': x, 'y': y, 'r': r} ELSE t END) END FROM (
        SELECT *, list_filter(kept, lambda t: sqrt((t.x - x) * (t.x - x) + (t.y - y) * (t.y - y)) < 12.0 * t.r * (frame_idx - t.k))[1] AS own FROM (
          SELECT d.video_id, d.cls, d.n, d.frame_idx, d.event_id, d.x, d.y, d.r, list_filter(s.live, lambda t: d.frame_idx - t.k <= 8) AS kept FROM s JOIN d ON d.video_id = s.video_id AND d.cls = s.cls AND d.n = s.n + 1)))
    SELECT video_id, cls, frame_idx, event_id AS det_id, track_id FROM s WHERE n > 0""")
def _(fx):
    return tracks.build_tracks(event_boxes(fx), gate=12.0).select("video_id", "cls", "frame_idx", "det_id", "track_id")


# One turn of the recursion lets the next track of a frame choose; the last turn of a frame opens tracks for the boxes left and goes on to the next frame.
CROWDED_TRACKS = """
    WITH RECURSIVE d AS MATERIALIZED (SELECT video_id, cls, frame_idx, list({'no': det_no, 'e': event_id, 'x': x, 'y': y, 'r': r} ORDER BY det_no) AS boxes,
        row_number() OVER (PARTITION BY video_id, cls ORDER BY frame_idx) AS n FROM $crowd q WHERE shown GROUP BY video_id, cls, frame_idx),
    s(video_id, cls, n, k, turn, live, free, got) AS (
      SELECT video_id, cls, n, frame_idx, CAST(1 AS BIGINT), CAST([] AS STRUCT(id BIGINT, k INT, x DOUBLE, y DOUBLE, r DOUBLE)[]), boxes, CAST([] AS STRUCT(e BIGINT, id BIGINT)[]) FROM d WHERE n = 1
      UNION ALL
      SELECT video_id, cls, CASE WHEN choosing THEN n ELSE next_n END, CASE WHEN choosing THEN k ELSE next_k END, CASE WHEN choosing THEN turn + 1 ELSE 1 END,
        CASE WHEN choosing AND best IS NULL THEN live WHEN choosing THEN list_transform(live, lambda t, i: CASE WHEN i = turn THEN {'id': t.id, 'k': k, 'x': best.b.x, 'y': best.b.y, 'r': best.b.r} ELSE t END)
          ELSE list_filter(list_concat(live, list_transform(free, lambda b: {'id': CAST(k AS BIGINT) * 4294967296 + b.no, 'k': k, 'x': b.x, 'y': b.y, 'r': b.r})), lambda t: next_k - t.k <= 8) END,
        CASE WHEN NOT choosing THEN boxes WHEN best IS NULL THEN free ELSE list_filter(free, lambda b: b.no <> best.no) END,
        CASE WHEN choosing AND best IS NULL THEN [] WHEN choosing THEN [{'e': best.b.e, 'id': live[turn].id}] ELSE list_transform(free, lambda b: {'e': b.e, 'id': CAST(k AS BIGINT) * 4294967296 + b.no}) END
      FROM (SELECT s.*, d.boxes, d.n AS next_n, d.frame_idx AS next_k, s.turn <= len(s.live) AS choosing,
          CASE WHEN s.turn <= len(s.live) THEN list_filter(list_sort(list_transform(s.free, lambda b: {'d': sqrt((b.x - s.live[s.turn].x) * (b.x - s.live[s.turn].x) + (b.y - s.live[s.turn].y) * (b.y - s.live[s.turn].y)), 'no': b.no, 'b': b}))[1:1],
            lambda o: o.d < 3.0 * s.live[s.turn].r * (s.k - s.live[s.turn].k))[1] END AS best
        FROM s LEFT JOIN d ON d.video_id = s.video_id AND d.cls = s.cls AND d.n = s.n + 1 WHERE s.k IS NOT NULL) z)
    SELECT video_id, cls, g.e AS det_id, g.id AS track_id FROM (SELECT video_id, cls, unnest(got) AS g FROM s) o"""


@query("c08_build_tracks_crowded", CROWDED_TRACKS)
def _(fx):
    """Up to six objects of a class compete for the tracks of a frame."""
    c = fx.crowd.where("shown")
    d = c.select("video_id", "cls", "frame_idx", "det_no", F.col("event_id").alias("det_id"), *[(F.col(a) + s * F.col("r")).alias(f"{a}{i}") for i, s in ((1, -1), (2, 1)) for a in "xy"])
    return tracks.build_tracks(d, gate=3.0).select("video_id", "cls", "det_id", "track_id")


@query("c09_mine_hard_examples")
def _(fx):
    d = event_boxes(fx)
    d = d.withColumns({c: F.col(c) / (8 if c[0] == "x" else 6) for c in ("x1", "x2", "y1", "y2")})
    second = d.select("video_id", "frame_idx", "cls", "conf", *[(F.col(c) + 1).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return mining.mined_manifest(mining.mine_hard_examples(d, second, sample_every=0.4, cap_per_video=30))


@query("c11_iou_tracker", """
    WITH RECURSIVE f AS MATERIALIZED (SELECT video_id, frame_idx, event_id % 5 <> 0 AS c, x / 640 * 0.2 AS x, y / 480 * 0.2 AS y FROM $frames q),
    s(video_id, frame_idx, c, own, live) AS (SELECT video_id, CAST(-1 AS INT), FALSE, {'id': CAST(0 AS BIGINT), 'x': CAST(0 AS DOUBLE), 'y': CAST(0 AS DOUBLE), 'miss': 0, 'seen': 0, 'emb': 0, 'due': FALSE},
        CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, miss INT, seen INT, emb INT, due BOOLEAN)[]) FROM f GROUP BY 1
      UNION ALL SELECT video_id, frame_idx, c, own, CASE WHEN c AND NOT matched THEN list_append(rest, own) WHEN c THEN list_transform(rest, lambda t: CASE WHEN t.id = own.id THEN own ELSE t END) ELSE rest END FROM (
        SELECT video_id, frame_idx, c, best IS NOT NULL AS matched, CASE WHEN best IS NOT NULL THEN {'id': best.id, 'x': x, 'y': y, 'miss': 0, 'seen': best.seen + 1, 'emb': CASE WHEN frame_idx - best.emb >= 90 THEN frame_idx ELSE best.emb END, 'due': frame_idx - best.emb >= 90}
            ELSE {'id': CAST(frame_idx AS BIGINT) * 4294967296, 'x': x, 'y': y, 'miss': 0, 'seen': 1, 'emb': frame_idx, 'due': TRUE} END AS own,
          list_filter(list_transform(live, lambda t: CASE WHEN best IS NOT NULL AND t.id = best.id THEN t ELSE {'id': t.id, 'x': t.x, 'y': t.y, 'miss': t.miss + 1, 'seen': t.seen, 'emb': t.emb, 'due': t.due} END), lambda t: t.miss <= 8) AS rest FROM (
          SELECT *, CASE WHEN c THEN list_filter(live, lambda t: greatest(0.3 - abs(t.x - x), 0) * greatest(0.3 - abs(t.y - y), 0) / (0.18 - greatest(0.3 - abs(t.x - x), 0) * greatest(0.3 - abs(t.y - y), 0)) > 0.3
              AND greatest(0.3 - abs(t.x - x), 0) * greatest(0.3 - abs(t.y - y), 0) >= top - 1e-12)[1] END AS best FROM (
            SELECT f.*, s.live, list_max(list_transform(s.live, lambda t: greatest(0.3 - abs(t.x - f.x), 0) * greatest(0.3 - abs(t.y - f.y), 0))) AS top FROM s JOIN f ON f.video_id = s.video_id AND f.frame_idx = s.frame_idx + 1))))
    SELECT CAST(video_id AS VARCHAR) AS video_id, frame_idx, CAST(0 AS INT) AS det_no, own.id AS track_id, own.seen AS seen, own.due AS embed_due FROM s WHERE c""")
def _(fx):
    x, y = F.col("x") / 640 * 0.2, F.col("y") / 480 * 0.2
    face = F.struct(x.alias("x1"), y.alias("y1"), (x + 0.3).alias("x2"), (y + 0.3).alias("y2"), F.col("conf"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>")
    f = fx.frames.withColumn("faces", F.when(F.col("event_id") % 5 != 0, F.array(face)).otherwise(none))
    return tracks.iou_tracker(f)


# One turn takes the best pair left of a track and a face of the frame; when none is left, the frame is closed.
FACE_TURNS = """
    s(video_id, n, k, live, free, got) AS (
      SELECT video_id, n, frame_idx, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, miss INT, seen INT, emb INT, own INT)[]), boxes, CAST([] AS STRUCT(k INT, no INT, id BIGINT, seen INT, due BOOLEAN)[]) FROM f WHERE n = 1
      UNION ALL
      SELECT video_id, CASE WHEN best IS NULL THEN next_n ELSE n END, CASE WHEN best IS NULL THEN next_k ELSE k END,
        CASE WHEN best IS NULL THEN list_concat(list_filter(list_transform(live, lambda t: {'id': t.id, 'x1': t.x1, 'y1': t.y1, 'x2': t.x2, 'y2': t.y2, 'miss': CASE WHEN t.own IS NULL THEN t.miss + 1 ELSE 0 END, 'seen': t.seen, 'emb': t.emb, 'own': CAST(NULL AS INT)}), lambda t: t.miss <= 8),
            list_transform(free, lambda b: {'id': CAST(k AS BIGINT) * 4294967296 + b.no, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'miss': 0, 'seen': 1, 'emb': k, 'own': CAST(NULL AS INT)}))
          ELSE list_transform(live, lambda t, i: CASE WHEN i = best.t THEN {'id': t.id, 'x1': best.b.x1, 'y1': best.b.y1, 'x2': best.b.x2, 'y2': best.b.y2, 'miss': 0, 'seen': t.seen + 1, 'emb': CASE WHEN k - t.emb >= 90 THEN k ELSE t.emb END, 'own': best.no} ELSE t END) END,
        CASE WHEN best IS NULL THEN boxes ELSE list_filter(free, lambda b: b.no <> best.no) END,
        CASE WHEN best IS NULL THEN list_transform(free, lambda b: {'k': k, 'no': b.no, 'id': CAST(k AS BIGINT) * 4294967296 + b.no, 'seen': 1, 'due': TRUE})
          ELSE [{'k': k, 'no': best.no, 'id': live[best.t].id, 'seen': live[best.t].seen + 1, 'due': k - live[best.t].emb >= 90}] END
      FROM (SELECT s.*, f.boxes, f.n AS next_n, f.frame_idx AS next_k, list_filter(list_sort(flatten(list_transform(s.live, lambda t, i: list_transform(s.free, lambda b: {
            'o': CASE WHEN t.own IS NULL AND (t.x2 - t.x1) * (t.y2 - t.y1) <= 2.0 * (b.x2 - b.x1) * (b.y2 - b.y1) AND (b.x2 - b.x1) * (b.y2 - b.y1) <= 2.0 * (t.x2 - t.x1) * (t.y2 - t.y1) THEN
              -(greatest(least(t.x2, b.x2) - greatest(t.x1, b.x1), 0) * greatest(least(t.y2, b.y2) - greatest(t.y1, b.y1), 0)) / ((t.x2 - t.x1) * (t.y2 - t.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
                - greatest(least(t.x2, b.x2) - greatest(t.x1, b.x1), 0) * greatest(least(t.y2, b.y2) - greatest(t.y1, b.y1), 0)) ELSE 0.0 END, 't': i, 'no': b.no, 'b': b}))))[1:1], lambda p: p.o < -0.3)[1] AS best
        FROM s LEFT JOIN f ON f.video_id = s.video_id AND f.n = s.n + 1 WHERE s.k IS NOT NULL) z)"""
CROWDED_FACES = """
    WITH RECURSIVE d AS MATERIALIZED (SELECT video_id, frame_idx, list({'e': det_no, 'x1': x - 20, 'y1': y - 20, 'x2': x + 20 + r, 'y2': y + 14 + r} ORDER BY det_no) FILTER (WHERE shown) AS faces,
        row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM $crowd q GROUP BY video_id, frame_idx),
    f AS MATERIALIZED (SELECT video_id, frame_idx, n, list_transform(coalesce(faces, []), lambda b, i: {'no': CAST(i - 1 AS INT), 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}) AS boxes FROM d),
""" + FACE_TURNS + """
    SELECT CAST(video_id AS VARCHAR) AS video_id, g.k AS frame_idx, g.no AS det_no, g.id AS track_id, g.seen AS seen, g.due AS embed_due FROM (SELECT video_id, unnest(got) AS g FROM s) o"""


@query("c11_iou_tracker_crowded", CROWDED_FACES)
def _(fx):
    """Up to six faces a frame whose boxes overlap several tracks; some frames are empty."""
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    face = F.struct("det_no", F.struct((x - 20).alias("x1"), (y - 20).alias("y1"), (x + 20 + r).alias("x2"), (y + 14 + r).alias("y2"), F.lit(0.9).alias("conf")).alias("b"))
    f = fx.crowd.groupBy("video_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), face))), lambda s: s["b"]).alias("faces"))
    return tracks.iou_tracker(f)


@query("c12_primary_track_crowded", """
    WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, x, y, shown ORDER BY det_no) = 1 AND shown AS fits FROM $crowd q),
    f AS MATERIALIZED (SELECT video_id, frame_idx, coalesce(list({'no': det_no, 'x': 2 * x, 'y': 2 * y, 'r': r} ORDER BY det_no) FILTER (WHERE fits), []) AS balls, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM d GROUP BY 1, 2),
    s(video_id, n, frame_idx, x, y, r, lost) AS (SELECT video_id, CAST(0 AS BIGINT), CAST(-1 AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS INT) FROM f WHERE n = 1
      UNION ALL SELECT video_id, n, k, CASE WHEN best IS NOT NULL THEN best.b.x WHEN lost < 20 THEN x END, CASE WHEN best IS NOT NULL THEN best.b.y WHEN lost < 20 THEN y END,
        CASE WHEN best IS NOT NULL THEN best.b.r WHEN lost < 20 THEN r END, CASE WHEN best IS NOT NULL OR x IS NULL OR lost >= 20 THEN 0 ELSE lost + 1 END FROM (
        SELECT s.video_id, f.n, f.frame_idx AS k, s.x, s.y, s.r, s.lost, list_filter(list_sort(list_transform(f.balls, lambda b: {
            'd': CASE WHEN s.x IS NULL THEN -b.r ELSE sqrt((b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y)) END, 'no': b.no, 'b': b}))[1:1],
            lambda o: s.x IS NULL OR o.d < (CASE WHEN s.lost = 0 THEN 2.0 ELSE 1.5 END) * 2 * s.r)[1] AS best
        FROM s JOIN f ON f.video_id = s.video_id AND f.n = s.n + 1) z)
    SELECT CAST(video_id AS VARCHAR) AS video_id, frame_idx, CASE WHEN lost = 0 THEN x END AS x, CASE WHEN lost = 0 THEN y END AS y, CASE WHEN lost = 0 THEN r END AS r FROM s WHERE n > 0""")
def _(fx):
    """The followed ball among up to six, still camera, short reach; two at one place are one, and equal distances go to the earlier box."""
    x, y, r = 2 * F.col("x"), 2 * F.col("y"), F.col("r")
    ball = F.struct("det_no", F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2"), F.lit(0.9).alias("conf")).alias("b"))
    f = fx.crowd.groupBy("video_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), ball))), lambda s: s["b"]).alias("balls"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>")
    f = f.withColumns({"clubs": none, "cam": F.lit(None).cast("array<double>")})
    return rounded(tracks.primary_track(f, fps=10.0, near=2.0, far=1.5), "x", "y", "r")


@query("c12_primary_track", """
    WITH RECURSIVE f AS MATERIALIZED (SELECT video_id, frame_idx, event_id % 7 <> 0 AS c, x, y, greatest(r, 6.0) AS r, CASE WHEN event_id % 13 <> 0 THEN event_id % 5 ELSE 0 END AS tx, CASE WHEN event_id % 13 <> 0 THEN event_id % 3 ELSE 0 END AS ty FROM $frames q),
    s(video_id, frame_idx, has, bx, bv, br, px, py, lost) AS (SELECT video_id, CAST(-1 AS INT), FALSE, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM f GROUP BY 1
      UNION ALL SELECT video_id, frame_idx, CASE WHEN NOT has THEN c ELSE hit OR lost + 1 <= 20 END, CASE WHEN hit OR NOT has THEN x ELSE bx END, CASE WHEN hit OR NOT has THEN y ELSE bv END, CASE WHEN hit OR NOT has THEN r ELSE br END,
        hx, hy, CASE WHEN hit OR NOT has OR lost + 1 > 20 THEN 0 ELSE lost + 1 END FROM (
        SELECT *, has AND c AND sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) < (CASE WHEN lost = 0 THEN 5.0 ELSE 2.5 END) * 2 * br AS hit FROM (
          SELECT f.video_id, f.frame_idx, f.c, f.x, f.y, f.r, s.has, s.bx, s.bv, s.br, s.lost, CASE WHEN s.lost = 0 THEN s.bx ELSE s.px END + f.tx AS hx, CASE WHEN s.lost = 0 THEN s.bv ELSE s.py END + f.ty AS hy
          FROM s JOIN f ON f.video_id = s.video_id AND f.frame_idx = s.frame_idx + 1)))
    SELECT CAST(video_id AS VARCHAR) AS video_id, frame_idx, CASE WHEN has AND lost = 0 THEN bx END AS x, CASE WHEN has AND lost = 0 THEN bv END AS y, CASE WHEN has AND lost = 0 THEN br END AS r FROM s WHERE frame_idx >= 0""")
def _(fx):
    return rounded(tracks.primary_track(fx.live, fps=10.0), "x", "y", "r")


def clips(fx):
    """Each event as a frame of a clip: a ball at rest with a club near it, then rolling away or gone."""
    f = fx.frames.select("video_id", "frame_idx", "event_id")
    phase, e = F.col("frame_idx") % 64, F.col("event_id")
    rolls = F.col("video_id") % 2 == 0
    x = F.lit(900.0) + F.col("video_id") % 7 + (e % 3) + F.when(rolls & (phase >= 32), (phase - 31) * 60.0).otherwise(0.0)
    y = F.lit(700.0) + (e % 2)

    def rect(x, y, r):
        return F.array(F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2"), F.lit(0.9).alias("conf")))

    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>")
    shown = (phase < 32) | (rolls & (phase < 44))
    return f.withColumns({"balls": F.when(shown, rect(x, y, 20.0)).otherwise(none), "clubs": F.when(phase.between(8, 31), rect(x + 50, y, 25.0)).otherwise(none),
                          "cam": F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))})


# Each period of 64 frames of a clip holds one strike: the ball rests up to frame 31, then rolls off (even videos) or is gone from frame 32 on. It is counted once
# what follows has been watched: {look} frames from the rest, or 16 frames after it has been missing for four.
STRIKES = """
    SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(64 * k + CASE WHEN video_id % 2 = 0 THEN 31 ELSE 32 END AS INT) AS hit
    FROM (SELECT video_id, max(frame_idx) AS n FROM $frames q GROUP BY 1) v, (SELECT unnest(range(0, 20000)) AS k) z
    WHERE 64 * k + CASE WHEN video_id % 2 = 0 THEN 31 + {look} ELSE 50 END <= n"""


@query("c13_detect_hits_ego", STRIKES.format(look=32))
def _(fx):
    return hits.detect_hits(clips(fx), 16.0, "ego")


@query("c13_detect_hits_raw", STRIKES.format(look=32))
def _(fx):
    return hits.detect_hits(clips(fx), 16.0, "raw")


@query("c14_detect_hits_boxonly", STRIKES.format(look=48))
def _(fx):
    return hits.detect_hits(clips(fx), 16.0, "boxonly")


@query("e2_status_of_clips")
def _(fx):
    """Hits, tracks, speeds and the status per frame of every clip, end to end."""
    c = clips(fx)
    events = settle(hits.hit_events(c, 16.0))
    armed = hits.armed_frames(events).withColumn("armed", F.lit(True))
    track = settle(tracks.primary_track(c, 16.0))
    found = events.where("kind = 'hit'").select("video_id", F.col("frame_idx").alias("hit"))
    base = c.select(F.col("video_id").cast("string").alias("video_id"), "frame_idx", "cam")
    speed = signals.ego_speed(track.join(base, ["video_id", "frame_idx"]).withColumn("diameter", 2 * F.col("r")), 16.0)
    made = joins.made_putts(found, track, track.where("x IS NOT NULL").select("video_id", "frame_idx", (F.col("x") + 1e4).alias("x1"), "y", (F.col("x") + 2e4).alias("x2"))
                            .withColumns({"y1": F.col("y"), "y2": F.col("y")}), 16.0)
    frames = base.join(armed, ["video_id", "frame_idx"], "left").withColumn("armed", F.coalesce("armed", F.lit(False)))
    status = joins.status_timeline(frames.drop("cam"), made, 16.0)
    peaks = signals.peak_in_window(made, speed, 16.0)
    per = status.groupBy("video_id", "status").agg(F.count(F.lit(1)).alias("frames"))
    return per.join(peaks.groupBy("video_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("peak"), 4).alias("peak_mps")), "video_id", "left")


@query("c15_identify_faces", """
    SELECT vec_id AS id, CASE WHEN s >= 0.30 THEN 'reinforce' WHEN s < 0.25 AND vec_id % 4 <> 0 THEN 'enrol' ELSE 'keep' END AS decision FROM (SELECT a.vec_id, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s
      FROM embeddings a, embeddings b WHERE a.vec_id % 10 <> 0 AND b.vec_id % 50 = 0 GROUP BY 1)""")
def _(fx):
    e = fx.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 4 == 0).alias("known"))
    return gallery.identify_faces(e.where("id % 10 <> 0"), e.where("id % 50 = 0"), known="known", template="embedding").select("id", "decision")


@query("c16_gesture_classifier")
def _(fx):
    p = fx.points.select("vec_id", F.concat(F.lit("g"), F.col("label").cast("string")).alias("gesture"), "points")
    sides = [p.where("vec_id % 5 <> 0"), p.where("vec_id % 5 = 0")]
    rows, held = (gestures.gesture_rows(s, *caps, id="vec_id", positive=("g0", "g1")) for s, caps in zip(sides, ((400, 60), (0, 0)), strict=True))
    model = gestures.train_gesture_classifier(rows, max_iter=20)
    return rounded(gestures.evaluate_gestures(model, held), "accuracy", "precision", "recall", "f1", digits=3)


# ---- streams -----------------------------------------------------------------------------------


def stream_of(fx, table: str):
    """A given table as a file stream, be it one file or a folder of files: a pattern may name either."""
    schema = fx.table(table).schema
    return _timed(fx.spark.readStream.schema(schema).parquet(f"{fx.folder}/{table}.parque[t]"), schema)


def _timed(rows, schema):
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else rows


def drained(fx, df, mode: str = "append"):
    """Run a stream over what is there and read back the rows it wrote."""
    out = scratch(fx)
    schema = df.schema
    L.use_state_store(fx.spark)

    def put(rows, batch):
        rows.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={batch}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return fx.spark.read.schema(schema).parquet(f"{out}/rows").select(*schema.fieldNames())


END = -1


def ended(fx):
    """The events as a stream, and after them an event of camera END two days later that lets the watermark pass all others.

    A bounded source is read in one batch; without the last event, rows within the delay of the end would wait for ever. It has the largest time and the
    largest number, as some queries make their own times of the number.
    """
    events, folder = fx.table("events"), scratch(fx)
    last, no = events.agg(F.max("ts"), F.max("event_id")).first()
    if last is not None:
        end = events.where(F.col("ts") == F.lit(last)).limit(1)
        end.withColumns({"user_id": F.lit(END).cast(events.schema["user_id"].dataType), "event_type": F.lit("click"),
                         "event_id": F.lit(no).cast(events.schema["event_id"].dataType), "ts": F.col("ts") + F.expr("INTERVAL 2 DAYS")}).select(events.columns).write.mode("overwrite").parquet(f"{folder}/end")
        rows = fx.spark.readStream.schema(events.schema).parquet(f"{folder}/end")
        return stream_of(fx, "events").unionByName(_timed(rows, events.schema))
    return stream_of(fx, "events")


def live(fx, df):
    """All rows that a stream over `ended` events gives for real cameras."""
    return drained(fx, df).where(F.col("camera_id").cast("string") != str(END))


def _live_events(fx):
    e = F.col("event_id")
    x, y, r = (e * 97 % 100) / 1000.0 + 0.4, (e * 61 % 100) / 1000.0 + 0.4, 0.02
    ball = F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2"), F.lit(0.9).alias("conf"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>")
    return ended(fx).select(F.col("user_id").alias("camera_id"), "ts", F.array(ball).alias("balls"), F.when(e % 2 == 0, F.array(ball)).otherwise(none).alias("clubs"),
                                          F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "event_id", "event_type", "value")


@query("t01_stream_hit_counter")
def _(fx):
    return live(fx, L.stream_hit_counter(_live_events(fx), forget_ms=None))


# Eight cameras at a frame every 52 ms. In each period of 120 frames a ball rests for 60 and has a club near it in the last 40 of them; then it is gone (even cameras)
# or rolls off for 20 frames (odd ones). It counts as at rest from frame 4 on. A ball that is gone is claimed in frame 65 and counted in 85; one that rolls in 69 and 98.
# Cameras from 4 on tremble; camera 6 turns away from its ball, which must not count.
@query("t01_stream_hit_counter_strikes", """
    WITH e AS (SELECT event_id % 8 AS cam, event_id // 8 AS no, event_id // 8 % 120 AS ph FROM events),
    q AS (SELECT *, CASE WHEN cam % 2 = 1 THEN 69 ELSE 65 END AS claimed, CASE WHEN cam % 2 = 1 THEN 98 WHEN cam = 6 THEN 65 ELSE 85 END AS ends, cam % 2 = 0 AS gone FROM e)
    SELECT CAST(cam AS VARCHAR) AS camera_id, make_timestamp((no + 1) * 52000) AS ts, CAST(CASE WHEN cam <> 6 AND no >= ends THEN (no - ends) // 120 + 1 ELSE 0 END AS INT) AS "count",
      CASE WHEN ph < 4 THEN 'TRACK' WHEN ph < claimed OR (gone AND ph = ends) THEN 'ADDRESS' WHEN ph < ends THEN 'PEND' ELSE 'SEARCH' END AS state,
      cam <> 6 AND ph = ends AS fired, CASE WHEN cam <> 6 AND ph = ends THEN (no - ends + 60) * 52000000 / 1e9 END AS fire_s FROM q""")
def _(fx):
    e, last = F.col("event_id"), F.col("camera_id") == END
    cam, no = e % 8, F.floor(e / 8).cast("long")
    ph, turns = no % 120, cam == 6
    away, shake = turns & ph.between(60, 69), F.when(cam >= 4, no % 2 * 2).otherwise(0)
    x = F.when(turns, 0.15).otherwise(0.5) + shake / 640.0 + F.when((cam % 2 == 1) & (ph >= 60), (ph - 59) * 0.022).otherwise(0.0)

    def rect(x, y, r, when):
        one = F.array(F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2"), F.lit(0.9).alias("conf")))
        return F.when(when, one).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,conf:double>>"))

    f = _live_events(fx).select(F.when(last, F.lit(END).cast("long")).otherwise(cam).alias("camera_id"),
                                (F.timestamp_millis((no + 1) * 52) + F.when(last, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("ts"),
                                rect(x, F.lit(0.5), 0.02, (ph < 60) | ((cam % 2 == 1) & (ph < 80))).alias("balls"), rect(x + 0.03, F.lit(0.52), 0.02, ph.between(20, 59)).alias("clubs"),
                                F.when(away, -40.0).when(cam >= 4, F.when(no % 2 == 1, 2.0).otherwise(-2.0)).otherwise(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return live(fx, L.stream_hit_counter(f, forget_ms=None))


@query("t02_stream_address_detector", """
    WITH e AS (SELECT user_id % 8 AS cam, (event_id + 1) * 25 AS ms, event_id % 9 <> 0 AND event_id // 60 % 4 <> 0 AS person, event_id % 3 = 0 AND event_id // 150 % 3 <> 0 AS low, event_id // 40 % 3 * 0.03 AS hip FROM events),
    p AS (SELECT *, person AND bool_or(low) OVER (PARTITION BY cam ORDER BY ms RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS posture FROM e),
    c AS (SELECT *, CASE WHEN posture IS DISTINCT FROM lag(posture) OVER (PARTITION BY cam ORDER BY ms) THEN 1 ELSE 0 END AS change FROM p),
    r AS (SELECT *, sum(change) OVER (PARTITION BY cam ORDER BY ms) AS run FROM c),
    w AS (SELECT *, min(ms) OVER (PARTITION BY cam, run) AS begun, count(*) OVER z AS n, max(hip) OVER z - min(hip) OVER z AS moved FROM r WINDOW z AS (PARTITION BY cam, run ORDER BY ms RANGE BETWEEN 400 PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, posture AND n > 2 AND moved <= 0.04 AND ms - begun >= 400 AS ok, NOT posture AND ms - begun >= 600 AS away FROM w),
    l AS (SELECT *, max(CASE WHEN ok THEN ms END) OVER (PARTITION BY cam ORDER BY ms) AS ok_at, max(CASE WHEN away THEN ms END) OVER (PARTITION BY cam ORDER BY ms) AS away_at,
      max(CASE WHEN ok THEN ms END) OVER (PARTITION BY cam ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok_before FROM k),
    n AS (SELECT *, CASE WHEN posture AND coalesce(ok_at, -1) > coalesce(away_at, -1) THEN 'PROMPT' WHEN posture THEN 'POSTURE' END AS said FROM l),
    o AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY cam ORDER BY ms) AS kept FROM n)
    SELECT CAST(cam AS VARCHAR) AS camera_id, make_timestamp(ms * 1000) AS ts, CASE WHEN away OR kept IS NULL THEN CASE WHEN person THEN 'HUMAN' ELSE 'SEARCHING' END ELSE kept END AS state,
      ok AND coalesce(ok_before, -1) <= coalesce(away_at, -1) AS confirmed FROM o""")
def _(fx):
    """Eight cameras of some 5 frames a second: people come and go, clubs are low at times, hips move now and then."""
    e, last = F.col("event_id"), F.col("camera_id") == END
    part = lambda n: F.floor(e / n).cast("long")
    seen = (e % 9 != 0) & (part(60) % 4 != 0)
    f = _live_events(fx).select(F.when(last, F.lit(END).cast("long")).otherwise(F.col("camera_id") % 8).alias("camera_id"),
                                (F.timestamp_millis((e + 1) * 25) + F.when(last, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("ts"),
                                F.when(seen, 0.6 + (e % 4) / 10.0).alias("shoulder_x"), F.when(seen, F.lit(0.3)).alias("shoulder_y"),
                                F.when(seen, F.lit(0.4)).alias("hip_x"), F.when(seen, F.lit(0.6) + part(40) % 3 * 0.03).alias("hip_y"), ((e % 3 == 0) & (part(150) % 3 != 0)).alias("club_low"))
    return live(fx, L.stream_address_detector(f))


@query("t03_stream_face_tracker", """
    WITH RECURSIVE f AS MATERIALIZED (SELECT video_id, frame_idx, n, [{'no': CAST(0 AS INT), 'x1': x - 0.02, 'y1': y - 0.02, 'x2': x + 0.02, 'y2': y + 0.02}] AS boxes FROM (
        SELECT user_id AS video_id, CAST(event_id AS INT) AS frame_idx, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n,
          CAST(event_id * 97 % 100 AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS x, CAST(event_id * 61 % 100 AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS y FROM events) e),
""" + FACE_TURNS + """
    SELECT CAST(video_id AS VARCHAR) AS camera_id, ev.ts AS ts, g.no AS det_no, g.id AS track_id, g.due AS embed_due FROM (SELECT video_id, unnest(got) AS g FROM s) o JOIN events ev ON ev.event_id = g.k""")
def _(fx):
    f = _live_events(fx).select("camera_id", "ts", F.col("event_id").cast("int").alias("frame_idx"), F.col("balls").alias("faces"))
    return live(fx, L.stream_face_tracker(f))


UNIT = "list_transform([{x}], lambda q: list_transform(q, lambda a: a / (sqrt(list_inner_product(q, q)) + 1e-9)))[1]"


@query("t04_stream_gallery", f"""
    WITH RECURSIVE f AS MATERIALIZED (SELECT label % 4 AS g, vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 3 = 0 AS known, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS n FROM embeddings),
    s(g, n, people, vec_id, pid, sim, what) AS (
      SELECT g, CAST(0 AS BIGINT), CAST([] AS STRUCT(t DOUBLE[], c BIGINT)[]), CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS DOUBLE), '' FROM f GROUP BY g
      UNION ALL SELECT g, n, CASE what WHEN 'reinforce' THEN list_transform(people, lambda p, i: CASE WHEN i = best THEN {{'t': {UNIT.format(x="list_transform(range(1, len(v) + 1), lambda j: (p.t[j] * p.c + v[j]) / (p.c + 1))")}, 'c': p.c + 1}} ELSE p END)
          WHEN 'enrol' THEN list_append(people, {{'t': {UNIT.format(x="v")}, 'c': CAST(1 AS BIGINT)}}) ELSE people END, vec_id, CASE what WHEN 'reinforce' THEN best WHEN 'enrol' THEN len(people) + 1 END, CASE what WHEN 'enrol' THEN 1.0 ELSE top END, what
        FROM (SELECT *, CASE WHEN top >= 0.30 THEN 'reinforce' WHEN NOT known AND top < 0.25 THEN 'enrol' ELSE 'keep' END AS what FROM (
          SELECT *, coalesce(list_max(sims), -1.0) AS top, list_position(sims, list_max(sims)) AS best FROM (
            SELECT s.g, f.n, f.vec_id, f.v, f.known, s.people, list_transform(s.people, lambda p: list_inner_product(p.t, f.v)) AS sims FROM s JOIN f ON f.g = s.g AND f.n = s.n + 1))))
    SELECT CAST(g AS VARCHAR) AS gallery_id, vec_id AS face_id, CAST(pid AS INT) AS person_id, round(sim, 4) AS similarity, what AS decision FROM s WHERE n > 0""")
def _(fx):
    e, folder = fx.table("embeddings"), scratch(fx)
    last = e.agg(F.max("vec_id")).first()[0] or 0
    e.limit(1).withColumns({"vec_id": F.lit(last + 86_400).cast("long"), "label": F.lit(END).cast(e.schema["label"].dataType)}).write.mode("overwrite").parquet(f"{folder}/end")
    rows = stream_of(fx, "embeddings").unionByName(fx.spark.readStream.schema(e.schema).parquet(f"{folder}/end"))
    s = rows.select((F.col("label") % 4).alias("gallery_id"), F.timestamp_seconds(F.col("vec_id") + 10).alias("ts"), F.col("vec_id").alias("face_id"),
                    "embedding", (F.col("vec_id") % 3 == 0).alias("known"))
    return rounded(drained(fx, L.stream_gallery(s, "2 seconds")).where(F.col("gallery_id") != str(END)), "similarity", digits=4)


@query("t05_stream_leaderboard", "SELECT completed_by_id AS user_id, count(*) AS n, max(updated_at) AS last_at FROM $annotations a WHERE was_cancelled = 0 GROUP BY 1")
def _(fx):
    o = stream_of(fx, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 60).alias("completed_by_id"), (F.col("o_orderstatus") == "P").cast("int").alias("was_cancelled"), F.col("o_orderdate").alias("updated_at"))
    return drained(fx, L.stream_leaderboard(o), "complete")


@query("t05_stream_active_annotators", """
    SELECT start, start + INTERVAL 7 DAY AS "end", count(DISTINCT u) AS active FROM (
      SELECT u, date_trunc('day', stamp) - to_days(CAST(k AS INTEGER)) AS start FROM (SELECT completed_by_id AS u, CAST(updated_at AS TIMESTAMP) AS stamp FROM $annotations q WHERE was_cancelled = 0) a, (SELECT unnest(range(0, 7)) AS k) z) w
    WHERE start + INTERVAL 7 DAY <= (SELECT max(CAST(updated_at AS TIMESTAMP)) FROM $annotations q WHERE was_cancelled = 0) - INTERVAL 1 DAY GROUP BY start""")
def _(fx):
    o = stream_of(fx, "orders").select((F.col("o_orderkey") % 60).alias("completed_by_id"), (F.col("o_orderstatus") == "P").cast("int").alias("was_cancelled"), F.col("o_orderdate").alias("updated_at"))
    return drained(fx, L.stream_active_annotators(o, "7 days", "1 day", "1 day"))


@query("t06_emit_changes", """
    SELECT camera_id, ts, value FROM (SELECT CAST(user_id AS VARCHAR) AS camera_id, ts, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) e WHERE value IS DISTINCT FROM before""")
def _(fx):
    return live(fx, L.emit_changes(_live_events(fx).drop("value").withColumnRenamed("event_type", "value"), forget_ms=None))


@query("t06_throttle", """
    WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS camera_id, ts, event_type AS value FROM events),
    s(camera_id, ts) AS (SELECT camera_id, min(ts) FROM e GROUP BY 1 UNION ALL SELECT camera_id, nx FROM (SELECT s.camera_id, (SELECT min(e.ts) FROM e WHERE e.camera_id = s.camera_id AND e.ts >= s.ts + INTERVAL 1 DAY) AS nx FROM s) WHERE nx IS NOT NULL)
    SELECT s.camera_id, s.ts, min(e.value) AS value FROM s JOIN e ON e.camera_id = s.camera_id AND e.ts = s.ts GROUP BY 1, 2""")
def _(fx):
    return live(fx, L.throttle(_live_events(fx).drop("value").withColumnRenamed("event_type", "value"), every_s=86_400.0))


@query("t07_latest_per_interval", """
    SELECT camera_id, interval_start, event_id FROM (SELECT user_id AS camera_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS interval_start, arg_max(event_id, ts) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) e""")
def _(fx):
    f = _live_events(fx).select("camera_id", "ts", F.col("event_type").alias("model_id"), "event_id")
    return live(fx, L.latest_per_interval(f, "1 day", "click")).select("camera_id", "interval_start", "event_id")


@query("t08_incremental_files", "SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(fx):
    out = scratch(fx)
    for _ in range(2):          # the second run finds nothing new
        L.incremental_files(fx.spark, f"{fx.folder}/orders.parque[t]", fx.table("orders").schema, f"{out}/rows", f"{out}/log", "parquet",
                            lambda df: df.where("o_totalprice > 1000").select(F.col("o_orderpriority").alias("source"))).awaitTermination()
    return fx.spark.read.parquet(f"{out}/rows").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("t08_failure_records", """
    SELECT CAST(0 AS INT) AS attempt, 'done' AS what, count(*) AS n, CAST(sum(o_orderkey * 2) AS BIGINT) AS total FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT 0, 'failed', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT 1, 'done', count(*), CAST(sum(o_orderkey * 2) AS BIGINT) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 21 <> 0
    UNION ALL SELECT 1, 'failed', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 21 = 0""")
def _(fx):
    """A seventh of the items fail; run again with a better function, a third of those do."""
    out, schema, fields = scratch(fx), fx.table("orders").schema, T.StructType.fromDDL("key long, double_key long")
    item = T.StructType([f for f in schema.fields if f.name == "o_orderkey"])

    def work(bad):
        def fn(row):
            if row["o_orderkey"] % bad == 0:
                raise ValueError(f"cannot read {row['o_orderkey']}")
            return {"key": row["o_orderkey"], "double_key": 2 * row["o_orderkey"]}
        return fn

    paths = f"{out}/done", f"{out}/failed"
    for _ in range(2):          # the second run finds nothing new
        L.incremental_items(fx.spark, f"{fx.folder}/orders.parque[t]", item, work(7), fields, *paths, f"{out}/log", "parquet").awaitTermination()
    L.retry_failures(fx.spark, work(21), item, fields, *paths)
    done = L.read_attempts(fx.spark, paths[0], fields).groupBy("attempt").agg(F.lit("done").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("double_key").alias("total"))
    failed = L.read_attempts(fx.spark, paths[1], T.StructType([*item.fields, T.StructField("error", T.StringType())])).where("error LIKE 'cannot read%'")
    return done.unionByName(failed.groupBy("attempt").agg(F.lit("failed").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total")))


# ---- predictors --------------------------------------------------------------------------------

STUB = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _stub(mul: int):
    def factory():
        return lambda pdf: pd.DataFrame({"sample_id": pdf["sample_id"], "score": (pdf["sample_id"] * mul % 101) / 101.0})
    return factory


@query("u01_predict", "SELECT sample_id, round((sample_id * 37 % 101) / 101.0, 9) AS score FROM $samples q")
def _(fx):
    return rounded(U.predict(fx.samples.select("sample_id"), _stub(37), STUB), "score", digits=9)


@query("u02_predict_cached", "SELECT sample_id, round((sample_id * 37 % 101) / 101.0, 9) AS score FROM $samples q WHERE sample_id % 2 = 0 AND (sample_id * 37 % 101) / 101.0 >= 0.5")
def _(fx):
    path = f"{scratch(fx)}/cache"
    s = fx.samples.select("sample_id")
    U.predict_cached(s.where("sample_id % 4 = 0"), path, _stub(37), STUB)
    return rounded(U.predict_cached(s.where("sample_id % 2 = 0"), path, _stub(37), STUB).where("score >= 0.5"), "score", digits=9)


@query("u03_cascade", """
    SELECT sample_id, round((sample_id * 53 % 101) / 101.0, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS rn FROM $samples q WHERE (sample_id * 37 % 101) / 101.0 > 0.7) WHERE rn <= 500""")
def _(fx):
    s = fx.samples.select("sample_id", "source")
    return rounded(U.cascade(s, _stub(37), STUB, F.col("score") > 0.7, _stub(53), STUB, ["source"], 500)[1], "score", digits=9)


@query("u04_register_functions", """
    SELECT a.sample_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS bits, round((3.0 * a.vec_id + a.sample_id) / (sqrt(CAST(a.vec_id AS DOUBLE) * a.vec_id + 1) * sqrt(9 + CAST(a.sample_id AS DOUBLE) * a.sample_id)), 6) AS cos FROM $hash a JOIN $hash b ON b.sample_id = a.sample_id + 1 WHERE a.sample_id > 0""")
def _(fx):
    register_functions(fx.spark)
    h = fx.hashes
    j = h.join(h.select((F.col("sample_id") - 1).alias("sample_id"), F.col("hash").alias("nxt")), "sample_id").where("sample_id > 0")
    return j.selectExpr("sample_id", "hamming(hash, nxt) AS bits", "round(cosine(array(cast(vec_id AS double), 1D), array(3D, cast(sample_id AS double))), 6) AS cos")


# ---- formats -----------------------------------------------------------------------------------


def _unit_boxes(fx):
    """Boxes over a 500 x 400 image, so that six decimals hold them exactly."""
    b = fx.boxes
    return b.select("sample_id", "box_no", "cls", ((F.col("x1") + F.col("w") / 2) / 500).alias("cx"), ((F.col("y1") + F.col("h") / 2) / 400).alias("cy"), (F.col("w") / 500).alias("w"), (F.col("h") / 400).alias("h"))


UNIT = "(SELECT sample_id, box_no, cls, (x1 + w / 2) / 500 AS cx, (y1 + h / 2) / 400 AS cy, w / 500 AS w, h / 400 AS h FROM $boxes q)"


@query("s01_k01_yolo_labels", f"SELECT s.sample_id, box_no, cls, round(cx, 5) AS cx, round(cy, 5) AS cy, round(w, 5) AS w, round(h, 5) AS h FROM $samples s LEFT JOIN {UNIT} u USING (sample_id)")
def _(fx):
    lines = K.yolo_lines(_unit_boxes(fx), fx.samples.select("sample_id"))
    return rounded(SL.parse_yolo_text(lines, "text"), "cx", "cy", "w", "h", digits=5)


@query("s02_read_block_gt", "SELECT concat('d/', CAST(s.sample_id AS VARCHAR), '.jpg') AS rel_path, box_no, x1, y1, w, h FROM $samples s LEFT JOIN $boxes b USING (sample_id)")
def _(fx):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x1", "y1", "w", "h")], F.lit("0 0 0 0 0 0"))
    per = fx.boxes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("box_no", line.alias("l")))).alias("z"))
    j = fx.samples.select("sample_id").join(per, "sample_id", "left")
    rows = F.coalesce(F.array_join(F.transform("z", lambda r: r["l"]), "\n"), F.lit("0 0 0 0 0 0 0 0 0 0"))
    path = F.concat(F.lit("d/"), F.col("sample_id").cast("string"), F.lit(".jpg"))
    out = f"{scratch(fx)}/gt"
    j.select(F.concat_ws("\n", path, F.when(F.col("z").isNull(), 0).otherwise(F.size("z")).cast("string"), rows).alias("value")).write.text(out)
    return SL.read_block_gt(fx.spark, out).select("rel_path", "box_no", "x1", "y1", "w", "h")


@query("s03_read_annotation_map", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(count(*) AS INT) AS boxes, concat('u', CAST(sample_id % 9 AS VARCHAR)) AS user_id, sum(x1) AS sum_x FROM $boxes q GROUP BY sample_id")
def _(fx):
    one = fx.boxes.groupBy("sample_id").agg(F.collect_list(F.array("x1", "y1", "w", "h")).alias("bboxes"))
    doc = one.select((F.col("sample_id") / 50).cast("long").alias("group"), F.struct(F.col("sample_id").cast("string").alias("k"), F.struct("bboxes", F.concat(F.lit("u"), (F.col("sample_id") % 9).cast("string")).alias("user_id")).alias("v")).alias("e"))
    text = doc.groupBy("group").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    m = SL.parse_annotation_map(text)
    return m.select("sample_id", F.size("bboxes").alias("boxes"), "user_id", F.aggregate("bboxes", F.lit(0.0), lambda a, b: a + b[0]).alias("sum_x"))


@query("s04_read_coco_parquet", "SELECT count(DISTINCT sample_id) AS samples, count(*) AS boxes, round(sum((x1 + w / 2) / 640), 4) AS sum_cx FROM $boxes q WHERE w >= 12")
def _(fx):
    out = f"{scratch(fx)}/coco"
    png = F.unhex(F.lit("89504E470D0A1A0A0000000D4948445200000280000001E0080200000000000000"))
    fx.boxes.groupBy("sample_id").agg(F.struct(F.collect_list(F.array("x1", "y1", F.when(F.col("w") >= 12, F.col("w")).otherwise(0.0), "h")).alias("bbox")).alias("objects")).withColumn("image", F.struct(png.alias("bytes"))).write.parquet(out)
    c = SL.read_coco_parquet(fx.spark, out)
    return rounded(c.agg(F.countDistinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("boxes"), F.sum("cx").alias("sum_cx")), "sum_cx", digits=4)


@query("s05_read_quad_json", "SELECT sample_id, box_no, CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS INT) AS cls, x1, y1, x2, y2 FROM $boxes q WHERE k % 10 <> 0")
def _(fx):
    pts = F.when(F.col("k") % 10 != 0, F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))).otherwise(F.array(F.array("x1", "y1"), F.array("x2", "y2")))
    obj = F.struct("box_no", F.struct(pts.alias("data"), F.array(F.when(F.col("k") % 2 == 0, "a QR code").otherwise("ean")).alias("tags")).alias("o"))
    per = fx.boxes.groupBy("sample_id").agg(F.array_sort(F.collect_list(obj)).alias("z"))
    text = per.select("sample_id", F.to_json(F.struct(F.array(F.lit(640), F.lit(480)).alias("size"), F.transform("z", lambda r: r["o"]).alias("objects"))).alias("value"))
    return SL.parse_quad_json(text).select("sample_id", "box_no", "cls", "x1", "y1", "x2", "y2")


@query("s06_k06_polygon_text", "SELECT sample_id, count(*) AS quads, sum(x1) AS sum_x1, sum(y2) AS sum_y2 FROM $boxes q GROUP BY 1")
def _(fx):
    nums = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    per = fx.boxes.groupBy("sample_id").agg(F.concat_ws("\n", F.lit("# quads 1 2 3"), F.lit("SETS"), F.array_join(F.collect_list(nums), "\n"), F.lit("7 8 9")).alias("value"))
    return SL.parse_polygon_text(per).groupBy("sample_id").agg(F.count(F.lit(1)).alias("quads"), F.sum("x1").alias("sum_x1"), F.sum("y2").alias("sum_y2"))


@query("k06_polygon_lines", "SELECT sample_id, count(*) AS lines FROM $boxes q WHERE k % 3 <> 0 GROUP BY 1")
def _(fx):
    def pt(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pts = F.when(F.col("k") % 3 != 0, F.array(pt("x1", "y1"), pt("x2", "y1"), pt("x2", "y2"))).otherwise(F.array(pt("x1", "y1"), pt("x2", "y2")))
    p = fx.boxes.select("sample_id", F.col("box_no").alias("poly_no"), "cls", pts.alias("points"))
    return K.polygon_lines(p).select("sample_id", (F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"))


@query("s08_read_annotation_export", f"""
    SELECT s.sample_id, box_no, CAST(CASE cls WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INT) AS cls, round(px, 4) AS px FROM (SELECT concat('f_', CAST(sample_id AS VARCHAR)) AS sample_id, sample_id AS id FROM $samples q WHERE sample_id % 5 <> 0) s
    LEFT JOIN (SELECT sample_id AS id, cls, x1 / 5 AS px, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY box_no) - 1 AS INT) AS box_no FROM $boxes q WHERE cls < 2) b USING (id)""")
def _(fx):
    out = f"{scratch(fx)}/export"
    # Only numbers are gathered; the documents are put together as they are written, compressed.
    per = fx.boxes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("box_no", "cls", "x1", "y1", "w", "h"))).alias("b"))
    name = F.array(*map(F.lit, ("ball", "club_head", "other")))
    per = per.select("sample_id", F.transform("b", lambda z: F.struct(F.lit("rectanglelabels").alias("type"), F.struct(
        (z["x1"] / 5).alias("x"), (z["y1"] / 4).alias("y"), (z["w"] / 5).alias("width"), (z["h"] / 4).alias("height"),
        F.array(F.element_at(name, z["cls"] + 1)).alias("rectanglelabels")).alias("value"))).alias("result"))
    t = fx.samples.select("sample_id").join(per, "sample_id", "left")
    dead = F.struct(F.lit(True).alias("was_cancelled"), F.col("result"))
    live = F.struct(F.lit(False).alias("was_cancelled"), F.col("result"))
    image = F.concat(F.lit("/data/local-files/?d=images/f_"), F.col("sample_id").cast("string"), F.lit(".jpg"))
    t.select(F.col("sample_id").alias("id"), F.struct(image.alias("image")).alias("data"), F.when(F.col("sample_id") % 5 == 0, F.array(dead)).otherwise(F.array(dead, live)).alias("annotations")).write.json(out, compression="gzip")
    return rounded(SL.read_annotation_export(fx.spark, out, ["ball", "club_head"], lines=True).select("sample_id", "box_no", "cls", "px"), "px", digits=4)


@query("s11_read_media_catalog", """
    SELECT concat(domain, '_', person, '_clip_', CAST(c_custkey AS VARCHAR)) AS video_id, domain, person, n AS length FROM (
      SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Indoor' ELSE 'Outdoor' END AS domain, concat('p', CAST(c_nationkey AS VARCHAR)) AS person, CAST(500 + c_custkey * 37 % 1000 AS BIGINT) AS n, c_nationkey AS k FROM customer) c
    WHERE n >= 1000 AND k <> 7""")
def _(fx):
    """Clips of the customers under domain and person, those of one nation under a template folder."""
    domain = F.when(F.col("c_nationkey") % 2 == 0, "Indoor").otherwise("Outdoor")
    person = F.when(F.col("c_nationkey") == 7, "_template_folder").otherwise(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")))
    clip = F.concat_ws("/", domain, person, F.concat(F.lit("clip "), F.col("c_custkey").cast("string")))
    out = f"{scratch(fx)}/clips"
    K.write_each(fx.table("customer").select(clip.alias("sample_id"), F.repeat(F.lit("x"), (500 + F.col("c_custkey") * 37 % 1000).cast("int")).alias("text")), out, ext=".mp4")
    return SF.read_media_catalog(fx.spark, out, min_bytes=1000).select("video_id", "domain", "person", "length")


@query("s12_detection_cache", "SELECT video_id, frame_idx, CASE WHEN cls = 0 THEN 1 ELSE 0 END AS balls, CASE WHEN cls = 1 THEN 1 ELSE 0 END AS clubs, round(CASE WHEN event_id % 13 = 0 THEN NULL ELSE x END, 6) AS tx FROM $frames q")
def _(fx):
    f, part = fx.frames, (F.col("frame_idx") / 64).cast("int")
    box = F.array(F.array(F.col("x") - 5, F.col("y") - 5, F.col("x") + 5, F.col("y") + 5))
    none = F.array().cast("array<array<double>>")
    frame = F.struct("frame_idx", F.struct(F.when(F.col("cls") == 0, box).otherwise(none).alias("b"), F.when(F.col("cls") == 1, box).otherwise(none).alias("c")).alias("f"))
    text = f.groupBy("video_id", part.alias("part")).agg(F.to_json(F.struct(F.lit(30.0).alias("fps"), F.transform(F.array_sort(F.collect_list(frame)), lambda z: z["f"]).alias("frames"))).alias("value"))
    d = SF.parse_detection_cache(text).withColumn("frame_idx", F.col("frame_idx") + F.col("part") * 64)
    cams = f.select("video_id", "frame_idx", F.when(F.col("event_id") % 13 != 0, F.array("x", F.lit(0.0))).alias("cam"))
    return rounded(SF.attach_affines(d, cams).select("video_id", "frame_idx", F.size("balls").alias("balls"), F.size("clubs").alias("clubs"), F.col("cam")[0].alias("tx")), "tx")


@query("s14_k03_manifest", "SELECT concat('p', CAST(entity AS VARCHAR)) AS person, domains, weight AS videos FROM $entities q")
def _(fx):
    out = f"{scratch(fx)}/manifest"
    K.write_manifest(fx.entities.select(F.concat(F.lit(" p"), F.col("entity").cast("string"), F.lit(" ")).alias("person"), "domains", F.col("weight").alias("videos")), out)
    return ST.read_manifest(fx.spark, out).select("person", "domains", "videos")


@query("k02_annotation_tasks", f"""
    SELECT concat('/d/', CAST(s.sample_id AS VARCHAR), '.jpg') AS image, count(u.box_no) AS boxes, round(coalesce(sum(least(greatest((cx - w / 2) * 100, 0), 100)), 0), 4) AS sum_x FROM $samples s LEFT JOIN {UNIT} u USING (sample_id) GROUP BY 1""")
def _(fx):
    t = K.annotation_tasks(_unit_boxes(fx), fx.samples, ["ball", "club_head", "hole"], "v1", "/d/")
    r = F.col("predictions")[0]["result"]
    return rounded(t.select("data.image", F.size(r).cast("long").alias("boxes"), F.aggregate(r, F.lit(0.0), lambda a, v: a + v["value"]["x"]).alias("sum_x")), "sum_x", digits=4)


@query("k04_split_dataset", "SELECT CASE WHEN sample_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(DISTINCT sample_id) AS samples, count(det_id) AS boxes FROM $samples s LEFT JOIN $boxes b USING (sample_id) GROUP BY 1")
def _(fx):
    out = scratch(fx)
    s = fx.samples.select("sample_id", N.flat_name(F.col("sample_id").cast("string")).alias("path"), F.when(F.col("sample_id") % 10 == 0, "val").otherwise("train").alias("split"))
    K.write_split_dataset(s, fx.boxes.select("sample_id", "det_id"), out)
    i, b = (fx.spark.read.parquet(f"{out}/{n}").groupBy("split").agg(F.count(F.lit(1)).alias(c)) for n, c in (("images", "samples"), ("labels", "boxes")))
    return i.join(b, "split", "left")


@query("k05_image_lists", "SELECT CASE WHEN sample_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS images FROM $samples q GROUP BY 1")
def _(fx):
    out = scratch(fx)
    s = fx.samples.select(F.concat(F.lit("/images/"), F.col("sample_id").cast("string"), F.lit(".jpg")).alias("path"), F.when(F.col("sample_id") % 10 == 0, "val").otherwise("train").alias("split"))
    K.write_image_lists(s, out, {0: "ball", 1: "club_head"})
    parts = [ST.read_frame_list(fx.spark, f"{out}/{n}.txt").agg(F.lit(n).alias("split"), F.count(F.lit(1)).alias("images")) for n in ("train", "val")]
    return parts[0].unionByName(parts[1])


@query("s07_read_calibration", """
    SELECT vec_id // 100 AS doc, CAST(vec_id % 100 AS INT) AS idx, CAST(500 + vec_id % 10 AS DOUBLE) AS fx, round(CAST(embedding[61] AS DOUBLE), 6) AS last_x FROM embeddings""")
def _(fx):
    e = fx.table("embeddings").withColumn("doc", F.floor(F.col("vec_id") / 100))
    k = F.array(F.array((500 + F.col("vec_id") % 10).cast("double"), F.lit(0.0), F.lit(320.0)), F.array(*map(F.lit, (0.0, 480.0, 240.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0))))
    xyz = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(*[F.get("embedding", i * 3 + j).cast("double") for j in range(3)]))

    def docs(col):
        rows = F.array_sort(F.collect_list(F.struct("vec_id", col.alias("v"))))
        return e.groupBy("doc").agg(F.to_json(F.transform(rows, lambda r: r["v"])).alias("value"))

    c = SL.parse_calibration(docs(k), docs(xyz))
    return rounded(c.select("doc", "idx", F.col("k")[0][0].alias("fx"), F.col("xyz")[20][0].alias("last_x")), "last_x")


@query("s09_bind_annotation_tables", """
    SELECT t.project_id, count(*) AS annotations, count(DISTINCT a.completed_by_id) AS users, max(a.updated_at) AS last_at FROM $annotations a JOIN $tasks t ON t.id = a.task_id GROUP BY 1""")
def _(fx):
    t = ST.bind_annotation_tables({"notes": fx.annotations, "people": fx.users, "jobs": fx.tasks, "groups": fx.projects})
    return t.annotations.groupBy("project_id").agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("completed_by_id").alias("users"), F.max("_at").cast("timestamp_ntz").alias("last_at"))


# A 54-byte header for 8 x 8 pixels of three bytes.
BMP = "424DF60000000000000036000000280000000800000008000000010018000000000000000000130B0000130B00000000000000000000"


@query("s10_read_images", """
    SELECT concat('v', CAST(vec_id AS VARCHAR)) AS sample_id, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, CAST(list_sum(list_transform(embedding, lambda v: CAST(floor(greatest(least(128 + 100 * CAST(v AS DOUBLE), 255), 0)) AS INT))) AS BIGINT) AS blue FROM embeddings""")
def _(fx):
    level = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(128 + 100 * v.cast("double"), F.lit(255)), F.lit(0))).cast("int"))
    px = F.transform(level, lambda n: F.repeat(F.lpad(F.hex(n), 2, "0"), 3))
    out = f"{scratch(fx)}/images"
    K.write_each(fx.table("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("sample_id"), F.unhex(F.concat(F.lit(BMP), F.array_join(px, ""))).alias("text")), out, ext=".bmp")
    i = SF.read_images(fx.spark, out, "*.bmp")
    blues = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.conv(F.substring(F.hex("image.data"), n * 6 + 1, F.lit(2)), 16, 10).cast("long"))
    return i.select("sample_id", "width", "height", F.aggregate(blues, F.lit(0).cast("long"), lambda a, v: a + v).alias("blue"))


@query("s10_image_index", """
    SELECT concat(CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END, '__v', CAST(vec_id // 2 AS VARCHAR)) AS sample_id, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height FROM embeddings WHERE vec_id % 5 <> 0""")
def _(fx):
    """Equal names in two folders; a fifth of the files are no images."""
    v = F.col("vec_id")
    name = F.concat(F.when(v % 2 == 0, "a").otherwise("b"), F.lit("/v"), F.floor(v / 2).cast("string"))
    body = F.when(v % 5 == 0, F.lit(b"no image")).otherwise(F.unhex(F.concat(F.lit(BMP), F.repeat(F.lit("0a"), 192))))
    out = f"{scratch(fx)}/images"
    K.write_each(fx.table("embeddings").select(name.alias("sample_id"), body.alias("text")), out, ext=".bmp")
    return SF.image_index(fx.spark, out, "*.bmp", nested=True).select("sample_id", "width", "height")


@query("s13_dataset_config", "SELECT CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, label AS cls, count(*) AS boxes FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY 1, 2 UNION ALL SELECT CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END, NULL, count(*) FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1")
def _(fx):
    out = scratch(fx)
    v = fx.table("embeddings").select("vec_id", F.col("vec_id").cast("string").alias("sample_id"), F.lit(0).alias("box_no"), F.col("label").alias("cls"), *[F.lit(0.5).alias(c) for c in ("cx", "cy", "w", "h")])
    for split, cond in (("train", F.col("vec_id") % 4 != 0), ("val", F.col("vec_id") % 4 == 0)):
        part = v.where(cond)
        K.write_yolo_labels(part.where("vec_id % 3 <> 0"), part.select("sample_id"), f"{out}/{split}/labels")
    conf = K.fs.FileSystem.from_uri(out if "://" in out else f"file://{out}")
    with conf[0].open_output_stream(f"{conf[1]}/data.yaml") as f:
        f.write(f"path: {out}\ntrain: train/images\nval: val/images\nnames: [a, b]\n".encode())
    rows = ST.read_dataset_config(fx.spark, f"{out}/data.yaml")[1]
    return rows.groupBy("split", "cls").agg(F.count(F.lit(1)).alias("boxes"))
