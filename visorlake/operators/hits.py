"""Hit events of a video as columns of the followed ball: rest, address, departure, and what happens afterwards."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from visorlake.functions.boxes import hypot
from visorlake.operators.ball import ball_lives
from visorlake.operators.tracks import motion_rows, video_size
from visorlake.scale import FRAME_SPAN, ordered_scan, with_halo
from visorlake.session import settle

# kind: `armed` marks a frame soon after a rest, `hit` an event at `frame_idx`.
EVENTS = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("frame_idx", T.IntegerType()),
                       T.StructField("kind", T.StringType())])

# Fixed values of the rules. Keys end in _s for seconds, _d for ball diameters, _dps for diameters a second.
COMMON = dict(gap_s=0.13, hold_s=1.5, launch_s=1.0, launch_d=5.0, grow=1.3, gone_s=0.27, near_d=3.0, depart_dps=9.0, watch_s=1.0, watch_frac=0.25,
              edge_d=1.5, exit_frac=0.22, drift_d=1.0, cooldown_s=2.5, reacquire_d=2.5, far_d=0.0, roll_dps=0.0, jump_d=1e9)
RULES = {
    "ego": COMMON | dict(camera=True, rest_dps=7.5, rest_s=0.17, club_d=3.5, club_s=3.0, return_d=3.0, look_s=2.0, gate_d=5.0),
    "raw": COMMON | dict(camera=False, rest_dps=12.6, rest_s=0.50, club_d=3.5, club_s=3.0, return_d=3.5, look_s=2.0, gate_d=5.0, far_d=14.0, roll_dps=22.0,
                         jump_d=15.0),
    "boxonly": COMMON | dict(camera=False, rest_dps=12.6, rest_s=0.50, club_d=6.0, club_s=2.5, return_d=3.5, look_s=3.0, gate_d=4.0, near_d=3.5, far_d=14.0,
                             roll_dps=22.0, jump_d=15.0),
}


def _frames(seconds: float, fps: float, least: int = 1) -> int:
    return max(least, int(round(seconds * fps)))


def videos(frames: DataFrame, size: tuple[int, int]) -> DataFrame:
    """A row per video, from one pass: the size of its picture (`_w`, `_h`), its frames (`_n`) and the last of them (`_end`)."""
    rows = frames.withColumn("video_id", F.col("video_id").cast("string"))
    return settle(video_size(rows, size, F.count(F.lit(1)).alias("_n"), F.max("frame_idx").alias("_end")))


def followed(frames: DataFrame, facts: DataFrame, fps: float, mode: str, span: int, scan: dict) -> DataFrame:
    """The ball's life per frame, with the clubs and the size of the picture. `facts`: the table `videos` of `frames`."""
    c = RULES[mode]
    frames = frames.withColumns({"video_id": F.col("video_id").cast("string"), "frame_idx": F.col("frame_idx").cast("int")})
    cam = F.col("cam") if c["camera"] else F.lit(None).cast("array<double>")
    rows = (motion_rows(frames.join(facts.select("video_id", "_w", "_h"), "video_id"), F.lit(58 / 2048.0) * F.col("_w")).withColumn("cam", cam)
            .select("video_id", "frame_idx", "cam", "bx", "by", "br", "kx", "ky", "_w", "_h"))
    return ball_lives(rows, fps, c["gate_d"], c["reacquire_d"], span=span, sizes=facts, **scan).drop("cam", "bx", "by", "br")


def with_rest(lives: DataFrame, fps: float, c: dict, span: int) -> DataFrame:
    """Adds, for frames within a life: `spot` (the last resting place and its frame), `club_at` (last frame with a club at the ball), `broken` (long gaps so
    far), `spread` (the latest step per frame over three sightings) and `last` (the last sighting).

    Every rule looks back a bounded time, so the windows run over spans with a halo.
    """
    rest_n, hold, club = _frames(c["rest_s"], fps, 2), int(c["hold_s"] * fps), int(c["club_s"] * fps)
    halo = hold + club + 4 * rest_n + 4 * _frames(c["gap_s"], fps)
    rows = with_halo(lives, "frame_idx", back=halo, span=span)
    seen, D = F.col("missing") == 0, 2 * F.col("r")
    life = W.partitionBy("video_id", "_span", "life").orderBy("frame_idx")
    video = W.partitionBy("video_id", "_span").orderBy("frame_idx").rangeBetween(-club, 0)
    before = F.lag(F.when(seen, F.struct("wx", "wy")), 1).over(life)
    step = F.when(before.isNotNull() & seen, hypot(F.col("wx") - before["wx"], F.col("wy") - before["wy"]) / D) if c["camera"] else F.col("raw_step")
    slow, long = F.col("_step") < c["rest_dps"] / fps, seen & (F.col("gap") > _frames(c["gap_s"], fps))
    sighting = F.struct("frame_idx", "wx", "wy", "x", "y", "r")
    third = F.lag(F.when(seen, sighting), 3).over(life)
    at_club = seen & F.exists(F.transform(F.arrays_zip("kx", "ky"), lambda k: hypot(k["kx"] - F.col("x"), k["ky"] - F.col("y"))), lambda d: d < c["club_d"] * D)
    out = (rows.withColumn("_step", step)
           .withColumns({"broken": F.sum(F.when(long, 1).otherwise(0)).over(life), "_run": F.sum(F.when(long | (F.col("_step") >= c["rest_dps"] / fps), 1).otherwise(0)).over(life),
                         "club_at": F.max(F.when(at_club, F.col("frame_idx"))).over(video), "last": F.last(F.when(seen, sighting), True).over(life),
                         "_spread": F.when(seen & third.isNotNull(), hypot(F.col("wx") - third["wx"], F.col("wy") - third["wy"]) / 3)})
           .withColumn("_slow", F.sum(F.when(slow, 1).otherwise(0)).over(W.partitionBy("video_id", "_span", "life", "_run").orderBy("frame_idx")))
           .withColumns({"spot": F.last(F.when(slow & (F.col("_slow") >= rest_n), sighting), True).over(life), "spread": F.last("_spread", True).over(life)}))
    armed = F.col("frame_idx") - F.col("spot.frame_idx") <= hold
    return (out.where("_own AND life IS NOT NULL").withColumns({"armed": F.coalesce(armed, F.lit(False)), "ready": F.coalesce(armed & F.col("club_at").isNotNull(), F.lit(False))})
            .drop("_own", "_span", "_run", "_slow", "_step", "_spread"))


def _leaves_view(c: dict):
    """Whether the camera carried the missing ball over a border: it drifted, and its way or its last sighting is close to one other than the lower."""
    D, dx, dy = 2 * F.col("spot.r"), F.col("x") - F.col("last.x"), F.col("y") - F.col("last.y")
    drift = hypot(dx, dy)
    across = F.when(dx > 0, (F.col("_w") - F.col("last.x")) / dx).when(dx < 0, -F.col("last.x") / dx).otherwise(F.lit(1e9))
    along = F.when(dy > 0, (F.col("_h") - F.col("last.y")) / dy).when(dy < 0, -F.col("last.y") / dy).otherwise(F.lit(1e9))
    side = F.least(F.col("last.x"), F.col("_w") - F.col("last.x"), F.col("last.y"), F.col("_h") - F.col("last.y"))
    down = (dy > 0) & (along < across) & (dy > F.abs(dx))
    return (drift >= c["drift_d"] * D) & ((F.least(across, along) * drift < c["exit_frac"] * F.least("_w", "_h")) | (side < c["edge_d"] * D)) & ~down


def departures(rows: DataFrame, fps: float, c: dict) -> DataFrame:
    """Frames where an addressed ball leaves its spot (the first of each rest), or has been missing for long enough: video_id, life, at, fire, until, spot, broken, rolled."""
    since, D = F.col("frame_idx") - F.col("spot.frame_idx"), 2 * F.col("spot.r")
    away = hypot(F.col("wx") - F.col("spot.wx"), F.col("wy") - F.col("spot.wy")) / D
    off = ((F.col("missing") == 0) & (since <= int(c["launch_s"] * fps)) & (away >= max(c["launch_d"], c["far_d"])) & (F.col("r") <= c["grow"] * F.col("spot.r"))
           & (away * fps >= c["roll_dps"] * since) & (F.coalesce("raw_step", F.lit(0.0)) <= c["jump_d"]))
    launched = (rows.where(F.col("ready") & off).groupBy("video_id", "life", F.col("spot.frame_idx").alias("fire"))
                .agg(F.min_by(F.struct(F.col("frame_idx").alias("at"), "spot", "broken"), "frame_idx").alias("d"))
                .select("video_id", "life", "d.at", "fire", (F.col("fire") + int(c["look_s"] * fps)).alias("until"), "d.spot", "d.broken", F.lit(True).alias("rolled")))
    gone = _frames(c["gone_s"], fps, 2)
    near = away <= c["near_d"]
    left = F.col("spread") * fps / D >= c["depart_dps"]
    fire = F.when(near & ~_leaves_view(c), F.col("frame_idx") - gone + 1).when(~near & left, F.col("spot.frame_idx"))
    missing = (rows.where(F.col("ready") & (F.col("missing") == gone)).withColumn("fire", fire).where("fire IS NOT NULL")
               .select("video_id", "life", F.col("frame_idx").alias("at"), "fire", (F.col("frame_idx") + int(c["watch_s"] * fps) - 1).alias("until"), "spot", "broken",
                       F.lit(False).alias("rolled")))
    return launched.unionByName(missing)


def judged(cands: DataFrame, rows: DataFrame, fps: float, c: dict) -> DataFrame:
    """Candidates with their verdict: a launch fails if the ball is seen back at the spot, a disappearance if something is seen there in too many frames.

    The frames to look at are a bounded number per candidate, so the look-ahead is an equi-join on (video, frame).
    """
    later = rows.select("video_id", "life", "frame_idx", "missing", "wx", "wy", "all_wx", "all_wy", F.col("broken").alias("now_broken"))
    ahead = (cands.withColumn("frame_idx", F.explode(F.sequence(F.col("at") + F.col("rolled").cast("int"), F.greatest("until", F.col("at") + 1))))
             .join(later, ["video_id", "life", "frame_idx"], "left"))
    reach = c["return_d"] * 2 * F.col("spot.r")
    back = (F.col("missing") == 0) & (F.col("now_broken") == F.col("broken")) & (hypot(F.col("wx") - F.col("spot.wx"), F.col("wy") - F.col("spot.wy")) < reach)
    some = F.exists(F.transform(F.arrays_zip("all_wx", "all_wy"), lambda k: hypot(k["all_wx"] - F.col("spot.wx"), k["all_wy"] - F.col("spot.wy"))), lambda d: d < reach)
    keys = ["video_id", "life", "at", "fire", "until", "rolled"]
    found = ahead.groupBy(*keys, F.col("spot.frame_idx").alias("rest")).agg(
        F.min(F.when(F.col("rolled") & back, F.col("frame_idx"))).alias("_back"), F.sum(F.when(some, 1).otherwise(0)).alias("_some"))
    good = F.when(F.col("rolled"), F.col("_back").isNull()).otherwise(F.col("_some") < c["watch_frac"] * int(c["watch_s"] * fps))
    return found.select("video_id", "at", "fire", F.greatest(F.coalesce("_back", "until"), "at").alias("resolved"), "rest", good.alias("good"))


def hit_events(frames: DataFrame, fps: float = 30.0, mode: str = "ego", size: tuple[int, int] = (2048, 1536),
               span: int = FRAME_SPAN, **scan) -> DataFrame:
    """Events of every video. `frames` holds each frame once: balls, clubs and, for `ego`, `cam`.

    `ego` removes the camera motion, `raw` and `boxonly` are stricter rule sets without it. Following the ball is a fold over frames; rest, address,
    departure and return are columns and joins; what is left in order is the fold over a video's few candidates: one at a time, a cooldown between
    hits, and a new rest after each verdict.
    """
    c = RULES[mode]
    facts = videos(frames, size)
    rows = settle(with_rest(followed(frames, facts, fps, mode, span, scan), fps, c, span))
    cands = settle(judged(departures(rows, fps, c), rows, fps, c).join(facts.select("video_id", "_end"), "video_id")
                   .withColumn("good", F.col("good") & (F.col("resolved") <= F.col("_end"))).drop("_end"))   # one still open at the end is no hit and lets no other in
    rest_n, cool = _frames(c["rest_s"], fps, 2), int(c["cooldown_s"] * fps)

    def choose(key, state, part: pd.DataFrame):
        free, fired = state or (None, None)
        hits = []
        for at, fire, resolved, rest, good in zip(*(part[n] for n in ("at", "fire", "resolved", "rest", "good")), strict=True):
            busy = free is not None and (at <= free or rest < free + rest_n)
            if busy or (fired is not None and at - fired < cool):
                continue
            free = int(resolved)
            if good and (fired is None or fire - fired >= cool):
                fired = int(fire)
                hits.append((key[0], fired, "hit"))
        return pd.DataFrame(hits, columns=EVENTS.fieldNames()), None if free is None else [free, fired]

    hits = ordered_scan(cands, ["video_id"], "at", ["at", "fire"], choose, EVENTS, span=span, warmup=int(20 * fps), **scan)
    return hits.unionByName(rows.where("armed").select("video_id", "frame_idx", F.lit("armed").alias("kind")))


def detect_hits(frames: DataFrame, fps: float = 30.0, mode: str = "ego", **kw) -> DataFrame:
    """Back-dated hit frames: video_id, hit."""
    return hit_events(frames, fps, mode, **kw).where("kind = 'hit'").select("video_id", F.col("frame_idx").alias("hit"))


def armed_frames(events: DataFrame) -> DataFrame:
    return events.where("kind = 'armed'").select("video_id", "frame_idx")
