"""Queries of joins and set operations."""
from pyspark.sql import functions as F

from visorlake.operators import gallery, joins as J, sets as G
from visorlake.plans.registry import query, rounded


def _names(fx):
    """Samples with a person, and a manifest that misses some people."""
    s = fx.samples.withColumn("person", F.concat(F.lit("p"), (F.col("video_id") % 40).cast("string")))
    n = fx.table("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("person"),
                                  F.when(F.col("n_regionkey") == 0, "val").when(F.col("n_regionkey") == 1, "test").otherwise("train").alias("split"))
    return s, n


@query("j01_attach_images_inner", "SELECT det_id, width FROM $boxes b JOIN (SELECT * FROM $samples q WHERE sample_id % 7 <> 0) s USING (sample_id)")
def _(fx):
    return J.attach_images(fx.boxes, fx.samples.where("sample_id % 7 <> 0")).select("det_id", "width")


@query("j01_attach_images_left", "SELECT s.sample_id, det_id FROM $samples s LEFT JOIN $boxes b USING (sample_id)")
def _(fx):
    return J.attach_images(fx.boxes.select("sample_id", "det_id"), fx.samples.select("sample_id"), "left")


@query("j01_missing_images", "SELECT DISTINCT sample_id FROM $boxes b WHERE sample_id NOT IN (SELECT sample_id FROM $samples q WHERE sample_id % 7 <> 0)")
def _(fx):
    return J.missing_images(fx.boxes, fx.samples.where("sample_id % 7 <> 0"))


@query("j02_lookup_paths", "SELECT det_id, concat('/img/', CAST(sample_id AS VARCHAR), '.jpg') AS path FROM $boxes b JOIN (SELECT sample_id FROM $samples q WHERE sample_id % 3 = 0) s USING (sample_id)")
def _(fx):
    index = fx.samples.where("sample_id % 3 = 0").select("sample_id", F.concat(F.lit("/img/"), F.col("sample_id").cast("string"), F.lit(".jpg")).alias("path"))
    return J.lookup_paths(fx.boxes.select("sample_id", "det_id"), index).select("det_id", "path")


@query("j03_assign_split_by_manifest", """
    SELECT sample_id, coalesce(split, 'train') AS split, split IS NOT NULL AS matched FROM (SELECT *, concat('p', CAST(video_id % 40 AS VARCHAR)) AS person FROM $samples q) s
    LEFT JOIN (SELECT concat('p', CAST(n_nationkey AS VARCHAR)) AS person, CASE n_regionkey WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM nation) m USING (person)""")
def _(fx):
    return J.assign_split_by_manifest(*_names(fx)).select("sample_id", "split", "matched")


@query("j03_unmatched_persons", """
    SELECT concat('p', CAST(video_id % 40 AS VARCHAR)) AS person, count(*) AS frames FROM $samples q WHERE video_id % 40 NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1""")
def _(fx):
    return J.unmatched_persons(*_names(fx))


@query("j04_exclude_groups", "SELECT sample_id FROM $samples s WHERE video_id NOT IN (SELECT video_id FROM $samples q WHERE sample_id % 23 = 0)")
def _(fx):
    return J.exclude_groups(fx.samples, fx.samples.where("sample_id % 23 = 0")).select("sample_id")


@query("j05_skip_existing", "SELECT sample_id FROM $samples s WHERE sample_id % 4 <> 1 AND sample_id % 9 <> 2")
def _(fx):
    return J.skip_existing(fx.samples, fx.samples.where("sample_id % 4 = 1"), fx.samples.where("sample_id % 9 = 2")).select("sample_id")


@query("j06_keep_known", "SELECT sample_id FROM $samples s WHERE sample_id IN (SELECT sample_id FROM $boxes b WHERE cls = 2)")
def _(fx):
    return J.keep_known(fx.samples, fx.boxes.where("cls = 2")).select("sample_id")


@query("j09_best_match", """
    SELECT id, match_id, round(similarity, 5) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS similarity,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS rn
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 <> 0) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 0) b) WHERE rn = 1""")
def _(fx):
    e = fx.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(gallery.best_match(e.where("id % 10 <> 0"), e.where("id % 10 = 0"), template="embedding"), "similarity", digits=5)


@query("j09_best_match_blocks", """
    SELECT id, match_id, round(similarity, 5) AS similarity FROM (SELECT a.vec_id AS id, concat('t', CAST(b.vec_id AS VARCHAR)) AS match_id, list_cosine_similarity(a.e, b.e) AS similarity,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, concat('t', CAST(b.vec_id AS VARCHAR))) AS rn
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 <> 0) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 0) b) WHERE rn = 1""")
def _(fx):
    """The same search with text names and a gallery of several blocks."""
    e = fx.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    names = e.where("id % 10 = 0").withColumn("id", F.concat(F.lit("t"), F.col("id").cast("string")))
    return rounded(gallery.best_match(e.where("id % 10 <> 0"), names, template="embedding", block=64), "similarity", digits=5)


@query("j10_pair_similarity", """
    WITH k AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 2 ORDER BY count(*) DESC, label LIMIT 8),
    f AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE label IN (SELECT label FROM k)),
    g AS (SELECT * FROM f WHERE rn <= 2)
    SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label = b.label AS same, round(list_cosine_similarity(a.e, b.e), 5) AS cosine FROM g a JOIN g b ON a.vec_id < b.vec_id WHERE a.label = b.label OR (a.rn = 1 AND b.rn = 1)""")
def _(fx):
    return rounded(J.pair_similarity(fx.table("embeddings"), key="label", id="vec_id", per_key=2, n_keys=8), "cosine", digits=5)


@query("j11_merge_detection_streams", """
    SELECT video_id, cls, origin, count(*) AS n FROM (SELECT video_id, cls, 'a' AS origin FROM $frames q WHERE event_id % 2 = 0 UNION ALL SELECT video_id, CAST(7 AS INT), 'b' FROM $frames q WHERE event_id % 2 = 1) GROUP BY 1, 2, 3""")
def _(fx):
    f = fx.frames.select("video_id", "frame_idx", "x", "y", "cls", "event_id")
    return J.merge_detection_streams(f.where("event_id % 2 = 0"), f.where("event_id % 2 = 1"), 7).groupBy("video_id", "cls", "origin").agg(F.count(F.lit(1)).alias("n"))


def event_boxes(fx):
    """Frame objects as corner boxes."""
    return fx.frames.select("video_id", "frame_idx", "cls", "conf", "event_id", F.col("event_id").alias("det_id"), F.lit(0).alias("det_no"),
                            (F.col("x") - F.col("r")).alias("x1"), (F.col("y") - F.col("r")).alias("y1"), (F.col("x") + F.col("r")).alias("x2"), (F.col("y") + F.col("r")).alias("y2"))


@query("j12_temporal_support", """
    SELECT a.event_id AS det_id, CAST(count(DISTINCT b.frame_idx) AS INT) AS support FROM $frames a LEFT JOIN $frames b ON a.video_id = b.video_id AND a.cls = b.cls AND a.frame_idx <> b.frame_idx
      AND abs(a.frame_idx - b.frame_idx) <= 3 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 6.0 * greatest(2 * a.r, 8.0) GROUP BY a.event_id""")
def _(fx):
    return J.temporal_support(event_boxes(fx), win=3).select("det_id", "support")


def hits_of(fx):
    return fx.frames.where("cls_name = 'purchase'").select("video_id", F.col("frame_idx").alias("hit"), (F.col("event_id") % 2 == 0).alias("made"))


HITS = "(SELECT video_id, frame_idx AS hit, event_id % 2 = 0 AS made FROM $frames q WHERE cls_name = 'purchase')"


@query("j13_status_timeline", f"""
    SELECT f.video_id, f.frame_idx, CASE WHEN h.made THEN 'MADE PUTT' WHEN f.frame_idx <= h.hit + 4 THEN 'HIT' WHEN h.hit IS NOT NULL THEN 'FOLLOW' WHEN f.value > 50 THEN 'PREPARE' ELSE 'IDLE' END AS status
    FROM $frames f LEFT JOIN (SELECT f.video_id, f.frame_idx, min(h.hit) AS hit, arg_min(h.made, h.hit) AS made FROM $frames f JOIN {HITS} h ON f.video_id = h.video_id AND f.frame_idx BETWEEN h.hit AND h.hit + 12 GROUP BY 1, 2) h
    ON f.video_id = h.video_id AND f.frame_idx = h.frame_idx""")
def _(fx):
    f = fx.frames.select("video_id", "frame_idx", (F.col("value") > 50).alias("armed"))
    return J.status_timeline(f, hits_of(fx), fps=10.0).select("video_id", "frame_idx", "status")


@query("j14_made_putts", f"""
    SELECT h.video_id, h.hit, coalesce(bool_or(f.event_id % 4 = 0 AND f.x BETWEEN f.x - 10 + f.event_id % 40 - 7 AND f.x - 10 + f.event_id % 40 + 27), FALSE) AS made FROM {HITS} h
    LEFT JOIN $frames f ON f.video_id = h.video_id AND f.frame_idx >= h.hit AND f.frame_idx < h.hit + 25 GROUP BY 1, 2""")
def _(fx):
    f = fx.frames
    left = F.col("x") - 10 + F.col("event_id") % 40
    holes = f.where("event_id % 4 = 0").select("video_id", "frame_idx", left.alias("x1"), (F.col("y") - 10).alias("y1"), (left + 20).alias("x2"), (F.col("y") + 10).alias("y2"))
    return J.made_putts(hits_of(fx).drop("made"), f.select("video_id", "frame_idx", "x", "y"), holes, fps=10.0)


@query("j15_latest_event_asof", f"""
    SELECT f.video_id, f.frame_idx, max(h.hit) AS last_hit FROM $frames f LEFT JOIN {HITS} h ON h.video_id = f.video_id AND h.hit <= f.frame_idx AND h.hit >= f.frame_idx - 9 GROUP BY 1, 2""")
def _(fx):
    return J.latest_event_asof(fx.frames.select("video_id", "frame_idx"), hits_of(fx), 9, span=32)


@query("j16_match_events", """
    WITH RECURSIVE f AS MATERIALIZED (SELECT video_id, CAST(frame_idx AS DOUBLE) AS t, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM $frames q WHERE cls_name = 'purchase'),
    r AS MATERIALIZED (SELECT video_id, list(CAST(frame_idx AS DOUBLE) ORDER BY frame_idx) AS xs FROM $frames q WHERE cls_name = 'signup' GROUP BY 1),
    b AS MATERIALIZED (SELECT video_id, list(CAST(frame_idx AS DOUBLE)) AS xs FROM $frames q WHERE cls_name = 'error' GROUP BY 1),
    s(video_id, n, t, truth, caught) AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST([] AS DOUBLE[]) FROM f
      UNION ALL SELECT video_id, n, t, x, CASE WHEN x IS NULL THEN caught ELSE list_append(caught, x) END FROM (SELECT f.video_id, f.n, f.t, s.caught, list_filter(coalesce(r.xs, []), lambda x: abs(x - f.t) <= 1.0 AND NOT list_contains(s.caught, x))[1] AS x
        FROM s JOIN f ON f.video_id = s.video_id AND f.n = s.n + 1 LEFT JOIN r ON r.video_id = f.video_id))
    SELECT CAST(s.video_id AS VARCHAR) AS clip_id, t AS fire, truth, CASE WHEN truth IS NOT NULL THEN 'ok' WHEN len(list_filter(coalesce(b.xs, []), lambda x: abs(x - t) <= 1.0)) > 0 THEN 'FALSE' WHEN s.video_id % 2 = 0 AND (b.xs IS NOT NULL OR r.xs IS NOT NULL) THEN 'EXTRA' ELSE 'uncertain' END AS verdict
    FROM s LEFT JOIN b ON b.video_id = s.video_id LEFT JOIN r ON r.video_id = s.video_id WHERE n > 0
    UNION ALL SELECT CAST(video_id AS VARCHAR), NULL, x, 'missed' FROM (SELECT r.video_id, unnest(r.xs) AS x FROM r) m WHERE (video_id, x) NOT IN (SELECT video_id, truth FROM s WHERE truth IS NOT NULL)""")
def _(fx):
    t = fx.frames.select(F.col("video_id").alias("clip_id"), F.col("frame_idx").cast("double").alias("t"), "cls_name")
    truth = t.where("cls_name IN ('signup', 'error')").select("clip_id", "t", (F.col("cls_name") == "signup").alias("real"), (F.col("clip_id") % 2 == 0).alias("closed"))
    return J.match_events(t.where("cls_name = 'purchase'"), truth, tol=1.0)


@query("j17_join_modulo", "SELECT sample_id, n_name FROM $samples s JOIN nation ON n_nationkey = sample_id % 25")
def _(fx):
    n = fx.table("nation").select(F.col("n_nationkey").alias("idx"), "n_name")
    return J.join_modulo(fx.samples.select("sample_id", F.col("sample_id").alias("idx")), n, 25).select("sample_id", "n_name")


@query("j18_nearest_object", """
    SELECT a.sample_id, round(sum(d), 5) AS total, count(*) AS n FROM (SELECT a.det_id, a.sample_id, min(sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) / ((a.w + a.h) / 2)) AS d
      FROM $boxes a JOIN $boxes b ON a.sample_id = b.sample_id WHERE a.cls = 0 AND b.cls = 1 GROUP BY 1, 2) a GROUP BY 1""")
def _(fx):
    n = J.nearest_object(fx.scene).where((F.size("balls") > 0) & (F.size("clubs") > 0))
    total = F.aggregate("nearest", F.lit(0.0), lambda a, v: a + v["diameters"])
    return rounded(n.select("sample_id", total.alias("total"), F.size("nearest").cast("long").alias("n")), "total", digits=5)


@query("j18_context_distance", """
    SELECT s.sample_id, round(CASE WHEN t.sample_id IS NOT NULL THEN coalesce(min(sqrt((t.cx - (b.x1 + b.x2) / 2) ** 2 + (t.cy - (b.y1 + b.y2) / 2) ** 2) / t.diag), 99.0) END, 5) AS context FROM (SELECT DISTINCT sample_id FROM $boxes q) s
    LEFT JOIN (SELECT sample_id, arg_max((x1 + x2) / 2, conf * 100 - box_no / 1000.0) AS cx, arg_max((y1 + y2) / 2, conf * 100 - box_no / 1000.0) AS cy, arg_max(greatest(sqrt(w * w + h * h), 1e-4), conf * 100 - box_no / 1000.0) AS diag FROM $boxes q WHERE cls = 1 GROUP BY 1) t USING (sample_id)
    LEFT JOIN (SELECT * FROM $boxes q WHERE cls = 0) b ON b.sample_id = s.sample_id GROUP BY s.sample_id, t.sample_id""")
def _(fx):
    return rounded(J.context_distance(fx.scene).select("sample_id", "context"), "context", digits=5)


@query("j19_assign_detection_to_track", """
    SELECT det_id, track_id, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, track_id) AS rn FROM (
      SELECT a.det_id, b.det_id AS track_id, i / (a.w * a.h + b.w * b.h - i) AS iou FROM (SELECT a.*, b.det_id AS tid, greatest(least(a.x2, b.x2 + b.k % 9) - greatest(a.x1, b.x1 + b.k % 9), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i FROM $boxes a JOIN $boxes b USING (sample_id)) a
      JOIN $boxes b ON b.det_id = a.tid) WHERE iou > 0.5) WHERE rn = 1""")
def _(fx):
    s = F.col("k") % 9
    t = fx.boxes.select("sample_id", F.col("det_id").alias("track_id"), (F.col("x1") + s).alias("x1"), "y1", (F.col("x2") + s).alias("x2"), "y2")
    return rounded(J.assign_detection_to_track(fx.boxes, t, keys=("sample_id",)).drop("sample_id"), "iou")


@query("g01_union_sources", """
    SELECT origin, cls, count(*) AS n FROM (SELECT 'x' AS origin, CAST(CASE cls WHEN 0 THEN 0 ELSE 1 END AS INT) AS cls FROM $boxes q WHERE k % 2 = 0 AND cls <> 1
      UNION ALL SELECT 'y', CAST(5 AS INT) FROM $boxes q WHERE k % 2 = 1 AND cls = 1) GROUP BY 1, 2""")
def _(fx):
    b = fx.boxes.select("sample_id", "cls", "k")
    return G.union_sources({"x": (b.where("k % 2 = 0"), {0: 0, 2: 1}), "y": (b.where("k % 2 = 1"), {1: 5})}).groupBy("origin", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("g02_difference", "SELECT sample_id FROM $samples s WHERE sample_id % 6 <> 0")
def _(fx):
    p = fx.samples.select("sample_id", F.concat(F.lit("/a/"), F.col("sample_id").cast("string"), F.lit(".jpg")).alias("path"))
    done = fx.samples.where("sample_id % 6 = 0").select(F.concat(F.lit("/other/x/"), F.col("sample_id").cast("string"), F.lit(".png")).alias("path"))
    return G.difference(p, done).select("sample_id")


@query("g03_mix_with_cap", """
    SELECT CAST(count(*) AS BIGINT) AS trusted, least(CAST(floor(0.25 / 0.75 * count(*)) AS BIGINT), (SELECT count(*) FROM $samples q WHERE sample_id % 5 <> 0)) AS auto FROM $samples q WHERE sample_id % 5 = 0""")
def _(fx):
    s = fx.samples.withColumn("origin", F.when(F.col("sample_id") % 5 == 0, "t").otherwise("a"))
    mixed = G.mix_with_cap(s.where("origin = 't'"), s.where("origin = 'a'"), 0.25)
    return mixed.agg(F.count_if(F.col("origin") == "t").alias("trusted"), F.count_if(F.col("origin") == "a").alias("auto"))


@query("g04_merge_hand_over_auto", """
    SELECT sample_id, 'hand' AS origin FROM $samples q WHERE sample_id % 3 = 0 UNION ALL SELECT sample_id, 'auto' FROM $samples q WHERE sample_id % 2 = 0 AND sample_id % 3 <> 0 AND sample_id % 10 <> 4
      AND video_id NOT IN (SELECT video_id FROM $samples q WHERE sample_id % 101 = 0)""")
def _(fx):
    s = fx.samples.select("sample_id", "video_id")
    return G.merge_hand_over_auto(s.where("sample_id % 3 = 0"), s.where("sample_id % 2 = 0"), s.where("sample_id % 10 <> 4"), s.where("sample_id % 101 = 0")).select("sample_id", "origin")


@query("c10_protect_class", """
    SELECT sample_id FROM $samples s WHERE video_id NOT IN (SELECT video_id FROM $samples s JOIN $boxes b USING (sample_id) WHERE cls = 2 AND conf > 0.9)""")
def _(fx):
    return G.protect_class(fx.samples, fx.boxes.where("conf > 0.9"), 2).select("sample_id")
