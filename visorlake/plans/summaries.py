"""Queries of counts, leaderboards and scores."""
from pyspark.sql import functions as F

from visorlake.operators import metrics as M, stats as A
from visorlake.plans.registry import query, rounded
from visorlake.sources.tables import bind_annotation_tables

SPLIT = "CASE WHEN s.sample_id % 10 = 0 THEN 'test' WHEN s.sample_id % 10 = 1 THEN 'valid' ELSE 'train' END"


def _split():
    return F.when(F.col("sample_id") % 10 == 0, "test").when(F.col("sample_id") % 10 == 1, "valid").otherwise("train")


def _tool(fx):
    return bind_annotation_tables({"task_completion": fx.annotations, "htx_user": fx.users, "project": fx.projects, "task": fx.tasks})


PER = "(SELECT sample_id, count(*) AS n, count(CASE WHEN cls = 0 THEN 1 END) AS c0, count(CASE WHEN cls = 1 THEN 1 END) AS c1, count(CASE WHEN cls = 2 THEN 1 END) AS c2 FROM $boxes q GROUP BY 1)"


@query("a01_dataset_stats", f"""
    SELECT split, CAST(grouping(split) AS INT) AS is_total, count(*) AS images, count(*) - count(n) AS background, CAST(coalesce(sum(c0), 0) AS BIGINT) AS boxes_0, CAST(coalesce(sum(c1), 0) AS BIGINT) AS boxes_1, CAST(coalesce(sum(c2), 0) AS BIGINT) AS boxes_2
    FROM (SELECT s.sample_id, {SPLIT} AS split FROM $samples s) s LEFT JOIN {PER} p USING (sample_id) GROUP BY ROLLUP (split)""")
def _(fx):
    return A.dataset_stats(fx.samples.select("sample_id", _split().alias("split")), fx.boxes, [0, 1, 2])


@query("a02_conversion_report", """
    SELECT count(CASE WHEN img THEN 1 END) AS images, CAST(sum(CASE WHEN img THEN ok ELSE 0 END) AS BIGINT) AS boxes, CAST(sum(CASE WHEN img THEN bad ELSE 0 END) AS BIGINT) AS dropped, count(CASE WHEN NOT img THEN 1 END) AS missing,
      count(CASE WHEN img AND ok = 0 THEN 1 END) AS empty FROM (SELECT s.sample_id, s.sample_id % 8 <> 0 AS img, count(CASE WHEN w >= 20 THEN 1 END) AS ok, count(CASE WHEN w < 20 THEN 1 END) AS bad FROM $samples s LEFT JOIN $boxes b USING (sample_id) GROUP BY 1)""")
def _(fx):
    return A.conversion_report(fx.samples.join(fx.boxes, "sample_id", "left").select("sample_id", (F.col("sample_id") % 8 != 0).alias("has_image"), (F.col("w") >= 20).alias("valid")))


@query("a03_label_stats", f"""
    SELECT frames, with_0, with_1, with_2, with_any, empty, boxes, round(100.0 * with_0 / frames, 6) AS pct_with_0, round(100.0 * with_1 / frames, 6) AS pct_with_1, round(100.0 * with_2 / frames, 6) AS pct_with_2,
      round(100.0 * with_any / frames, 6) AS pct_with_any, round(100.0 * empty / frames, 6) AS pct_empty FROM (SELECT count(*) AS frames, count(CASE WHEN c0 > 0 THEN 1 END) AS with_0, count(CASE WHEN c1 > 0 THEN 1 END) AS with_1,
      count(CASE WHEN c2 > 0 THEN 1 END) AS with_2, count(n) AS with_any, count(*) - count(n) AS empty, CAST(sum(n) AS BIGINT) AS boxes FROM $samples s LEFT JOIN {PER} p USING (sample_id))""")
def _(fx):
    out = A.label_stats(fx.samples, fx.boxes, [0, 1, 2])
    return rounded(out, *[c for c in out.columns if c.startswith("pct")])


LIVE = "(SELECT a.*, t.project_id FROM $annotations a JOIN $tasks t ON t.id = a.task_id WHERE was_cancelled = 0)"
BOARD = f"(SELECT project_id, completed_by_id AS user_id, count(*) AS n FROM {LIVE} l GROUP BY 1, 2)"


@query("a04_annotator_leaderboard", f"""
    SELECT b.project_id, b.user_id, coalesce(nullif(trim(concat(coalesce(u.first_name, ''), ' ', coalesce(u.last_name, ''))), ''), u.email, concat('user', CAST(b.user_id AS VARCHAR))) AS name, b.n
    FROM {BOARD} b LEFT JOIN $users u ON u.id = b.user_id""")
def _(fx):
    return A.annotator_leaderboard(_tool(fx))


@query("a05_project_progress", f"""
    SELECT p.id AS project_id, coalesce(p.title, concat('project ', CAST(p.id AS VARCHAR))) AS title, coalesce(t.total, 0) AS total, coalesce(d.done, 0) AS done FROM $projects p
    LEFT JOIN (SELECT project_id, count(*) AS total FROM $tasks q GROUP BY 1) t ON t.project_id = p.id LEFT JOIN (SELECT project_id, count(DISTINCT task_id) AS done FROM {LIVE} l GROUP BY 1) d ON d.project_id = p.id""")
def _(fx):
    return A.project_progress(_tool(fx))


@query("a06_active_annotators", f"SELECT count(DISTINCT completed_by_id) AS active FROM {LIVE} l WHERE updated_at >= TIMESTAMP '1997-06-01 00:00:00' - INTERVAL 86400 SECOND")
def _(fx):
    return A.active_annotators(_tool(fx), F.lit("1997-06-01 00:00:00").cast("timestamp"), 86400)


@query("a07_overlap_distribution", f"""
    SELECT project_id, annotations, tasks, round(100.0 * sum(CASE WHEN annotations >= 2 THEN tasks ELSE 0 END) OVER (PARTITION BY project_id) / sum(tasks) OVER (PARTITION BY project_id), 6) AS pct_multi FROM (
      SELECT project_id, annotations, count(*) AS tasks FROM (SELECT project_id, task_id, count(*) AS annotations FROM {LIVE} l GROUP BY 1, 2) GROUP BY 1, 2)""")
def _(fx):
    return rounded(A.overlap_distribution(_tool(fx)), "pct_multi")


@query("a08_leaderboard_totals", f"""
    WITH b AS (SELECT project_id, user_id, n, CAST(0 AS INT) AS all_projects FROM {BOARD} b1 UNION ALL SELECT NULL, user_id, CAST(sum(n) AS BIGINT), CAST(1 AS INT) FROM {BOARD} b2 GROUP BY user_id),
    t AS (SELECT p.id AS pid, (SELECT count(*) FROM $tasks q WHERE q.project_id = p.id) AS total, (SELECT count(DISTINCT task_id) FROM {LIVE} l WHERE l.project_id = p.id) AS done FROM $projects p),
    g AS (SELECT pid, total, done FROM t UNION ALL SELECT NULL, sum(total), sum(done) FROM t)
    SELECT project_id, user_id, n, all_projects, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, user_id) AS INT) AS rank, round(CASE WHEN total > 0 THEN 100.0 * done / total ELSE 0 END, 6) AS pct_done FROM b JOIN g ON b.project_id IS NOT DISTINCT FROM g.pid""")
def _(fx):
    return rounded(A.leaderboard_totals(_tool(fx)), "pct_done")


@query("a09_tally", "SELECT source, cls, count(*) AS n FROM $boxes b JOIN $samples s USING (sample_id) GROUP BY 1, 2")
def _(fx):
    return A.tally(fx.boxes.join(fx.samples, "sample_id"), "source", "cls")


@query("a10_histogram", "SELECT concat(CAST(b AS VARCHAR), '-', CAST(b + 10 AS VARCHAR), '%') AS bin, count(*) AS n FROM (SELECT CAST(floor(conf * 10) AS INT) * 10 AS b FROM $boxes q) GROUP BY b")
def _(fx):
    return A.histogram(fx.boxes, "conf")


@query("a11_median_kept", "SELECT median(n) AS median FROM (SELECT video_id, count(*) AS n FROM $samples q GROUP BY 1)")
def _(fx):
    return A.median_kept(fx.samples)


@query("a11_upper_median", "SELECT source, list_sort(list(w))[len(list(w)) // 2 + 1] AS upper_median FROM $boxes b JOIN $samples s USING (sample_id) GROUP BY 1")
def _(fx):
    return A.upper_median(fx.boxes.join(fx.samples, "sample_id").select("source", "w"), ["source"], "w")


CLIPS = "(SELECT concat('p', CAST(o_custkey % 90 AS VARCHAR)) AS person, CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 50 = 0 THEN 'Indoor' ELSE 'Outdoor' END AS domain, o_orderkey % 1000 * 1000 AS length, CAST(o_orderkey % 17 AS DOUBLE) AS minutes FROM orders)"


def _clips(fx):
    o = fx.table("orders")
    return o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 90).cast("string")).alias("person"),
                    F.when((F.col("o_custkey") % 7 == 0) | (F.col("o_orderkey") % 50 == 0), "Indoor").otherwise("Outdoor").alias("domain"),
                    (F.col("o_orderkey") % 1000 * 1000).alias("length"), (F.col("o_orderkey") % 17).cast("double").alias("minutes"))


@query("a12_footage_by_person", f"SELECT person, string_agg(DISTINCT domain, '+' ORDER BY domain) AS domains, count(*) AS videos, round(CAST(sum(length) AS DOUBLE) / 1e6, 6) AS size_mb, sum(minutes) AS minutes FROM {CLIPS} c GROUP BY 1")
def _(fx):
    return rounded(A.footage_by_person(_clips(fx)), "size_mb")


@query("a12_footage_by_split", f"""
    SELECT split, count(*) AS people, CAST(sum(videos) AS BIGINT) AS videos, sum(minutes) AS weight, sum(CASE WHEN ind THEN minutes ELSE 0 END) AS indoor, sum(CASE WHEN outd THEN minutes ELSE 0 END) AS outdoor, round(sum(minutes) / sum(sum(minutes)) OVER (), 6) AS share FROM (
      SELECT person, CASE WHEN CAST(person[2:] AS INT) % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS videos, sum(minutes) AS minutes, bool_or(domain = 'Indoor') AS ind, bool_or(domain = 'Outdoor') AS outd FROM {CLIPS} c GROUP BY 1) GROUP BY split""")
def _(fx):
    p = A.footage_by_person(_clips(fx)).withColumn("split", F.when(F.substring("person", 2, 9).cast("int") % 5 == 0, "val").otherwise("train"))
    return rounded(A.footage_by_split(p), "share")


@query("a13_class_weights", """
    SELECT n_neg, n_pos, round((n_neg + n_pos) / (2.0 * greatest(n_neg, 1)), 6) AS w_neg, round((n_neg + n_pos) / (2.0 * greatest(n_pos, 1)), 6) AS w_pos, round(n_neg / CAST(greatest(n_pos, 1) AS DOUBLE), 6) AS pos_weight FROM (
      SELECT count(CASE WHEN quality = 0 THEN 1 END) AS n_neg, count(CASE WHEN quality = 1 THEN 1 END) AS n_pos FROM labels)""")
def _(fx):
    return rounded(A.class_weights(fx.table("labels"), "quality"), "w_neg", "w_pos", "pos_weight")


@query("a14_frames_with_class", "SELECT model, count(DISTINCT CASE WHEN cls = 2 THEN sample_id END) AS frames FROM (SELECT sample_id, cls, CAST(k % 2 AS INT) AS model FROM $boxes q) GROUP BY 1")
def _(fx):
    return A.frames_with_class(fx.boxes.withColumn("model", (F.col("k") % 2).cast("int")), 2, keys=("sample_id",))


@query("a15_pair_separation", """
    SELECT round(min(CASE WHEN same THEN c END), 5) AS same_min, round(max(CASE WHEN same THEN c END), 5) AS same_max, round(avg(CASE WHEN same THEN c END), 5) AS same_mean, round(min(CASE WHEN NOT same THEN c END), 5) AS diff_min, round(max(CASE WHEN NOT same THEN c END), 5) AS diff_max,
      round(avg(CASE WHEN NOT same THEN c END), 5) AS diff_mean, round((max(CASE WHEN NOT same THEN c END) + min(CASE WHEN same THEN c END)) / 2, 5) AS threshold FROM (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7)""")
def _(fx):
    from visorlake.functions.vectors import cosine
    e = fx.table("embeddings")
    j = e.join(e.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("l2")), "vec_id")
    out = M.pair_separation(j.select(cosine("embedding", "other").alias("cosine"), (F.col("label") == F.col("l2")).alias("same")))
    return rounded(out, *out.columns, digits=5)


@query("a16_binary_metrics", """
    SELECT lang, tp, fp, fn, tn, round((tp + tn) / CAST(greatest(tp + fp + fn + tn, 1) AS DOUBLE), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-6), 6) AS f1 FROM (
      SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS p, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS r FROM (SELECT lang, count(CASE WHEN q AND pr THEN 1 END) AS tp, count(CASE WHEN NOT q AND pr THEN 1 END) AS fp, count(CASE WHEN q AND NOT pr THEN 1 END) AS fn,
        count(CASE WHEN NOT q AND NOT pr THEN 1 END) AS tn FROM (SELECT lang, quality = 1 AS q, n_chars > 400 AS pr FROM labels JOIN documents USING (doc_id)) GROUP BY 1))""")
def _(fx):
    d = fx.table("labels").join(fx.table("documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", F.col("quality").alias("truth"), (F.col("n_chars") > 400).cast("int").alias("pred"))
    return rounded(M.binary_metrics(d, keys=("lang",)), "accuracy", "precision", "recall", "f1")


@query("a17_keypoint_metrics", """
    SELECT round(sum(d) / greatest(count(*), 1), 6) AS mean_error, round(count(CASE WHEN d < 0.1 THEN 1 END) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS pck, count(*) AS points FROM (SELECT sqrt((a - c) * (a - c) + (b - d) * (b - d)) AS d FROM (
      SELECT CAST(e.embedding[2 * i + 1] AS DOUBLE) AS a, CAST(e.embedding[2 * i + 2] AS DOUBLE) AS b, CAST(f.embedding[2 * i + 1] AS DOUBLE) AS c, CAST(f.embedding[2 * i + 2] AS DOUBLE) AS d FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1, (SELECT unnest(range(21)) AS i) r WHERE (i + e.vec_id) % 4 <> 0))""")
def _(fx):
    p = fx.points.select("vec_id", "points")
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("points").alias("pred"))
    t = F.transform("points", lambda q, i: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.when((i + F.col("vec_id")) % 4 != 0, 2).otherwise(0).alias("v")))
    return rounded(M.keypoint_metrics(p.join(nxt, "vec_id").withColumn("truth", t)), "mean_error", "pck")


def _preds(fx):
    b = fx.boxes
    s = F.col("k") % 11
    preds = b.where("k % 13 <> 0").select("sample_id", "cls", "det_id", "conf", (F.col("x1") + s).alias("x1"), "y1", (F.col("x2") + s).alias("x2"), "y2")
    return preds, b.withColumnRenamed("det_id", "gt_id")


DET = """
    WITH g AS MATERIALIZED (SELECT sample_id, cls, det_id AS gt_id, x1, y1, x2, y2 FROM $boxes q),
    p AS MATERIALIZED (SELECT sample_id, cls, det_id, conf, x1 + k % 11 AS x1, y1, x2 + k % 11 AS x2, y2 FROM $boxes q WHERE k % 13 <> 0),
    o AS (SELECT p.det_id, p.conf, p.cls, g.gt_id, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s FROM p JOIN g USING (sample_id, cls)),
    c AS MATERIALIZED (SELECT det_id, conf, gt_id, iou FROM (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY det_id ORDER BY i / (s - i) DESC, gt_id) AS rn FROM o WHERE i / (s - i) >= 0.5) WHERE rn = 1),
    th AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS DOUBLE) AS threshold),
    w AS (SELECT threshold, arg_min(det_id, -conf * 1e12 + det_id) AS det_id FROM c, th WHERE iou >= threshold GROUP BY threshold, gt_id),
    st AS (SELECT threshold, cls, conf, count(w2.det_id) AS tp, count(*) AS n FROM (SELECT p.*, th.threshold FROM p, th) e LEFT JOIN (SELECT threshold AS t2, det_id FROM w) w2 ON w2.t2 = e.threshold AND w2.det_id = e.det_id GROUP BY 1, 2, 3),
    np AS (SELECT cls, count(*) AS n_truth FROM g GROUP BY 1),
    cu AS MATERIALIZED (SELECT *, CAST(tpc AS DOUBLE) / n_truth AS recall, CAST(tpc AS DOUBLE) / rk AS precision FROM (SELECT *, CAST(sum(tp) OVER x AS BIGINT) AS tpc, CAST(sum(n) OVER x AS BIGINT) AS rk FROM st WINDOW x AS (PARTITION BY threshold, cls ORDER BY conf DESC)) JOIN np USING (cls))"""


@query("a18_precision_recall", DET + " SELECT threshold, cls, conf, tpc AS tp_cum, rk AS rank, n_truth, round(recall, 6) AS recall, round(precision, 6) AS precision FROM cu")
def _(fx):
    p, t = _preds(fx)
    c = M.precision_recall(p, t, [round(0.5 + 0.05 * i, 2) for i in range(10)])
    return rounded(c.drop("_slice"), "recall", "precision")


AP = DET + """,
    ev AS (SELECT *, max(precision) OVER (PARTITION BY threshold, cls ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu),
    pt AS (SELECT threshold, cls, rk, recall, env FROM ev UNION ALL SELECT DISTINCT threshold, cls, -1, 0.0, 1.0 FROM ev UNION ALL SELECT DISTINCT threshold, cls, 9000000000000, 1.0, 0.0 FROM ev),
    sg AS (SELECT threshold, cls, recall AS r0, env AS e0, lead(recall) OVER y AS r1, lead(env) OVER y AS e1 FROM pt WINDOW y AS (PARTITION BY threshold, cls ORDER BY rk)),
    ap AS (SELECT threshold, cls, sum((e0 + (e1 - e0) / (r1 - r0) * (x - r0)) * CASE WHEN x = 0.0 OR x = 1.0 THEN 0.5 ELSE 1.0 END / 100) AS ap FROM sg, (SELECT CAST(unnest(range(101)) AS DOUBLE) / 100 AS x) gr WHERE x >= r0 AND x < r1 GROUP BY 1, 2),
    bs AS (SELECT cls, arg_max(precision, 2 * precision * recall / greatest(precision + recall, 1e-16) - rk * 1e-13) AS precision, arg_max(recall, 2 * precision * recall / greatest(precision + recall, 1e-16) - rk * 1e-13) AS recall FROM cu WHERE threshold = 0.5 GROUP BY 1),
    res AS (SELECT np.cls, n_truth, precision, recall, ap50, ap50_95 FROM np LEFT JOIN bs USING (cls) LEFT JOIN (SELECT cls, max(CASE WHEN threshold = 0.5 THEN ap END) AS ap50, sum(ap) / 10 AS ap50_95 FROM ap GROUP BY 1) a USING (cls))"""


@query("a18_detection_metrics", AP + " SELECT cls, n_truth, round(precision, 5) AS precision, round(recall, 5) AS recall, round(ap50, 5) AS ap50, round(ap50_95, 5) AS ap50_95 FROM res")
def _(fx):
    return rounded(M.detection_metrics(*_preds(fx)), "precision", "recall", "ap50", "ap50_95", digits=5)


@query("a19_metric_deltas", """
    WITH f AS (SELECT lang, CAST(n_chars > 400 AS INT) AS a, CAST(n_chars > 900 AS INT) AS b, quality AS t FROM labels JOIN documents USING (doc_id)),
    x AS (SELECT lang, 'precision' AS metric, sum(a * t) / CAST(greatest(sum(a), 1) AS DOUBLE) AS before FROM f GROUP BY 1 UNION ALL SELECT lang, 'recall', sum(a * t) / CAST(greatest(sum(t), 1) AS DOUBLE) FROM f GROUP BY 1),
    y AS (SELECT lang, 'precision' AS metric, sum(b * t) / CAST(greatest(sum(b), 1) AS DOUBLE) AS after FROM f WHERE lang <> 'en' GROUP BY 1 UNION ALL SELECT lang, 'recall', sum(b * t) / CAST(greatest(sum(t), 1) AS DOUBLE) FROM f WHERE lang <> 'en' GROUP BY 1)
    SELECT lang, metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM x FULL JOIN y USING (lang, metric)""")
def _(fx):
    d = fx.table("labels").join(fx.table("documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("truth", F.col("quality"))
    one, two = (M.binary_metrics(d.withColumn("pred", (F.col("n_chars") > n).cast("int")), keys=("lang",)) for n in (400, 900))
    return rounded(M.metric_deltas(one, two.where("lang <> 'en'"), ("lang",), ("precision", "recall")), "before", "after", "delta")


@query("a20_vector_parity", """
    SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_avg(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 6) AS mad,
      round(list_avg(list_transform(range(1, 65), lambda i: abs(a[i] / sqrt(list_inner_product(a, a)) - b[i] / sqrt(list_inner_product(b, b))))), 6) AS mad_normalized FROM (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda v: round(v * 16, 0) / 8) AS b FROM embeddings)""")
def _(fx):
    e = fx.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    out = M.vector_parity(e.withColumn("b", F.transform("a", lambda v: F.round(v * 16, 0) / 8))).select("vec_id", "cosine", "mad", "mad_normalized")
    return rounded(out, "cosine", "mad", "mad_normalized")


@query("a21_identity_templates", """
    WITH RECURSIVE o AS MATERIALIZED (SELECT label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    t(label, n, m) AS (SELECT label, n, list_transform(e, lambda v: v / (sqrt(list_inner_product(e, e)) + 1e-9)) FROM o WHERE n = 1
      UNION ALL SELECT label, n, list_transform(s, lambda v: v / (sqrt(list_inner_product(s, s)) + 1e-9)) FROM (SELECT o.label, o.n, list_transform(range(1, 65), lambda i: (t.m[i] * t.n + o.e[i]) / (t.n + 1)) AS s FROM t JOIN o ON o.label = t.label AND o.n = t.n + 1))
    SELECT label, max(n) AS count, round(arg_max(m, n)[1], 5) AS first, round(arg_max(m, n)[64], 5) AS last FROM t GROUP BY 1""")
def _(fx):
    t = M.identity_templates(fx.table("embeddings"), key="label", order="vec_id")
    return rounded(t.select("label", "count", F.col("template")[0].alias("first"), F.col("template")[63].alias("last")), "first", "last", digits=5)


@query("a22_run_totals", "SELECT CAST(coalesce(sum(CASE WHEN video_id % 7 <> 0 THEN n END), 0) AS BIGINT) AS frames, CAST(coalesce(sum(CASE WHEN video_id % 7 <> 0 THEN p END), 0) AS BIGINT) AS labels FROM (SELECT video_id, count(*) AS n, count(CASE WHEN cls = 0 THEN 1 END) AS p FROM $frames q GROUP BY 1)")
def _(fx):
    per = fx.frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("cls") == 0).alias("labels"))
    failed = F.col("video_id") % 7 == 0
    return A.run_totals(per.withColumns({c: F.when(~failed, F.col(c)) for c in ("frames", "labels")}), ("frames", "labels"))
