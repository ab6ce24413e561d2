"""Queries of column transforms and filters."""
from pyspark.sql import functions as F

from visorlake.functions import boxes as B, decode as D, names as N, pixels as X, vectors as V
from visorlake.operators import filters as L
from visorlake.plans.registry import query, rounded

C01 = "least(greatest({}, 0.0), 1.0)"


@query("p01_box_from_xywh_norm", """
    SELECT sample_id, box_no, round(cx, 9) AS cx, round(cy, 9) AS cy, round(bw, 9) AS bw, round(bh, 9) AS bh FROM (
      SELECT sample_id, box_no, least(greatest(x1 / 500.0 + w / 640.0 / 2, 0.0), 1.0) AS cx, least(greatest(y1 / 400.0 + h / 480.0 / 2, 0.0), 1.0) AS cy,
        least(greatest(w / 640.0, 0.0), 1.0) AS bw, least(greatest(h / 480.0, 0.0), 1.0) AS bh FROM $boxes q) WHERE bw > 0 AND bh > 0""")
def _(fx):
    b = fx.boxes.withColumns({"x": F.col("x1") / 500.0, "y": F.col("y1") / 400.0, "w": F.col("w") / 640.0, "h": F.col("h") / 480.0})
    return rounded(B.box_from_xywh_norm(b), "cx", "cy", "bw", "bh", digits=9).select("sample_id", "box_no", "cx", "cy", "bw", "bh")


@query("p02_box_from_xywh_px", """
    SELECT sample_id, box_no, round((l + pw / 2) / 640.0, 9) AS cx, round((t + ph / 2) / 480.0, 9) AS cy, round(pw / 640.0, 9) AS bw, round(ph / 480.0, 9) AS bh
    FROM (SELECT sample_id, box_no, greatest(x1 - 30, 0.0) AS l, greatest(y1 - 30, 0.0) AS t,
      least(x1 - 30 + w, 640.0) - greatest(x1 - 30, 0.0) AS pw, least(y1 - 30 + h, 480.0) - greatest(y1 - 30, 0.0) AS ph FROM $boxes q) WHERE pw > 0 AND ph > 0""")
def _(fx):
    b = fx.boxes.withColumns({"x1": F.col("x1") - 30, "y1": F.col("y1") - 30, "width": F.lit(640), "height": F.lit(480)})
    return rounded(B.box_from_xywh_px(b), "cx", "cy", "bw", "bh", digits=9).select("sample_id", "box_no", "cx", "cy", "bw", "bh")


@query("p03_box_xyxy_to_center", """
    SELECT sample_id, box_no, round(CASE WHEN ok THEN (a1 + a2) / 2 / 640.0 END, 9) AS cx, round(CASE WHEN ok THEN (b1 + b2) / 2 / 480.0 END, 9) AS cy,
      round(CASE WHEN ok THEN (a2 - a1) / 640.0 END, 9) AS bw, round(CASE WHEN ok THEN (b2 - b1) / 480.0 END, 9) AS bh FROM (
      SELECT *, a2 > a1 AND b2 > b1 AS ok FROM (SELECT sample_id, box_no, least(greatest(x1 + 60, 0.0), 639.0) AS a1, least(greatest(x2 + 60, 0.0), 639.0) AS a2,
        least(greatest(y1, 0.0), 479.0) AS b1, least(greatest(y2, 0.0), 479.0) AS b2 FROM $boxes q))""")
def _(fx):
    b = fx.boxes.withColumns({"x1": F.col("x1") + 60, "x2": F.col("x2") + 60, "width": F.lit(640), "height": F.lit(480)})
    return rounded(B.box_xyxy_to_center(b), "cx", "cy", "bw", "bh", digits=9).select("sample_id", "box_no", "cx", "cy", "bw", "bh")


@query("p03_box_center_to_xyxy", "SELECT sample_id, box_no, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM $boxes q")
def _(fx):
    c = fx.boxes.select("sample_id", "box_no", ((F.col("x1") + F.col("x2")) / 2 / 640).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / 480).alias("cy"),
                        (F.col("w") / 640).alias("bw"), (F.col("h") / 480).alias("bh"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return rounded(B.box_center_to_xyxy(c), "x1", "y1", "x2", "y2").select("sample_id", "box_no", "x1", "y1", "x2", "y2")


@query("p04_polygon_to_box", "SELECT det_id, x1 - 2 AS x1, y1, x2, greatest(y1 + 3, y2) AS y2 FROM $boxes q")
def _(fx):
    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    p = fx.boxes.select("det_id", F.array(pt(x1, y1), pt(x2, y1 + 3), pt(x1 - 2, y2), pt(x2, y2)).alias("points"))
    return B.polygon_to_box(p).select("det_id", "x1", "y1", "x2", "y2")


@query("p05_remap_classes", "SELECT det_id, CAST(CASE cls WHEN 0 THEN 0 ELSE 1 END AS INT) AS cls FROM $boxes q WHERE cls IN (0, 2)")
def _(fx):
    return B.remap_classes(fx.boxes.select("det_id", "cls"), {0: 0, 2: 1})


@query("p06_keypoints_flip", """
    SELECT vec_id, CAST(i AS INT) AS i, round(1.0 - CAST(embedding[(20 - i) * 3 + 1] AS DOUBLE), 6) AS x, round(CAST(embedding[(20 - i) * 3 + 2] AS DOUBLE), 6) AS y,
      CAST(CASE WHEN embedding[(20 - i) * 3 + 3] > 0 THEN 1 ELSE 0 END AS INT) AS v FROM embeddings, (SELECT unnest(range(21)) AS i) r""")
def _(fx):
    k = fx.table("embeddings").select("vec_id", B.keypoints_reshape("embedding", 21).alias("k"))
    f = k.select("vec_id", F.posexplode(B.keypoints_flip("k", list(range(20, -1, -1)))).alias("i", "p"))
    return rounded(f.select("vec_id", "i", "p.x", "p.y", "p.v"), "x", "y")


@query("p07_project_points", """
    SELECT vec_id, round((max(u) + min(u)) / 2, 4) AS cx, round((max(v) + min(v)) / 2, 4) AS cy, round(greatest(max(u) - min(u), max(v) - min(v)) * 1.4, 4) AS side FROM (
      SELECT vec_id, (500 * CAST(embedding[3 * i + 1] AS DOUBLE) + 320 * z) / z AS u, (480 * CAST(embedding[3 * i + 2] AS DOUBLE) + 240 * z) / z AS v FROM (
        SELECT vec_id, embedding, i, CAST(embedding[3 * i + 3] AS DOUBLE) + 3 AS z FROM embeddings, (SELECT unnest(range(21)) AS i) r)) GROUP BY vec_id""")
def _(fx):
    e = fx.table("embeddings")
    xyz = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(*[F.get("embedding", i * 3 + j).cast("double") + (3 if j == 2 else 0) for j in range(3)]))
    k = F.array(*[F.array(*map(F.lit, r)) for r in ([500.0, 0.0, 320.0], [0.0, 480.0, 240.0], [0.0, 0.0, 1.0])])
    return rounded(B.project_points(e.select("vec_id", k.alias("k"), xyz.alias("xyz"))), "cx", "cy", "side", digits=4).select("vec_id", "cx", "cy", "side")


@query("p08_crop_keypoints", """
    SELECT vec_id, CAST(i AS INT) AS i, round((px * 640 - x0) / side, 6) AS x, round((py * 480 - y0) / side, 6) AS y, round(px, 6) AS back_x FROM (
      SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS px, CAST(embedding[2 * i + 2] AS DOUBLE) AS py, (40 + vec_id % 60) * 1.3 AS side,
        300 - (40 + vec_id % 60) * 1.3 / 2 AS x0, 200 - (40 + vec_id % 60) * 1.3 / 2 AS y0 FROM embeddings, (SELECT unnest(range(21)) AS i) r)""")
def _(fx):
    side = (F.col("vec_id") % 60 + 40).cast("double")
    x0, y0, s = B.square_crop(F.lit(300.0), F.lit(200.0), side, F.lit(30.0))
    W, H = F.lit(640), F.lit(480)
    p = fx.points.withColumn("crop", B.crop_keypoints("points", x0, y0, s, W, H))
    p = p.withColumn("back", B.uncrop_keypoints("crop", x0, y0, s, W, H))
    rows = p.select("vec_id", F.posexplode(F.arrays_zip("crop", "back")).alias("i", "z"))
    return rounded(rows.select("vec_id", "i", "z.crop.x", "z.crop.y", F.col("z.back.x").alias("back_x")), "x", "y", "back_x")


@query("p09_pairwise_distance_features", """
    WITH p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(21)) AS i) r),
    s AS (SELECT a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 1e-6 AS s FROM p a JOIN p b USING (vec_id) WHERE a.i = 0 AND b.i = 9)
    SELECT vec_id, count(*) AS n, round(sum(d / s), 5) AS total, round(max(d / s), 5) AS largest FROM (
      SELECT a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b USING (vec_id) WHERE a.i < b.i) JOIN s USING (vec_id) GROUP BY vec_id""")
def _(fx):
    f = fx.points.select("vec_id", V.pairwise_distance_features("points").alias("f"))
    return rounded(f.select("vec_id", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("f").alias("largest")),
                   "total", "largest", digits=5)


TEMPLATE = ((38.0, 52.0), (74.0, 51.0), (56.0, 72.0), (42.0, 92.0), (71.0, 92.0))


@query("p10_fit_similarity", """
    WITH p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y,
        CAST([38, 74, 56, 42, 71][i + 1] AS DOUBLE) AS u, CAST([52, 51, 72, 92, 92][i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(5)) AS i) r),
    m AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY vec_id),
    s AS (SELECT vec_id, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS den,
        sum((u - mu) * (x - mx) + (v - mv) * (y - my)) AS na, sum((v - mv) * (x - mx) - (u - mu) * (y - my)) AS nb FROM p JOIN m USING (vec_id) GROUP BY vec_id)
    SELECT vec_id, round(na / den, 5) AS a, round(nb / den, 5) AS b, round(mu - (na / den * mx - nb / den * my), 5) AS tx, round(mv - (nb / den * mx + na / den * my), 5) AS ty
    FROM s WHERE den >= 1e-6""")
def _(fx):
    dst = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in TEMPLATE])
    f = fx.points.select("vec_id", B.fit_similarity(F.slice("points", 1, 5), dst).alias("m")).where("m IS NOT NULL")
    return rounded(f.select("vec_id", "m.*"), "a", "b", "tx", "ty", digits=5)


@query("p11_affine", """
    SELECT event_id, round(CASE WHEN event_id % 13 = 0 THEN x ELSE a * x + 0.02 * y + tx END, 6) AS x, round(CASE WHEN event_id % 13 = 0 THEN y ELSE 0.01 * x + a * y + 3 END, 6) AS y,
      round(CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE a * tx + 0.02 * 3 + tx END, 6) AS shift2 FROM (
      SELECT *, 1 + (event_id % 7) / 100.0 AS a, CAST(event_id % 11 AS DOUBLE) AS tx FROM $frames q)""")
def _(fx):
    e = F.col("event_id")
    a, tx = 1 + (e % 7) / 100.0, (e % 11).cast("double")
    f = fx.frames.withColumn("m", F.when(e % 13 != 0, F.array(a, F.lit(0.02), tx, F.lit(0.01), a, F.lit(3.0))))
    x, y = B.affine_apply("m", F.col("x"), F.col("y"))
    return rounded(f.select("event_id", x.alias("x"), y.alias("y"), B.affine_compose(F.col("m"), F.col("m"))[2].alias("shift2")), "x", "y", "shift2")


@query("p12_letterbox", """
    SELECT det_id, round((x1 * r + dx) / 512, 9) AS x1, round((y1 * r + dy) / 512, 9) AS y1, round(x2, 6) AS back_x2, round(y2, 6) AS back_y2 FROM (
      SELECT *, floor((512 - round_even(width * r, 0)) / 2) AS dx, floor((512 - round_even(480 * r, 0)) / 2) AS dy FROM (
        SELECT *, least(512.0 / width, 512.0 / 480) AS r FROM (SELECT *, 400 + 10 * (sample_id % 37) AS width FROM $boxes q)))""")
def _(fx):
    b = fx.boxes.withColumns({"width": 400 + 10 * (F.col("sample_id") % 37), "height": F.lit(480)})
    box = B.letterbox(b, 512)
    back = B.unletterbox(box, 512).select("det_id", F.col("x2").alias("back_x2"), F.col("y2").alias("back_y2"))
    return rounded(rounded(box.select("det_id", "x1", "y1").join(back, "det_id"), "x1", "y1", digits=9), "back_x2", "back_y2")


@query("p13_box_percent", """
    SELECT det_id, round(px, 6) AS px, round(py, 6) AS py, round(pw, 6) AS pw, round(ph, 6) AS ph, round((px + pw / 2) / 100, 6) AS cx FROM (
      SELECT det_id, least(greatest((x1 - 10) / 500.0 * 100, 0.0), 100.0) AS px, least(greatest(y1 / 400.0 * 100, 0.0), 100.0) AS py, least(w / 500.0 * 100, 100.0) AS pw, least(h / 400.0 * 100, 100.0) AS ph FROM $boxes q)""")
def _(fx):
    b = fx.boxes.select("det_id", ((F.col("x1") - 10 + F.col("w") / 2) / 500).alias("cx"), ((F.col("y1") + F.col("h") / 2) / 400).alias("cy"),
                        (F.col("w") / 500).alias("bw"), (F.col("h") / 400).alias("bh"))
    p = B.box_to_percent(b).select("det_id", "px", "py", "pw", "ph")
    return rounded(B.box_from_percent(p).select("det_id", "px", "py", "pw", "ph", "cx"), "px", "py", "pw", "ph", "cx")


@query("p14_parse_frame_name", """
    SELECT sample_id, concat('v_p', CAST(video_id % 40 AS VARCHAR), '_', CAST(video_id AS VARCHAR)) AS video, frame_idx, concat('p', CAST(video_id % 40 AS VARCHAR)) AS person,
      concat('d_', CAST(video_id AS VARCHAR), '_x_clip') AS safe, concat('images/d/labels/', CAST(sample_id AS VARCHAR), '.txt') AS label, concat('images__d__images__', CAST(sample_id AS VARCHAR)) AS flat FROM $samples q""")
def _(fx):
    vid = F.col("video_id").cast("string")
    name = F.concat(F.lit("v_p"), (F.col("video_id") % 40).cast("string"), F.lit("_"), vid, F.lit("_f"), F.lpad(F.col("frame_idx").cast("string"), 6, "0"))
    path = F.concat(F.lit("images/d/images/"), F.col("sample_id").cast("string"), F.lit(".jpg"))
    s = fx.samples.select("sample_id", name.alias("name"), path.alias("path"), F.concat(F.lit("d "), vid, F.lit("/x#clip.mp4")).alias("rel"))
    return N.parse_frame_name(s).select("sample_id", F.col("video_id").alias("video"), "frame_idx", "person", N.safe_id("rel").alias("safe"),
                                        N.label_path("path").alias("label"), N.flat_name("path").alias("flat"))


@query("p15_image_name_from_url", r"""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('img_', CAST(page_id AS VARCHAR), '.jpg')
      ELSE list_last(string_split(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', ''), '/')) END AS image FROM pages""")
def _(fx):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data/local-files/?d=images/img_"), F.col("page_id").cast("string"), F.lit(".jpg"))).otherwise(F.col("url"))
    return fx.table("pages").select("page_id", N.image_name_from_url(u).alias("image"))


@query("p16_display_name", """
    SELECT id, coalesce(nullif(trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))), ''), email, concat('user', CAST(id AS VARCHAR))) AS name FROM $users q""")
def _(fx):
    return fx.users.select("id", N.display_name("first_name", "last_name", "email", "id").alias("name"))


@query("p17_face_fraction", """
    SELECT s.sample_id, box_no, round(coalesce(least(w, h) / 480.0, 0.0), 9) AS face_fraction FROM $samples s LEFT JOIN (SELECT * FROM $boxes q WHERE cls = 0) b USING (sample_id)""")
def _(fx):
    j = fx.samples.join(fx.boxes.where("cls = 0"), "sample_id", "left")
    return rounded(B.face_fraction(j).select("sample_id", "box_no", "face_fraction"), "face_fraction", digits=9)


@query("p18_vector_maths", """
    SELECT a.vec_id, round(list_inner_product(a.e, b.e), 5) AS dot, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(a.e[1] / sqrt(list_inner_product(a.e, a.e)), 6) AS first_unit
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def _(fx):
    e = fx.table("embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt")), "vec_id")
    out = j.select("vec_id", V.dot("embedding", "nxt").alias("dot"), V.cosine("embedding", "nxt").alias("cosine"), V.l2_normalize("embedding")[0].alias("first_unit"))
    return rounded(rounded(out, "dot", digits=5), "cosine", "first_unit")


@query("p19_hamming", "SELECT a.sample_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM $hash a JOIN $hash b ON b.sample_id = a.sample_id + 1")
def _(fx):
    h = fx.hashes.select("sample_id", "hash")
    j = h.join(h.select((F.col("sample_id") - 1).alias("sample_id"), F.col("hash").alias("nxt")), "sample_id")
    return j.select("sample_id", V.hamming("hash", "nxt").alias("distance"))


def _text_images(fx):
    """Document bytes as grey images 24 pixels wide; the whole text is used."""
    raw = F.encode("text", "UTF-8")
    high = F.ceil(F.octet_length(raw) / 24).cast("int")
    data = F.expr("rpad(encode(text, 'UTF-8'), cast(ceil(octet_length(encode(text, 'UTF-8')) / 24) as int) * 24, X'20')")
    return fx.table("documents").where(F.length("text") > 0).select("doc_id", F.struct(
        F.lit("doc").alias("origin"), high.alias("height"), F.lit(24).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).alias("image"))


@query("p20_phash")
def _(fx):
    return _text_images(fx).select("doc_id", X.phash("image").alias("hash"))


@query("p21_appearance")
def _(fx):
    d = _text_images(fx).select("doc_id", X.appearance_descriptor("image").alias("d"), X.green_fraction("image").alias("green"))
    return d.select("doc_id", F.size("d").alias("n"), F.round(V.norm("d"), 4).alias("length"), F.round("green", 6).alias("green"))


@query("p22_sharpness")
def _(fx):
    return _text_images(fx).select("doc_id", F.round(X.sharpness("image"), 4).alias("sharpness"))


@query("p23_face_quality", """
    SELECT det_id, conf >= 0.6 AND least(w / 640.0, h / 480.0) >= 0.07 AND x1 / 640.0 > 0.015 AND x2 / 640.0 < 0.985 AS ok FROM $boxes q""")
def _(fx):
    n = {c: F.col(c) / (640.0 if c[0] == "x" else 480.0) for c in ("x1", "y1", "x2", "y2")}
    return fx.boxes.select("det_id", B.face_quality_ok(F.col("conf"), lambda c: n[c]).alias("ok"))


@query("p23_frontal", """
    SELECT vec_id, coalesce(eyes >= 1.0 AND abs(nx - (lx + rx) / 2) / eyes <= 0.55, FALSE) AS ok FROM (
      SELECT *, sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly)) AS eyes FROM (
        SELECT vec_id, e[1] * 640 AS lx, e[2] * 480 AS ly, e[3] * 640 AS rx, e[4] * 480 AS ry, e[5] * 640 AS nx FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))""")
def _(fx):
    return fx.points.select("vec_id", F.coalesce(B.frontal_ok("points", F.lit(640), F.lit(480)), F.lit(False)).alias("ok"))


@query("p24_iou_distance", """
    SELECT det_id, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 9) AS iou, round(sqrt(s * s + 4.0) / ((w + h) / 2), 9) AS distance FROM (
      SELECT det_id, w, h, s, i, w * h + w * h - i AS u FROM (SELECT det_id, w, h, s, greatest(w - s, 0.0) * greatest(h - 2.0, 0.0) AS i FROM (SELECT *, CAST(k % 30 AS DOUBLE) AS s FROM $boxes q)))""")
def _(fx):
    s = (F.col("k") % 30).cast("double")
    moved = {"x1": F.col("x1") + s, "x2": F.col("x2") + s, "y1": F.col("y1") + 2, "y2": F.col("y2") + 2}
    a, b = B.of(), lambda c: moved[c]
    out = fx.boxes.select("det_id", B.iou(a, b).alias("iou"), B.center_distance(a, b, (F.col("w") + F.col("h")) / 2).alias("distance"))
    return rounded(out, "iou", "distance", digits=9)


@query("p25_uncertainty_score", """
    SELECT sample_id, round(CAST((CASE WHEN club > 0 AND ball = 0 THEN 3.0 ELSE 0 END) + (CASE WHEN green > 0.45 AND ball = 0 AND club = 0 AND hole = 0 THEN 1.5 ELSE 0 END)
      + 0.6 * mid + (CASE WHEN hole >= 0.5 THEN 2.0 WHEN hole > 0 THEN 1.2 WHEN green > 0.45 AND (ball > 0 OR club > 0) THEN 1.0 ELSE 0 END) AS DOUBLE), 6) AS score,
      coalesce(nullif(concat_ws('+', CASE WHEN club > 0 AND ball = 0 THEN 'club_no_ball' END, CASE WHEN green > 0.45 AND ball = 0 AND club = 0 AND hole = 0 THEN 'green_no_det' END,
        CASE WHEN mid > 0 THEN concat('midconf', CAST(mid AS VARCHAR)) END, CASE WHEN hole > 0 THEN 'hole_seen' WHEN green > 0.45 AND (ball > 0 OR club > 0) THEN 'putt_no_hole' END), ''), 'diverse') AS reason
    FROM (SELECT s.sample_id, (s.sample_id % 100) / 100.0 AS green, count(CASE WHEN cls = 0 THEN 1 END) AS ball, count(CASE WHEN cls = 1 THEN 1 END) AS club,
      coalesce(max(CASE WHEN cls = 2 THEN conf END), 0) AS hole, count(CASE WHEN cls < 2 AND conf >= 0.2 AND conf < 0.5 THEN 1 END) AS mid FROM $samples s LEFT JOIN $boxes b USING (sample_id) GROUP BY s.sample_id)""")
def _(fx):
    d = fx.boxes.groupBy("sample_id").agg(F.collect_list(F.struct("cls", "conf")).alias("dets"))
    j = fx.samples.select("sample_id").join(d, "sample_id", "left").withColumns({
        "dets": F.coalesce("dets", F.array().cast("array<struct<cls:int,conf:double>>")), "green": (F.col("sample_id") % 100) / 100.0})
    return rounded(B.uncertainty_score(j).select("sample_id", "score", "reason"), "score")


@query("p26_decode_grid_head", """
    SELECT vec_id, CAST(CASE WHEN v[5] = top THEN 0 WHEN v[6] = top THEN 1 ELSE 2 END AS INT) AS cls, round(1 / (1 + exp(-top)), 6) AS score, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM (
      SELECT vec_id, v, greatest(v[5], v[6], v[7]) AS top, least(greatest((i % 3 + 0.5 - v[1]) / 3, 0), 1) AS x1, least(greatest((i // 3 + 0.5 - v[2]) / 3, 0), 1) AS y1,
        least(greatest((i % 3 + 0.5 + v[3]) / 3, 0), 1) AS x2, least(greatest((i // 3 + 0.5 + v[4]) / 3, 0), 1) AS y2 FROM (SELECT vec_id, i, CAST(embedding[7 * i + 1:7 * i + 7] AS DOUBLE[]) AS v FROM embeddings, (SELECT unnest(range(9)) AS i) r))
    WHERE top > 0 AND x2 > x1 AND y2 > y1""")
def _(fx):
    cell = lambda i: F.transform(F.slice("embedding", i * 7 + 1, F.lit(7)), lambda v: v.cast("double"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: cell(r * 3 + c)))
    d = D.decode_grid_head(fx.table("embeddings").select("vec_id", F.array(grid).alias("heads")))
    return rounded(d, "score", "x1", "y1", "x2", "y2")


@query("p27_decode_fixed_rows", """
    SELECT vec_id, CAST(i AS INT) AS row_no, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(v[5], 6) AS score, round(v[7], 6) AS kx, round(CASE WHEN v[9] < 0.05 THEN 0 ELSE v[9] END, 6) AS ks FROM (
      SELECT vec_id, i, v, least(greatest(v[1], 0), 1) AS x1, least(greatest(v[2], 0), 1) AS y1, least(greatest(v[3], 0), 1) AS x2, least(greatest(v[4], 0), 1) AS y2 FROM (
        SELECT vec_id, i, CAST(embedding[9 * i + 1:9 * i + 9] AS DOUBLE[]) AS v FROM embeddings, (SELECT unnest(range(7)) AS i) r)) WHERE v[5] >= 0.01 AND x2 > x1 AND y2 > y1""")
def _(fx):
    rows = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.transform(F.slice("embedding", i * 9 + 1, F.lit(9)), lambda v: v.cast("double")))
    d = D.decode_fixed_rows(fx.table("embeddings").select("vec_id", rows.alias("rows")), kpts=1, min_score=0.01, min_kpt=0.05)
    d = d.select("vec_id", "row_no", "x1", "y1", "x2", "y2", "score", F.col("keypoints")[0]["x"].alias("kx"), F.col("keypoints")[0]["score"].alias("ks"))
    return rounded(d, "x1", "y1", "x2", "y2", "score", "kx", "ks")


@query("p28_framing_box", """
    WITH t AS (SELECT vec_id // 3 AS frame, e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WHERE vec_id % 3 < 2),
    q AS (SELECT frame, greatest(max(greatest(e[9], e[17])), 0) AS hx, least(min(least(e[9], e[17])), 1) AS lx, greatest(max(greatest(e[10], e[18])), 0) AS hy, least(min(least(e[10], e[18])), 1) AS ly FROM t GROUP BY frame HAVING count(*) = 2),
    s AS (SELECT *, CAST(trunc(greatest((hx - lx) * 640, (hy - ly) * 480)) AS INT) AS side FROM q),
    b AS (SELECT frame, side, CAST(trunc((lx + hx) / 2 * 640 - side / 2.0) AS INT) AS x0, CAST(trunc((ly + hy) / 2 * 480 - side / 2.0) AS INT) AS y0 FROM s)
    SELECT * FROM b WHERE side >= 8 AND least(x0 + side, 640) > greatest(x0, 0) AND least(y0 + side, 480) > greatest(y0, 0)""")
def _(fx):
    h = fx.points.select(F.floor(F.col("vec_id") / 3).alias("frame"), (F.col("vec_id") % 3).alias("hand_no"), F.col("points").alias("keypoints"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return D.framing_box(h, ["frame"]).select("frame", "side", "x0", "y0")


@query("f01_filter_detections", "SELECT det_id FROM $boxes q WHERE conf >= 0.3 AND w / 640.0 * (h / 480.0) >= 0.002")
def _(fx):
    b = fx.boxes.withColumns({"w": F.col("w") / 640.0, "h": F.col("h") / 480.0})
    return L.filter_detections(b, 0.3, 0.002).select("det_id")


@query("f02_filter_first_person", """
    SELECT sample_id FROM $samples s WHERE sample_id NOT IN (SELECT sample_id FROM (SELECT sample_id, max(h) AS mh, min(y1) AS top FROM (
      SELECT sample_id, h, y1, max(h) OVER (PARTITION BY sample_id) AS m FROM $boxes q WHERE cls = 0) WHERE h = m GROUP BY sample_id) WHERE mh / 480.0 > 0.06 AND top / 480.0 < 0.60)""")
def _(fx):
    p = L.tallest_person(fx.boxes.where("cls = 0").select("sample_id", (F.col("y1") / 480.0).alias("y1"), (F.col("h") / 480.0).alias("h")), ["sample_id"])
    return L.filter_first_person(fx.samples.select("sample_id"), p, ["sample_id"], th_h=0.06)


@query("f03_filter_complete_landmarks", "SELECT sample_id, count(*) AS hands FROM $boxes q WHERE k % 5 <> 0 AND k % 3 = 0 GROUP BY sample_id")
def _(fx):
    mark = F.when(F.col("k") % 5 != 0, F.array_repeat(F.array(F.lit(0.5), F.lit(0.5)), F.when(F.col("k") % 3 == 0, 21).otherwise(20)))
    s = fx.boxes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("box_no", F.array("x1", "y1", "w", "h").alias("b"), mark.alias("m")))).alias("z"))
    s = s.select("sample_id", F.transform("z", lambda e: e["b"]).alias("bboxes"), F.transform("z", lambda e: e["m"]).alias("hand_landmarks"))
    return L.filter_complete_landmarks(s).select("sample_id", F.size("hands").cast("long").alias("hands"))


@query("f04_filter_candidates", """
    WITH RECURSIVE b AS MATERIALIZED (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY box_no) - 1 AS n, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (w + h) / 4 AS r FROM $boxes q WHERE cls = 0),
    s(sample_id, n, kept) AS (SELECT DISTINCT sample_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(x DOUBLE, y DOUBLE, r DOUBLE)[]) FROM b
      UNION ALL SELECT s.sample_id, s.n + 1, CASE WHEN b.r >= 7 AND b.r <= 20 AND len(list_filter(s.kept, lambda p: sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) < 3 * 2 * greatest(p.r, b.r))) = 0
        THEN list_append(s.kept, {'x': b.x, 'y': b.y, 'r': greatest(b.r, 8)}) ELSE s.kept END FROM s JOIN b ON b.sample_id = s.sample_id AND b.n = s.n)
    SELECT sample_id, CAST(len(kept) AS INT) AS kept, round(coalesce(list_sum(list_transform(kept, lambda p: p.x)), 0), 6) AS sum_x FROM (SELECT sample_id, arg_max(kept, n) AS kept FROM s GROUP BY sample_id)""")
def _(fx):
    c = L.filter_candidates(fx.scene.where(F.size("balls") > 0), rmin=7, rmax=20, floor=8.0, dedup_d=3.0)
    return rounded(c.select("sample_id", F.size("cands").alias("kept"), F.aggregate("cands", F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x")), "sum_x")


@query("f05_drop_empty_pseudo", """
    SELECT s.sample_id, count(b.det_id) AS n_boxes FROM $samples s LEFT JOIN (SELECT * FROM $boxes q WHERE cls = 1) b USING (sample_id) GROUP BY s.sample_id, s.source HAVING count(b.det_id) > 0 OR s.source = '1-URGENT'""")
def _(fx):
    n = fx.boxes.where("cls = 1").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    s = fx.samples.join(n, "sample_id", "left").withColumns({"n_boxes": F.coalesce("n_boxes", F.lit(0)), "origin": F.when(F.col("source") == "1-URGENT", "hand").otherwise("auto")})
    return L.drop_empty_pseudo(s).select("sample_id", "n_boxes")


@query("f06_background_pool", "SELECT sample_id FROM $samples s WHERE source = '5-LOW' AND sample_id NOT IN (SELECT sample_id FROM $boxes q)")
def _(fx):
    one = fx.boxes.groupBy("sample_id").agg(F.max("det_id").alias("box"))
    return L.background_pool(fx.samples.join(one, "sample_id", "left"), "5-LOW").select("sample_id")
