"""Box, keypoint and camera geometry as column expressions and table transforms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the tool formats.
CROP_PAD = 1.3

COORDS = ["x1", "y1", "x2", "y2"]


def values_of(rows, field: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda r: r[field])


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def clip(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(c, lo), hi)


def box_from_xywh_norm(df: DataFrame, x="x", y="y", w="w", h="h") -> DataFrame:
    """Normalised top-left boxes to centre form; boxes without area are dropped."""
    x, y, w, h = (F.col(c) for c in (x, y, w, h))
    return (df.withColumns({"cx": clip01(x + w / 2), "cy": clip01(y + h / 2),
                            "bw": clip01(w), "bh": clip01(h)})
            .where((F.col("bw") > 0) & (F.col("bh") > 0)))


def box_from_xywh_px(df: DataFrame, x="x1", y="y1", w="w", h="h",
                     width="width", height="height") -> DataFrame:
    """Pixel top-left boxes clipped to the image and normalised; degenerate ones dropped."""
    x, y, w, h, W, H = (F.col(c).cast("double") for c in (x, y, w, h, width, height))
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    pw = F.least(x + w, W) - left
    ph = F.least(y + h, H) - top
    return (df.withColumns({"cx": (left + pw / 2) / W, "cy": (top + ph / 2) / H,
                            "bw": pw / W, "bh": ph / H})
            .where((pw > 0) & (ph > 0)))


def box_xyxy_to_center(df: DataFrame, width="width", height="height") -> DataFrame:
    """Corner boxes clamped to the last pixel, in centre form; null when nothing is left."""
    W, H = F.col(width).cast("double"), F.col(height).cast("double")
    x1, x2 = clip(F.col("x1"), 0.0, W - 1), clip(F.col("x2"), 0.0, W - 1)
    y1, y2 = clip(F.col("y1"), 0.0, H - 1), clip(F.col("y2"), 0.0, H - 1)
    ok = (x2 > x1) & (y2 > y1)
    return df.withColumns({"cx": F.when(ok, (x1 + x2) / 2 / W), "cy": F.when(ok, (y1 + y2) / 2 / H),
                           "bw": F.when(ok, (x2 - x1) / W), "bh": F.when(ok, (y2 - y1) / H)})


def box_center_to_xyxy(df: DataFrame, width="width", height="height",
                       cx="cx", cy="cy", w="bw", h="bh") -> DataFrame:
    W, H = F.col(width), F.col(height)
    cx, cy, w, h = (F.col(c) for c in (cx, cy, w, h))
    return df.withColumns({"x1": (cx - w / 2) * W, "y1": (cy - h / 2) * H,
                           "x2": (cx + w / 2) * W, "y2": (cy + h / 2) * H})


def polygon_to_box(df: DataFrame, points="points") -> DataFrame:
    """Axis-aligned envelope of a list of {x, y} points."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return df.withColumns({"x1": F.array_min(xs), "y1": F.array_min(ys),
                           "x2": F.array_max(xs), "y2": F.array_max(ys)})


def remap_classes(df: DataFrame, mapping: dict[int, int], cls="cls",
                  strip: list[int] | None = None) -> DataFrame:
    """Replace class ids; ids outside the mapping, or in `strip`, are dropped."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    out = df.withColumn(cls, table[F.col(cls)]).where(F.col(cls).isNotNull())
    return out.where(~F.col(cls).isin(strip)) if strip else out


def keypoints_reshape(flat: Column | str, n: int) -> Column:
    """Flat x, y, v triples to an array of {x, y, v}; v > 0 means visible."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(F.get(flat, i * 3).cast("double").alias("x"),
                           F.get(flat, i * 3 + 1).cast("double").alias("y"),
                           (F.get(flat, i * 3 + 2) > 0).cast("int").alias("v")))


def keypoints_flip(kps: Column | str, order: list[int]) -> Column:
    """Mirror x and swap left and right points by `order`."""
    kps = F.col(kps) if isinstance(kps, str) else kps
    return F.transform(
        F.array(*[F.lit(i) for i in order]),
        lambda i: F.struct((F.lit(1.0) - F.get(kps, i)["x"]).alias("x"),
                           F.get(kps, i)["y"].alias("y"), F.get(kps, i)["v"].alias("v")))


def project_points(df: DataFrame, k="k", xyz="xyz", pad: float = 0.20) -> DataFrame:
    """Pinhole projection of camera-space joints, with the padded square box around them.

    Samples with a point at depth zero, or not finite, are dropped.
    """
    K = F.col(k)

    def row(p, r):
        return sum((F.get(F.get(K, F.lit(r)), F.lit(c)) * F.get(p, F.lit(c)) for c in range(1, 3)),
                   F.get(F.get(K, F.lit(r)), F.lit(0)) * F.get(p, F.lit(0)))

    pts = F.transform(xyz, lambda p: F.struct((row(p, 0) / F.nullif(row(p, 2), F.lit(0.0))).alias("x"),
                                              (row(p, 1) / F.nullif(row(p, 2), F.lit(0.0))).alias("y")))
    bad = F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"])
                   | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    out = polygon_to_box(df.withColumn("points", pts).where(~bad))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (1 + 2 * pad)
    return (out.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2,
                             "cy": (F.col("y1") + F.col("y2")) / 2, "side": side})
            .drop("x1", "y1", "x2", "y2"))


def square_crop(cx, cy, w, h, pad: float = CROP_PAD, floor: float = 0.0) -> tuple[Column, Column, Column]:
    """Left, top and side of the padded square around a box in pixels."""
    side = F.greatest(w, h, F.lit(floor)) * pad
    return cx - side / 2, cy - side / 2, side


def crop_keypoints(kps, x0: Column, y0: Column, side: Column, width: Column, height: Column) -> Column:
    """Image-normalised points to crop coordinates."""
    return F.transform(kps, lambda p: F.struct(((p["x"] * width - x0) / side).alias("x"),
                                               ((p["y"] * height - y0) / side).alias("y")))


def uncrop_keypoints(kps, x0: Column, y0: Column, side: Column, width: Column, height: Column) -> Column:
    """Crop coordinates back to image-normalised points."""
    return F.transform(kps, lambda p: F.struct(((x0 + p["x"] * side) / width).alias("x"),
                                               ((y0 + p["y"] * side) / height).alias("y")))


def fit_similarity(src, dst) -> Column:
    """Least-squares rotation, scale and shift between two point lists: {a, b, tx, ty} or null."""
    src = F.col(src) if isinstance(src, str) else src
    dst = F.col(dst) if isinstance(dst, str) else dst
    zero = F.lit(0.0)

    def mean(pts, f):
        return F.aggregate(pts, zero, lambda acc, p: acc + p[f]) / F.size(pts)

    mx, my, nx, ny = mean(src, "x"), mean(src, "y"), mean(dst, "x"), mean(dst, "y")
    pairs = F.zip_with(src, dst, lambda p, q: F.struct(
        (p["x"] - mx).alias("px"), (p["y"] - my).alias("py"),
        (q["x"] - nx).alias("qx"), (q["y"] - ny).alias("qy")))

    def total(f):
        return F.aggregate(pairs, zero, lambda acc, t: acc + f(t))

    den = total(lambda t: t["px"] * t["px"] + t["py"] * t["py"])
    a = total(lambda t: t["qx"] * t["px"] + t["qy"] * t["py"]) / den
    b = total(lambda t: t["qy"] * t["px"] - t["qx"] * t["py"]) / den
    return F.when(den >= 1e-6, F.struct(a.alias("a"), b.alias("b"),
                                        (nx - (a * mx - b * my)).alias("tx"),
                                        (ny - (b * mx + a * my)).alias("ty")))


def affine_apply(m, x: Column, y: Column) -> tuple[Column, Column]:
    """Apply [a, b, tx, c, d, ty]; a null matrix leaves the point where it is."""
    m = F.col(m) if isinstance(m, str) else m
    return (F.coalesce(m[0] * x + m[1] * y + m[2], x), F.coalesce(m[3] * x + m[4] * y + m[5], y))


def affine_compose(first, then) -> Column:
    """One matrix that does `first` and after it `then`; null counts as identity."""
    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    p, q = F.coalesce(first, one), F.coalesce(then, one)
    return F.array(q[0] * p[0] + q[1] * p[3], q[0] * p[1] + q[1] * p[4], q[0] * p[2] + q[1] * p[5] + q[2],
                   q[3] * p[0] + q[4] * p[3], q[3] * p[1] + q[4] * p[4], q[3] * p[2] + q[4] * p[5] + q[5])


def letterbox_plan(width: Column, height: Column, size: int) -> tuple[Column, Column, Column]:
    """Scale and left/top padding that fit an image into a square."""
    r = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    dx = F.floor((F.lit(size) - F.bround(width * r, 0)) / 2)
    dy = F.floor((F.lit(size) - F.bround(height * r, 0)) / 2)
    return r, dx, dy


def letterbox(df: DataFrame, size: int = 640, width="width", height="height") -> DataFrame:
    """Pixel corners to [0, 1] of the padded square."""
    r, dx, dy = letterbox_plan(F.col(width), F.col(height), size)
    return df.withColumns({"x1": (F.col("x1") * r + dx) / size, "y1": (F.col("y1") * r + dy) / size,
                           "x2": (F.col("x2") * r + dx) / size, "y2": (F.col("y2") * r + dy) / size})


def unletterbox(df: DataFrame, size: int = 640, width="width", height="height") -> DataFrame:
    """[0, 1] of the padded square back to pixel corners."""
    r, dx, dy = letterbox_plan(F.col(width), F.col(height), size)
    return df.withColumns({"x1": (F.col("x1") * size - dx) / r, "y1": (F.col("y1") * size - dy) / r,
                           "x2": (F.col("x2") * size - dx) / r, "y2": (F.col("y2") * size - dy) / r})


def box_to_percent(df: DataFrame, cx="cx", cy="cy", w="bw", h="bh") -> DataFrame:
    """Centre form to top-left percent, each value clamped to [0, 100]."""
    cx, cy, w, h = (F.col(c) for c in (cx, cy, w, h))
    return df.withColumns({"px": clip((cx - w / 2) * 100, 0.0, 100.0),
                           "py": clip((cy - h / 2) * 100, 0.0, 100.0),
                           "pw": clip(w * 100, 0.0, 100.0), "ph": clip(h * 100, 0.0, 100.0)})


def box_from_percent(df: DataFrame, x="px", y="py", w="pw", h="ph") -> DataFrame:
    x, y, w, h = (F.col(c) for c in (x, y, w, h))
    return df.withColumns({"cx": (x + w / 2) / 100, "cy": (y + h / 2) / 100,
                           "bw": w / 100, "bh": h / 100})


def area(b) -> Column:
    return (b("x2") - b("x1")) * (b("y2") - b("y1"))


def of(prefix: str = ""):
    """Accessor for corner columns that share a prefix."""
    return lambda name: F.col(f"{prefix}{name}")


def iou(a, b) -> Column:
    """Overlap ratio of two corner boxes; 0 when the union has no area."""
    iw = F.greatest(F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1")), F.lit(0.0))
    ih = F.greatest(F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1")), F.lit(0.0))
    inter = iw * ih
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def center_distance(a, b, diameter: Column) -> Column:
    """Distance of two box centres, in diameters."""
    dx = (a("x1") + a("x2")) / 2 - (b("x1") + b("x2")) / 2
    dy = (a("y1") + a("y2")) / 2 - (b("y1") + b("y2")) / 2
    return hypot(dx, dy) / diameter


def face_fraction(df: DataFrame, width="width", height="height") -> DataFrame:
    """Shorter box side over shorter image side; 0 without a box."""
    frac = (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
            / F.least(F.col(width), F.col(height)))
    return df.withColumn("face_fraction", F.coalesce(frac, F.lit(0.0)))


def face_quality_ok(score: Column, b, min_score=0.6, min_side=0.07, margin=0.015) -> Column:
    """Confident, large enough and away from the left and right border (normalised corners)."""
    side = F.least(b("x2") - b("x1"), b("y2") - b("y1"))
    return (score >= min_score) & (side >= min_side) & (b("x1") > margin) & (b("x2") < 1.0 - margin)


def frontal_ok(kps, width: Column, height: Column, max_yaw=0.55) -> Column:
    """Nose roughly between the eyes. Points: left eye, right eye, nose, ..."""
    kps = F.col(kps) if isinstance(kps, str) else kps
    lx, rx, nx = kps[0]["x"] * width, kps[1]["x"] * width, kps[2]["x"] * width
    eyes = hypot(rx - lx, kps[1]["y"] * height - kps[0]["y"] * height)
    return (F.size(kps) >= 5) & (eyes >= 1.0) & (F.abs(nx - (lx + rx) / 2) / eyes <= max_yaw)


def uncertainty_score(df: DataFrame, dets="dets", green="green") -> DataFrame:
    """Review priority of a frame and its reasons, from its {cls, conf} detections and greenness.

    Classes: 0 ball, 1 club head, 2 hole.
    """
    def count(cond):
        return F.size(F.filter(dets, cond))

    ball, club = count(lambda d: d["cls"] == 0), count(lambda d: d["cls"] == 1)
    hole = F.coalesce(F.array_max(F.transform(F.filter(dets, lambda d: d["cls"] == 2),
                                              lambda d: d["conf"])), F.lit(0.0))
    mid = count(lambda d: d["cls"].isin(0, 1) & (d["conf"] >= 0.20) & (d["conf"] < 0.50))
    green = F.col(green) > 0.45
    signals = [
        ((club > 0) & (ball == 0), F.lit(3.0), F.lit("club_no_ball")),
        (green & (ball == 0) & (club == 0) & (hole == 0), F.lit(1.5), F.lit("green_no_det")),
        (mid > 0, mid * 0.6, F.concat(F.lit("midconf"), mid.cast("string"))),
        (hole > 0, F.when(hole >= 0.5, 2.0).otherwise(1.2), F.lit("hole_seen")),
        ((hole <= 0) & green & ((ball > 0) | (club > 0)), F.lit(1.0), F.lit("putt_no_hole")),
    ]
    score = sum((F.when(c, v).otherwise(F.lit(0.0)) for c, v, _ in signals), F.lit(0.0))
    why = F.concat_ws("+", *[F.when(c, name) for c, _, name in signals])
    return df.withColumns({"score": score, "reason": F.coalesce(F.nullif(why, F.lit("")),
                                                                F.lit("diverse"))})
