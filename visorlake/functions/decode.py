"""Raw model outputs to boxes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from visorlake.functions.boxes import clip01
from visorlake.scale import top_per_group

THUMB_TIP, INDEX_TIP = 4, 8


def decode_grid_head(df: DataFrame, heads="heads", size: int = 640, min_score: float = 0.5) -> DataFrame:
    """Grid heads `[level][row][col][l, t, r, b, logits...]` to normalised corner boxes.

    The logit cut is taken before the exponential, so cells below it cost one comparison.
    """
    levels = df.withColumn("_grid", F.explode(heads)).drop(heads)
    rows = levels.select("*", F.posexplode("_grid").alias("_row_no", "_row"))
    cells = rows.select("*", F.posexplode("_row").alias("_col_no", "_cell"))
    logits = F.slice("_cell", F.lit(5), F.greatest(F.size("_cell") - 4, F.lit(0)))
    scored = cells.withColumn("_top", F.array_max(logits))
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.least(F.col("_top"), F.lit(30.0)), F.lit(-30.0))))
    step = F.lit(1.0) / F.size("_grid")
    ax, ay = F.col("_col_no") + 0.5, F.col("_row_no") + 0.5
    cell = F.col("_cell")
    out = scored.withColumns({
        "cls": (F.array_position(logits, F.col("_top")) - 1).cast("int"), "score": score,
        "x1": clip01((ax - cell[0]) * step), "y1": clip01((ay - cell[1]) * step),
        "x2": clip01((ax + cell[2]) * step), "y2": clip01((ay + cell[3]) * step)})
    out = out.where((F.col("score") > min_score) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return out.drop("_grid", "_row_no", "_row", "_col_no", "_cell", "_top")


def decode_fixed_rows(df: DataFrame, rows="rows", kpts: int = 0, min_score: float = 0.5,
                      min_kpt: float = 0.3, classes: int | None = None) -> DataFrame:
    """Rows `[x1, y1, x2, y2, score, class, (x, y, score) * kpts]` to boxes and keypoints."""
    r = F.col("_r")
    top = F.lit(classes - 1) if classes else F.lit(2**31 - 1)
    out = (df.select("*", F.posexplode(rows).alias("row_no", "_r")).drop(rows)
           .withColumns({"x1": clip01(r[0].cast("double")), "y1": clip01(r[1].cast("double")),
                         "x2": clip01(r[2].cast("double")), "y2": clip01(r[3].cast("double")),
                         "score": r[4].cast("double"),
                         "cls": F.greatest(F.least(r[5].cast("int"), top), F.lit(0))})
           .where((F.col("score") >= min_score) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))))
    if kpts:
        ks = F.transform(F.sequence(F.lit(0), F.lit(kpts - 1)), lambda k: F.struct(
            F.get(r, k * 3 + 6).cast("double").alias("x"), F.get(r, k * 3 + 7).cast("double").alias("y"),
            F.when(F.get(r, k * 3 + 8) < min_kpt, 0.0).otherwise(F.get(r, k * 3 + 8).cast("double"))
            .alias("score")))
        out = out.withColumn("keypoints", ks)
    return out.drop("_r")


def framing_box(df: DataFrame, keys: list[str], order="hand_no", kps="keypoints",
                width="width", height="height") -> DataFrame:
    """First two gesture hands of a frame: thumb and index tips span a square crop.

    The two hands come from ordered minima, so a frame never gathers all its hands.
    """
    tips = df.select(*keys, order, width, height,
                     F.array(F.col(kps)[THUMB_TIP], F.col(kps)[INDEX_TIP]).alias("_tips"))
    two = top_per_group(tips, keys, [F.col(order)], 2)
    quad = (two.groupBy(*keys, width, height)
            .agg(F.flatten(F.collect_list("_tips")).alias("_pts"))
            .where(F.size("_pts") >= 4))
    xs, ys = F.transform("_pts", lambda p: p["x"]), F.transform("_pts", lambda p: p["y"])
    W, H = F.col(width), F.col(height)
    lox, hix = F.least(F.array_min(xs), F.lit(1.0)), F.greatest(F.array_max(xs), F.lit(0.0))
    loy, hiy = F.least(F.array_min(ys), F.lit(1.0)), F.greatest(F.array_max(ys), F.lit(0.0))
    side = F.greatest((hix - lox) * W, (hiy - loy) * H).cast("int")
    x0 = ((lox + hix) / 2 * W - side / 2.0).cast("int")
    y0 = ((loy + hiy) / 2 * H - side / 2.0).cast("int")
    return (quad.withColumns({"x0": x0, "y0": y0, "side": side}).drop("_pts")
            .where((F.col("side") >= 8) & (F.least(F.col("x0") + F.col("side"), W) > F.greatest(F.col("x0"), F.lit(0)))
                   & (F.least(F.col("y0") + F.col("side"), H) > F.greatest(F.col("y0"), F.lit(0)))))
