"""Counts and summaries of datasets, annotators and footage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visorlake.functions.names import display_name
from visorlake.scale import positions, running_sum
from visorlake.sources.tables import AnnotationTables


def _pct(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def boxes_per_sample(boxes: DataFrame, classes: list[int], key="sample_id") -> DataFrame:
    return boxes.groupBy(key).agg(F.count(F.lit(1)).alias("n_boxes"),
                                  *[F.count_if(F.col("cls") == c).alias(f"cls_{c}") for c in classes])


def dataset_stats(samples: DataFrame, boxes: DataFrame, classes: list[int], split="split") -> DataFrame:
    """Images, background images and boxes per class for each split, and the grand total."""
    per = samples.select("sample_id", split).join(boxes_per_sample(boxes, classes), "sample_id", "left")
    return per.rollup(split).agg(
        F.grouping(split).cast("int").alias("is_total"), F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("n_boxes").isNull()).alias("background"),
        *[F.coalesce(F.sum(f"cls_{c}"), F.lit(0)).alias(f"boxes_{c}") for c in classes])


def conversion_report(rows: DataFrame) -> DataFrame:
    """Totals of a conversion. `rows`: sample_id, has_image, valid (null for a placeholder row)."""
    per = rows.groupBy("sample_id").agg(F.bool_and("has_image").alias("img"), F.count_if("valid").alias("ok"),
                                        F.count_if(~F.col("valid")).alias("bad"))
    img = F.col("img")
    return per.agg(F.count_if(img).alias("images"), F.coalesce(F.sum(F.when(img, F.col("ok"))), F.lit(0)).alias("boxes"),
                   F.coalesce(F.sum(F.when(img, F.col("bad"))), F.lit(0)).alias("dropped"),
                   F.count_if(~img).alias("missing"), F.count_if(img & (F.col("ok") == 0)).alias("empty"))


def label_stats(samples: DataFrame, boxes: DataFrame, classes: list[int]) -> DataFrame:
    """Frames with a box of each class, with any box and with none; counts and percent."""
    per = samples.select("sample_id").join(boxes_per_sample(boxes, classes), "sample_id", "left")
    out = per.agg(F.count(F.lit(1)).alias("frames"), *[F.count_if(F.col(f"cls_{c}") > 0).alias(f"with_{c}") for c in classes],
                  F.count_if(F.col("n_boxes") > 0).alias("with_any"), F.count_if(F.col("n_boxes").isNull()).alias("empty"),
                  F.coalesce(F.sum("n_boxes"), F.lit(0)).alias("boxes"))
    names = [f"with_{c}" for c in classes] + ["with_any", "empty"]
    return out.withColumns({f"pct_{n}": _pct(F.col(n), F.col("frames")) for n in names})


def _live(t: AnnotationTables) -> DataFrame:
    return t.annotations.where(F.col("was_cancelled") == 0)


def annotator_leaderboard(t: AnnotationTables, project_ids: list[int] | None = None) -> DataFrame:
    """Live annotations by project and user, largest first. Counted before the name join."""
    live = _live(t)
    if project_ids:
        live = live.where(F.col("project_id").isin(project_ids))
    counts = live.groupBy("project_id", F.col("completed_by_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    users = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name", "email")
    named = counts.join(users, "user_id", "left")
    return (named.select("project_id", "user_id", display_name("first_name", "last_name", "email", "user_id").alias("name"), "n")
            .orderBy(F.desc("n"), "project_id", "user_id"))


def project_progress(t: AnnotationTables) -> DataFrame:
    """Tasks and tasks with a live annotation per project, in one grouped query for all projects."""
    total = t.tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    done = _live(t).groupBy("project_id").agg(F.countDistinct("task_id").alias("done"))
    base = (t.projects.select(F.col("id").alias("project_id"), "title") if t.projects is not None
            else total.select("project_id", F.lit(None).cast("string").alias("title")))
    out = base.join(total, "project_id", "left").join(done, "project_id", "left")
    return out.select("project_id", F.coalesce("title", F.concat(F.lit("project "), F.col("project_id").cast("string"))).alias("title"),
                      F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("done", F.lit(0)).alias("done"))


def active_annotators(t: AnnotationTables, now: Column, window_secs: int = 60) -> DataFrame:
    """Distinct users with a live annotation in the last seconds; null when annotations carry no time."""
    users = F.countDistinct(F.when(F.col("_at") >= now - F.make_dt_interval(secs=F.lit(window_secs)), F.col("completed_by_id")))
    return _live(t).agg((users if t.has_time else F.lit(None).cast("long")).alias("active"))


def overlap_distribution(t: AnnotationTables) -> DataFrame:
    """Per project: how many tasks have k annotations, and the share with at least two."""
    per_task = _live(t).groupBy("project_id", "task_id").agg(F.count(F.lit(1)).alias("annotations"))
    hist = per_task.groupBy("project_id", "annotations").agg(F.count(F.lit(1)).alias("tasks"))
    w = W.partitionBy("project_id")
    multi = F.sum(F.when(F.col("annotations") >= 2, F.col("tasks")).otherwise(0)).over(w)
    return hist.withColumn("pct_multi", _pct(multi, F.sum("tasks").over(w)))


def leaderboard_totals(t: AnnotationTables) -> DataFrame:
    """Counts per project and user and over all projects, with consecutive ranks and percent done."""
    board = annotator_leaderboard(t)
    rolled = (board.groupBy("project_id", "user_id").agg(F.sum("n").alias("n")).withColumn("all_projects", F.lit(0))
              .unionByName(board.groupBy("user_id").agg(F.sum("n").alias("n"))
                           .select(F.lit(None).cast("long").alias("project_id"), "user_id", "n", F.lit(1).alias("all_projects"))))
    prog = project_progress(t)
    pct = (prog.select("project_id", "total", "done")
           .unionByName(prog.agg(F.lit(None).cast("long").alias("project_id"), F.sum("total").alias("total"), F.sum("done").alias("done"))))
    keyed = rolled.withColumn("_p", F.coalesce("project_id", F.lit(0)))
    ranked = positions(keyed, ["all_projects", "_p"], [F.desc("n"), F.col("user_id")], -F.floor(F.log1p("n") * 64), "rank").withColumn("rank", F.col("rank").cast("int")).drop("_p")
    return (ranked.alias("r").join(pct.alias("p"), F.col("r.project_id").eqNullSafe(F.col("p.project_id")), "left")
            .select("r.project_id", "r.user_id", "r.n", "r.all_projects", "r.rank",
                    F.when(F.col("p.total") > 0, F.lit(100.0) * F.col("p.done") / F.col("p.total")).otherwise(0.0).alias("pct_done")))


def tally(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts per equal bin of [0, 1], labelled in percent."""
    width = 100 // bins
    low = F.floor(F.col(value) * bins).cast("int") * width
    return df.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.col("low").cast("string"), F.lit("-"), (F.col("low") + width).cast("string"), F.lit("%")).alias("bin"), "n")


def median_kept(df: DataFrame, group="video_id") -> DataFrame:
    """Median number of rows per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("median"))


def upper_median(df: DataFrame, keys: list[str], value: str, step: float = 1.0) -> DataFrame:
    """Element n div 2 of the sorted values per group, found by counting up over the distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sum(counts, keys, [F.col(value)], F.floor(F.col(value) / step), F.col("_c"), "_cum")
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    return (ranked.join(total, keys).where(F.col("_cum") > F.floor(F.col("_n") / 2))
            .groupBy(*keys).agg(F.min(value).alias("upper_median")))


def footage_by_person(clips: DataFrame, minutes: str | None = "minutes") -> DataFrame:
    """Domains, clips, megabytes and minutes of each person."""
    aggs = [F.array_join(F.array_sort(F.collect_set("domain")), "+").alias("domains"),
            F.count(F.lit(1)).alias("videos"), (F.sum("length") / 1e6).alias("size_mb")]
    if minutes:
        aggs.append(F.sum(minutes).alias("minutes"))
    return clips.groupBy("person").agg(*aggs)


def footage_by_split(people: DataFrame, weight="minutes", domains: tuple[str, ...] = ("Indoor", "Outdoor")) -> DataFrame:
    """People, clips and weight per split, share of the whole, and weight by domain."""
    per = people.groupBy("split").agg(
        F.count(F.lit(1)).alias("people"), F.sum("videos").alias("videos"), F.sum(weight).alias("weight"),
        *[F.coalesce(F.sum(F.when(F.array_contains(F.split("domains", r"\+"), d), F.col(weight))), F.lit(0)).alias(d.lower()) for d in domains])
    return per.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy(F.lit(1))))


def class_weights(df: DataFrame, label="label", classes: tuple[int, int] = (0, 1)) -> DataFrame:
    """n / (2 max(count, 1)) per class and the negatives over positives."""
    neg, pos = classes
    c = df.agg(F.count_if(F.col(label) == neg).alias("n_neg"), F.count_if(F.col(label) == pos).alias("n_pos"))
    n = F.col("n_neg") + F.col("n_pos")
    return c.withColumns({"w_neg": n / (2 * F.greatest("n_neg", F.lit(1))), "w_pos": n / (2 * F.greatest("n_pos", F.lit(1))),
                          "pos_weight": F.col("n_neg") / F.greatest("n_pos", F.lit(1))})


def frames_with_class(dets: DataFrame, cls: int, keys: tuple[str, ...] = ("video_id", "frame_idx"), model="model") -> DataFrame:
    """Frames in which each model found the class."""
    hits = dets.where(F.col("cls") == cls).select(model, *keys).distinct()
    return dets.select(model).distinct().join(hits.groupBy(model).agg(F.count(F.lit(1)).alias("n")), model, "left").select(
        model, F.coalesce("n", F.lit(0)).alias("frames"))


def run_totals(stats: DataFrame, cols: tuple[str, ...] = ("frames", "t1", "t2", "labels", "fp_dropped")) -> DataFrame:
    """Totals over per-video results; failed videos have nulls and count as zero."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
