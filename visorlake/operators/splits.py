"""Whole-entity splits and integer apportionment."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from visorlake.scale import ordered_scan, positions, running_sum, seeded


def allocate_largest_remainder(groups: DataFrame, total: int, group="group", size="size") -> DataFrame:
    """Spread an integer total over groups by size; leftovers go to the largest remainders."""
    whole = groups.agg(F.sum(size)).first()[0] or 1
    raw = F.lit(total) * F.col(size) / F.lit(whole)
    base = groups.withColumn("_raw", raw).withColumns({"_base": F.floor("_raw"), "_rest": F.col("_raw") - F.floor("_raw")})
    left = total - (base.agg(F.sum("_base")).first()[0] or 0)
    ranked = positions(base, [], [F.desc("_rest"), F.col(group)], F.floor((1 - F.col("_rest")) * 4096), "_pos")
    return (ranked.withColumn("share", F.col("_base") + (F.col("_pos") <= left).cast("long"))
            .drop("_raw", "_base", "_rest", "_pos"))


def split_by_entity(people: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, pins: dict[str, str] | None = None,
                    val_people: int = 0, test_people: int = 0, entity="entity", stratum="domains", weight="weight",
                    seed: int = 0, tie: str | None = None) -> DataFrame:
    """Assign whole people to train, val or test: columns `entity`, `split`.

    Pinned people first. The rest, per stratum and heaviest first, go to the evaluation split furthest
    below its weight target (val on ties) while it is below it and below its optional head count, else
    to train. `tie` replaces the seeded order of equal weights.

    A split is filled beyond its target by one person at most, and until both are full everybody goes to one of them. So a person before whom
    more weight stands than both targets and the heaviest person have together goes to train, as does one before whom both head counts
    are used up: prefix sums decide that. Only the people before are walked in order of rank.
    """
    pins = pins or {}
    pinned = F.create_map(*[F.lit(v) for kv in pins.items() for v in kv]) if pins else None
    fixed = pinned[F.col(entity).cast("string")] if pins else F.lit(None).cast("string")
    marked = people.withColumn("_pin", fixed)
    free = marked.where("_pin IS NULL").drop("_pin").withColumn("_tie", F.col(tie) if tie else seeded(entity, seed=seed))
    totals = free.groupBy(stratum).agg(F.sum(weight).alias("_w"), F.max(weight).alias("_top"), F.count(F.lit(1)).alias("_n"))
    for name, cap in (("val", val_people), ("test", test_people)):
        if cap:
            room = max(0, cap - sum(1 for s in pins.values() if s == name))
            totals = allocate_largest_remainder(totals, room, stratum, "_n").withColumnRenamed("share", f"_cap_{name}")
        else:
            totals = totals.withColumn(f"_cap_{name}", F.lit(None).cast("long"))
    order, slices = [F.desc(weight), F.col("_tie")], -F.floor(F.log1p(F.col(weight)) * 64)
    ranked = running_sum(positions(free, [stratum], order, slices, "_pos"), [stratum], order, slices, F.col(weight), "_before", before=True)
    out = T.StructType([T.StructField(entity, people.schema[entity].dataType), T.StructField("split", T.StringType())])

    def fold(key, state, rows: pd.DataFrame):
        got = dict(state) if state else {"val": 0.0, "test": 0.0, "n_val": 0, "n_test": 0}
        sides = []
        for w, whole, cv, ct in zip(rows[weight], rows["_w"], rows["_cap_val"], rows["_cap_test"]):
            lack = {"val": whole * val_frac - got["val"], "test": whole * test_frac - got["test"]}
            open_ = [s for s, cap in (("val", cv), ("test", ct))
                     if lack[s] > 0 and (pd.isna(cap) or got[f"n_{s}"] < cap)]
            side = max(open_, key=lack.get) if open_ else "train"
            if open_:
                got[side] += float(w)
                got[f"n_{side}"] += 1
            sides.append(side)
        return pd.DataFrame({entity: rows[entity].to_numpy(), "split": sides}), got

    known = ranked.join(totals, stratum).select(
        entity, F.col(stratum).alias("_stratum"), weight, "_w", "_cap_val", "_cap_test", "_pos",
        ((F.col("_before") >= (val_frac + test_frac) * F.col("_w") * (1 + 1e-9) + F.col("_top")) | F.coalesce(F.col("_pos") > F.col("_cap_val") + F.col("_cap_test"), F.lit(False))).alias("_late"))
    walk = known.where("NOT _late").drop("_late")
    placed = (ordered_scan(walk, ["_stratum"], "_pos", ["_pos"], fold, out, forgets=False)
              .unionByName(known.where("_late").select(entity, F.lit("train").alias("split"))))
    return placed.unionByName(marked.where("_pin IS NOT NULL").select(entity, F.col("_pin").alias("split")))
