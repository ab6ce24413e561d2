"""Building blocks that keep work spread out when one key holds a large share of the rows.

A window or a grouped function puts a whole key into one task. The helpers here cut a key along its
order column instead, so that each task sees a bounded slice:

* `positions` and `running_sum`: ranks and prefix sums from slice-local windows plus slice offsets;
* `with_halo`: slices plus the neighbouring rows a bounded look-back or look-ahead needs;
* `ordered_scan`: order-dependent folds, run slice by slice in parallel and checked at the seams;
* `maybe_broadcast`: a broadcast hint only after counting the rows.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from visorlake.session import settle

BROADCAST_ROWS = 200_000
GROUP_ROWS = 1_000_000
FRAME_SPAN = 50_000
MAX_ROUNDS = 6


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when `df` has at most `rows` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def seeded(*cols: Column | str, seed: int = 0) -> Column:
    """Deterministic pseudo-random order of rows."""
    return F.xxhash64(*cols, F.lit(seed))


def hash_slice(h: Column) -> Column:
    """65,536 ordered slices of a 64-bit hash."""
    return F.shiftright(h, 48)


def span_of(at: Column | str, span: int = FRAME_SPAN) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(at / F.lit(span)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, on=keys, how=how)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], slice_by: Column,
                value: Column, name: str, before: bool = False) -> DataFrame:
    """Prefix sum of `value` in each group. `slice_by` must rise with `order`.

    Only slice totals cross the slices; the rows themselves are windowed inside (keys, slice).
    """
    ks = [*keys, "_slice"]
    cut = df.withColumn("_slice", slice_by).withColumn("_val", value)
    totals = cut.groupBy(*ks).agg(F.sum("_val").alias("_tot"))
    head = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*ks, F.coalesce(F.sum("_tot").over(head), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*ks).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    local = cut.withColumn("_part", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    return (_same(local, starts, ks)
            .withColumn(name, F.col("_part") + F.col("_start"))
            .drop("_slice", "_val", "_part", "_start"))


def positions(df: DataFrame, keys: list[str], order: list[Column], slice_by: Column,
              name: str = "pos", upto: int | None = None) -> DataFrame:
    """1-based position of each row in its group, in `order`, at any group size.

    With `upto`, slices that start beyond that position are dropped before any row is ranked.
    """
    ks = [*keys, "_slice"]
    cut = df.withColumn("_slice", slice_by)
    totals = cut.groupBy(*ks).agg(F.count(F.lit(1)).alias("_tot"))
    head = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*ks, F.coalesce(F.sum("_tot").over(head), F.lit(0)).alias("_start"))
    rows = _same(cut, starts if upto is None else starts.where(F.col("_start") < upto), ks)
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*ks).orderBy(*order)))
    out = ranked.withColumn(name, (F.col("_rn") + F.col("_start")).cast("long")).drop("_slice", "_rn", "_start")
    return out if upto is None else out.where(F.col(name) <= upto)


def with_halo(df: DataFrame, at: str, back: float = 0, ahead: float = 0,
              span: int = FRAME_SPAN) -> DataFrame:
    """Copy each row into every span whose rows may look at it; `_own` marks the home copy.

    A row is looked at by rows up to `back` later or `ahead` earlier. Windows then run over
    (keys, `_span`) and the caller keeps the `_own` rows.
    """
    home = span_of(at, span)
    spans = F.sequence(span_of(F.col(at) - F.lit(ahead), span), span_of(F.col(at) + F.lit(back), span))
    return df.withColumn("_span", F.explode(spans)).withColumn("_own", F.col("_span") == home)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], share: int = 1_000) -> DataFrame:
    """Left join of `rows` with `table` (one row per key), where some keys may hold a large part of the rows.

    Keys with more than 1 / `share` of all rows are at most `share`, so their lines of the table are broadcast; no task
    gathers the rows of one. All other keys are joined by shuffling. Settle `rows` first if they are costly: they are read twice.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = max(share, rows.count() // share)
    hot = counts.where(F.col("_n") > most).select(*keys, F.lit(True).alias("_hot"))
    few = F.broadcast(table.join(F.broadcast(hot), keys))
    met = rows.join(few, keys, "left")
    rest = met.where(F.col("_hot").isNull()).select(*rows.columns).join(table, keys, "left")
    return met.where(F.col("_hot").isNotNull()).drop("_hot").select(*rest.columns).unionByName(rest)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  name: str = "_rn") -> DataFrame:
    """First `n` rows per group. Spark cuts each map task to `n` rows per key before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept.drop(name) if name == "_rn" else kept


def whole_units(parts: Iterator[pd.DataFrame], unit: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows in pieces that end where `unit` changes: the last rows of a batch wait for the rest of their unit."""
    held: list[pd.DataFrame] = []
    for pdf in parts:
        if pdf.empty:
            continue
        tail = np.ones(len(pdf), bool)
        for c in unit:
            tail &= pdf[c].to_numpy() == pdf[c].iloc[-1]
        cut = len(pdf) - int(tail.sum())
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True) if held else pdf.iloc[:cut]
            held = []
        elif held and any(held[-1][c].iloc[-1] != pdf[c].iloc[0] for c in unit):
            yield pd.concat(held, ignore_index=True)
            held = []
        if cut < len(pdf):
            held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _in_order(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: T.StructType) -> DataFrame:
    """Fold every group as its sorted rows stream through a task.

    Rows are hashed by key and sorted by (key, order) inside each partition, so the Arrow batches arrive in
    order and only a batch and one state are in memory, whatever the size of a group. Rows of one group that are equal in the
    first column of `order` (the boxes of a frame) reach the fold together.
    """
    cols = schema.fieldNames()

    def run(parts):
        now, state = None, None
        for pdf in whole_units(parts, [*keys, order[0]]):
            marks = [pdf[k].to_numpy() for k in keys]
            change = np.zeros(len(pdf), bool)
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            out = []
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(m[lo] for m in marks)
                if key != now:
                    now, state = key, None
                rows, state = fold(key, state, pdf.iloc[lo:hi])
                if len(rows):
                    out.append(rows)
            if out:
                yield pd.concat(out, ignore_index=True)[cols]

    return df.repartition(python_tasks(df), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def python_tasks(df: DataFrame) -> int:
    """Partitions of a Python stage. A given number keeps adaptive execution from merging them by bytes,
    which say little about the cost of Python rows; `spark.sql.shuffle.partitions` sets it."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hot_groups(df: DataFrame, keys: list[str], rows: int = GROUP_ROWS) -> DataFrame:
    """Keys with more than `rows` rows; at most (rows of df) / rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*keys)


def ordered_scan(df: DataFrame, keys: list[str], at: str, order: list[str], fold: Callable,
                 schema: T.StructType, span: int = FRAME_SPAN, warmup: int = 0,
                 group_rows: int = GROUP_ROWS, forgets: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """Fold each group in order, where the result for a row depends on everything before it.

    `fold(key, state, rows)` returns `(output rows, new state)`; `state` is a JSON-able value and None at the
    start; a group may reach it in several pieces, cut where the first column of `order` changes. Groups up to `group_rows` are folded as they stream
    through a task. Larger ones are cut into spans of `at`: every span is first folded from a blank state over
    the last `warmup` units of its predecessor, and a span whose entry state differs from the state its
    predecessor really ended with is folded again from that state, until no span differs. The result is the
    sequential one. Groups that still differ after a few rounds, and folds that never forget
    (`forgets=False`), stream through one task per group with a batch and a state in memory. `counted` has the keys
    of `df` and as many rows of each, if that is cheaper to count.
    """
    if not forgets:
        return _in_order(df, keys, order, fold, schema)
    hot = hot_groups(df if counted is None else counted, keys, group_rows)
    if hot.isEmpty():
        return _in_order(df, keys, order, fold, schema)
    hot = settle(hot)
    calm = _in_order(df.join(hot, keys, "left_anti").select(*df.columns), keys, order, fold, schema)
    big = df.join(hot, keys, "left_semi")
    return calm.unionByName(_scan_spans(big, keys, at, order, fold, schema, span, warmup))


def python_values(column: pa.Array) -> list:
    """`column.to_pylist()`, which takes microseconds for every list, in a fraction of the time for numbers and lists of numbers."""
    if column.null_count == len(column):
        return [None] * len(column)
    kind = column.type.value_type if pa.types.is_list(column.type) else column.type
    inner = column.values if pa.types.is_list(column.type) else column
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind)) or inner.null_count:
        return column.to_pylist()
    flat = inner.to_numpy().tolist()
    if inner is column:
        return flat
    ends = column.offsets.to_numpy().tolist()
    lists = [flat[lo:hi] for lo, hi in zip(ends, ends[1:])]
    return lists if not column.null_count else [v if ok else None for v, ok in zip(lists, column.is_valid().to_pylist(), strict=True)]


def ordered_steps(df: DataFrame, keys: list[str], at: str, needs: list[str], step: Callable, added: T.StructType, span: int = FRAME_SPAN,
                  warmup: int = 0, group_rows: int = GROUP_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """`ordered_scan` for folds that give a row for each row: adds the columns `added`, all others pass through untouched.

    `step(state, *values)` gets the columns `needs` of one row and returns `(values of added, state)`. Groups up to `group_rows` stay Arrow batches,
    of which only `needs` become Python values; larger ones are cut into spans as in `ordered_scan`. `sizes` has the keys of `df` and their rows as `_n`, if
    they are at hand. A group holds each value of `at` once.
    """
    names, shape = df.columns, T.StructType([*df.schema.fields, *added.fields])
    types = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            marks = zip(*(python_values(b.column(k)) for k in keys), strict=True)
            for key, values in zip(marks, zip(*(python_values(b.column(c)) for c in needs), strict=True), strict=True):
                if key != now:
                    now, state = key, None
                row, state = step(state, *values)
                out.append(row)
            if out:
                more = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], shape.fieldNames())

    def fold(key, state, part: pd.DataFrame):
        out = []
        plain = ([v.tolist() if isinstance(v, np.ndarray) else v for v in part[c].tolist()] for c in needs)
        for values in zip(*plain, strict=True):
            row, state = step(state, *values)
            out.append(row)
        more = pd.DataFrame(out, columns=added.fieldNames(), index=part.index, dtype=object)
        return pd.concat([part[names], more], axis=1), state

    def streamed(rows: DataFrame) -> DataFrame:
        return rows.repartition(python_tasks(rows), *keys).sortWithinPartitions(*keys, at).mapInArrow(run, shape)

    hot = hot_groups(df, keys, group_rows) if sizes is None else sizes.where(F.col("_n") > group_rows).select(*keys)
    if hot.isEmpty():
        return streamed(df)
    hot = settle(hot)
    calm = streamed(df.join(hot, keys, "left_anti").select(*names))
    return calm.unionByName(_scan_spans(df.join(hot, keys, "left_semi"), keys, at, [at], fold, shape, span, warmup))


def _scan_spans(df, keys, at, order, fold, schema, span, warmup):
    cols = schema.fieldNames()
    wide = T.StructType(
        [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField("_span", T.LongType()), T.StructField("_in", T.StringType()),
           T.StructField("_out", T.StringType()), T.StructField("_is_state", T.BooleanType())]
        + [T.StructField(f.name, f.dataType) for f in schema.fields])
    kcols = [f"_k{i}" for i in range(len(keys))]

    def packed(spans):
        """The output rows of some spans in one frame, and in another a row for each span with its entry and end state."""
        full = [(*key, span_no, out) for key, span_no, _, out, _ in spans if len(out)]
        if full:
            *marks, outs = zip(*full)
            sizes = [len(out) for out in outs]
            named = {c: [v for v, n in zip(m, sizes) for _ in range(n)] for c, m in zip([*kcols, "_span"], marks)}
            yield pd.concat(outs, ignore_index=True)[cols].assign(**named, _in=None, _out=None, _is_state=False)[wide.fieldNames()]
        marks = [(*key, span_no, entry, json.dumps(state, sort_keys=True), True, *[None] * len(cols)) for key, span_no, entry, _, state in spans]
        yield pd.DataFrame(marks, columns=wide.fieldNames(), dtype=object)

    def guess(parts):
        for pdf in whole_units(parts, [*keys, "_span"]):
            marks = [pdf[k].to_numpy() for k in (*keys, "_span")]
            change = np.zeros(len(pdf), bool)
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            starts, home = [0, *np.flatnonzero(change).tolist(), len(pdf)], pdf["_own"].to_numpy()
            done = []
            for lo, hi in zip(starts, starts[1:]):
                own = lo + int(np.count_nonzero(~home[lo:hi]))                 # rows of earlier spans come first
                if own == hi:
                    continue
                key, span_no = tuple(m[lo] for m in marks[:-1]), marks[-1][lo]
                state = fold(key, None, pdf.iloc[lo:own])[1] if own > lo else None
                entry = json.dumps(state, sort_keys=True)
                done.append((key, span_no, entry, *fold(key, state, pdf.iloc[own:hi])))
            if done:
                yield from packed(done)

    def redo(key, rows, entry):
        *k, span_no = key
        if rows.empty or entry.empty:
            return pd.DataFrame(columns=wide.fieldNames())
        text = entry["_entry"].iloc[0]
        out, end = fold(tuple(k), json.loads(text), rows.sort_values(order, kind="stable"))
        return pd.concat([f.astype(object) for f in packed([(k, span_no, text, out, end)])], ignore_index=True)

    tasks = python_tasks(df)
    done = settle(with_halo(df, at, back=warmup, span=span).repartition(tasks, *keys, "_span")
                  .sortWithinPartitions(*keys, "_span", *order).mapInPandas(guess, wide))
    rows = df.withColumn("_span", span_of(at, span))
    named = {c: k for c, k in zip(kcols, keys)}
    for _ in range(MAX_ROUNDS):
        states = done.where("_is_state").select(*kcols, "_span", "_in", "_out")
        before = F.lag("_out").over(W.partitionBy(*kcols).orderBy("_span"))
        stale = (states.withColumn("_entry", F.coalesce(before, F.lit("null")))
                 .where(~F.col("_entry").eqNullSafe(F.col("_in")))
                 .select(*kcols, "_span", "_entry"))
        stale = settle(stale)
        if stale.isEmpty():
            return done.where(~F.col("_is_state")).select(*cols)
        entry = stale.withColumnsRenamed(named)
        again = (rows.join(entry.drop("_entry"), [*keys, "_span"], "left_semi").repartition(tasks, *keys, "_span")
                 .groupBy(*keys, "_span").cogroup(entry.repartition(tasks, *keys, "_span").groupBy(*keys, "_span"))
                 .applyInPandas(redo, wide))
        done = settle(done.join(stale.drop("_entry"), [*kcols, "_span"], "left_anti")
                      .unionByName(again))
    # These groups carry their state too far for spans to help; walk them from the start instead.
    stubborn = stale.select(*kcols).distinct()
    slow = df.join(stubborn.withColumnsRenamed(named), keys, "left_semi").select(*df.columns)
    settled = done.join(stubborn, kcols, "left_anti").where(~F.col("_is_state")).select(*cols)
    return settled.unionByName(_in_order(slow, keys, order, fold, schema))
