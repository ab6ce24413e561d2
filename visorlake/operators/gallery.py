"""Nearest template search and identity decisions against a fixed gallery."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from visorlake.scale import python_tasks
from visorlake.session import settle

#: Rows of a gallery block at most, and its bytes at most.
SMALL_GALLERY, BLOCK_BYTES = 20_000, 64_000_000
#: Templates that place the centres of the cells, chosen by a hash of their id; centres at most; rounds.
CENTRE_ROWS, CENTRES, ROUNDS = 4_096, 128, 4
#: Passes over the queries that one stage works off before they are settled with their best so far. A pass takes the blocks that fit BLOCK_BYTES together.
BLOCKS_A_STAGE = 4
#: Queries compared with a cell at a time, and the slack of bounds and of sums in another order.
QUERY_ROWS, SLACK = 256, 1e-9


def _unit(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, 1))


def _angle(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def cell_centres(unit: np.ndarray) -> np.ndarray:
    """Unit centres of some templates by a few rounds of spherical k-means; about the square root of their number."""
    k = int(min(CENTRES, max(1, round(len(unit) ** 0.5))))
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)] if len(unit) else np.zeros((0, unit.shape[1]))
    for _ in range(ROUNDS if len(unit) > k else 0):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres[filled] = _unit(sums[filled])
    return centres


@dataclass
class Block:
    """Templates by cell. All of a cell lie between two angles from its centre, which bounds their cosine with a query.

    A template at angle a from the centre and a query at angle b are at least |a - b| apart.
    """
    names: np.ndarray
    unit: np.ndarray
    centres: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, unit: np.ndarray, centres: np.ndarray) -> Block:
        angles = _angle(unit, centres)
        own = angles.argmin(axis=1) if len(unit) else np.zeros(0, int)
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        order = np.lexsort((rank, own))
        used, start = np.unique(own[order], return_index=True)
        near = angles[order, own[order]]
        ends = np.append(start[1:], len(order))
        return cls(names[order], unit[order], centres[used], np.append(start, len(order)), np.array([near[a:b].min() for a, b in zip(start, ends)]),
                   np.array([near[a:b].max() for a, b in zip(start, ends)]))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most a template of each cell can have in common with each query."""
        b = _angle(q, self.centres)
        return np.cos(np.clip(np.maximum(b - self.high, self.low - b), 0.0, np.pi)) + SLACK

    def improve(self, q: np.ndarray, best: np.ndarray, name: np.ndarray, scored: np.ndarray) -> None:
        """Bring the best similarity, its name and the number of scored templates of each query up to date: first each query's most
        promising cell, then every cell that can still hold a better or equal one."""
        if not len(self.names):
            return
        most = self.bounds(q)
        first = most.argmax(axis=1)
        for c in range(len(self.centres)):
            self._cell(c, np.flatnonzero(first == c), q, best, name, scored)
        for c in range(len(self.centres)):
            self._cell(c, np.flatnonzero((first != c) & (most[:, c] >= best)), q, best, name, scored)

    def _cell(self, c: int, rows: np.ndarray, q, best, name, scored) -> None:
        lo, hi = self.start[c], self.start[c + 1]
        for at in range(0, len(rows), QUERY_ROWS):
            some = rows[at:at + QUERY_ROWS]
            sims = q[some] @ self.unit[lo:hi].T
            scored[some] += hi - lo
            i, j = np.nonzero(sims >= np.maximum(sims.max(axis=1), best[some])[:, None] - SLACK)
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", q[some[i]], self.unit[lo + j])       # sums in one order, whatever the block
            order = np.lexsort((j, -exact, i))                                 # names rise inside a cell
            top = order[np.append(True, i[order][1:] != i[order][:-1])]
            for row, value, at_name in zip(some[i[top]].tolist(), exact[top].tolist(), (lo + j[top]).tolist(), strict=True):
                if value > best[row] or (value == best[row] and self.names[at_name] < name[row]):
                    best[row], name[row] = value, self.names[at_name]


def best_match(queries: DataFrame, gallery: DataFrame, id="id", vec="embedding", gallery_id="id", template="template",
               block: int = SMALL_GALLERY, scored: str | None = None) -> DataFrame:
    """Most similar template of each query by cosine (`match_id`, `similarity`); the smaller id wins ties.

    Templates are put into cells around a few centres. A cell is passed over where the triangle inequality on the sphere says that none of
    it can reach a query's best so far, so the answer is that of the full product; `scored` names a column for the number of
    templates that were compared. The gallery goes to the executors in blocks of up to `block` rows and BLOCK_BYTES, one after the
    other, neighbouring cells together and as many blocks at once as fit BLOCK_BYTES; queries stay in their partitions and carry their best along, so they
    are passed over as often as the gallery has BLOCK_BYTES. Rows of query x template never exist.
    """
    kind = gallery.schema[gallery_id].dataType
    shape = T.StructType([queries.schema[id], T.StructField(vec, T.ArrayType(T.DoubleType())), T.StructField("match_id", kind),
                          T.StructField("similarity", T.DoubleType()), T.StructField("_scored", T.LongType())])
    g = gallery.select(F.col(gallery_id).alias("_gid"), F.col(template).cast("array<double>").alias("_t"))
    rows, width = g.agg(F.count(F.lit(1)), F.max(F.size("_t"))).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(width or 1, 1))))
    found = queries.select(F.col(id), F.col(vec).cast("array<double>").alias(vec), F.lit(None).cast(kind).alias("match_id"),
                           F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("long").alias("_scored"))
    if rows > block:
        found = found.repartition(python_tasks(queries))                       # a small file of queries would be one task's work

    def against(sent):
        def run(parts):
            for pdf in parts:
                if not pdf.empty:
                    best, name = pdf["similarity"].fillna(-np.inf).to_numpy(float).copy(), pdf["match_id"].to_numpy(object).copy()
                    count = pdf["_scored"].to_numpy(np.int64).copy()
                    unit = _unit(_stack(pdf[vec]))
                    for part in sent.value:
                        part.improve(unit, best, name, count)
                    pdf = pdf.assign(match_id=name, similarity=np.where(np.isfinite(best), best, np.nan), _scored=count)
                yield pdf
        return run

    for no, parts in enumerate(_blocks(g, rows, block, max(1, BLOCK_BYTES // (8 * max(width or 1, 1))))):
        sent = queries.sparkSession.sparkContext.broadcast(parts)
        found = (settle(found) if no and no % BLOCKS_A_STAGE == 0 else found).mapInPandas(against(sent), shape)
    out = found.where("match_id IS NOT NULL").select(id, "match_id", "similarity", *([F.col("_scored").alias(scored)] if scored else []))
    return out


def _blocks(g: DataFrame, rows: int, block: int, most: int):
    """The gallery in lists of blocks, `most` rows a list. A larger one is dealt by cell: neighbouring cells share a block, a cell beyond a block has several."""
    if rows <= block:
        whole = g.toPandas()
        if len(whole):
            unit = _unit(_stack(whole["_t"]))
            order = np.argsort(whole["_gid"].to_numpy(), kind="stable")
            yield [Block.of(whole["_gid"].to_numpy()[order], unit[order], cell_centres(unit[order][:: max(1, len(unit) // CENTRE_ROWS)]))]
        return
    chosen = g.orderBy(F.xxhash64("_gid"), "_gid").limit(CENTRE_ROWS).toPandas()
    centres = cell_centres(_unit(_stack(chosen["_t"])))
    # Cells in an order in which neighbours are close: by their place along the two main directions of the centres.
    axes = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][:2]
    place = np.argsort(np.arctan2(*(centres @ axes.T).T[::-1]) if len(axes) > 1 else np.arange(len(centres)), kind="stable")
    centres = centres[place]
    schema = T.StructType([*g.schema.fields, T.StructField("_c", T.IntegerType())])

    def own_cell(parts):
        for pdf in parts:
            yield pdf.assign(_c=_angle(_unit(_stack(pdf["_t"])), centres).argmin(axis=1) if len(pdf) else 0)

    celled = settle(g.mapInPandas(own_cell, schema))
    sizes = {r["_c"]: r["count"] for r in celled.groupBy("_c").count().collect()}           # at most CENTRES
    group, held = [], 0
    plan: list[tuple[list[int], int, int, int]] = []                                         # (cells, parts, part, rows at most or so)
    for c in sorted(sizes):
        if sizes[c] > block:
            parts = -(-sizes[c] // block)
            plan += [([c], parts, p, block) for p in range(parts)]
            continue
        if held + sizes[c] > block:
            plan.append((group, 1, 0, held))
            group, held = [], 0
        group, held = [*group, c], held + sizes[c]
    if group:
        plan.append((group, 1, 0, held))
    while plan:
        upto = max(1, int(np.searchsorted(np.cumsum([n for *_, n in plan]), most, "right")))
        now, plan = plan[:upto], plan[upto:]
        wanted = g.sparkSession.createDataFrame([(c, parts, p, no) for no, (cells, parts, p, _) in enumerate(now) for c in cells], "_c int, _parts int, _p int, _b int")
        some = (celled.join(F.broadcast(wanted), "_c").where(F.pmod(F.xxhash64("_gid"), F.col("_parts")) == F.col("_p"))
                .select("_gid", "_t", "_b").toPandas())                                      # about `most` rows
        blocks = [Block.of(rows["_gid"].to_numpy(), _unit(_stack(rows["_t"])), centres[sorted(now[no][0])]) for no, rows in some.groupby("_b")]
        if blocks:
            yield blocks


def identify_faces(queries: DataFrame, gallery: DataFrame, recognise: float = 0.30, enrol: float = 0.25, id="id",
                   known: str | None = None, **kw) -> DataFrame:
    """Decision per face against a fixed gallery: reinforce, enrol, or keep in the grey zone.

    `known` names a boolean column of `queries`: a face whose track already has an identity never enrols.
    """
    best = best_match(queries, gallery, id=id, **kw)
    out = queries.join(best, id, "left").withColumn("similarity", F.coalesce("similarity", F.lit(-1.0)))
    new = (F.col("similarity") < enrol) & (~F.col(known) if known else F.lit(True))
    return out.withColumn("decision", F.when(F.col("similarity") >= recognise, "reinforce").when(new, "enrol").otherwise("keep"))
