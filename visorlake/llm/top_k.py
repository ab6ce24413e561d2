"""Exact top-k by inner product: an impact-ordered index that is read score at a time."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visorlake.llm.vectors import longest, scaled, usable
from visorlake.session import settle

#: Vectors of one index block, queries sent out at once, step of the quantised entries.
BLOCK = 16_384
QUERY_BLOCK = 20_000
STEP = 32
#: With so few possible members left, they are scored exactly; looked at after every so many segments.
FEW = 256
LOOK = 24
FOUND = "query_uid long, query_id long, vec_id long, uid long, score long"
HITS = "query_id long, rank int, vec_id long, score long"


class ImpactIndex:
    """Postings of a block of vectors. Every dimension lists all rows by falling entry, cut into segments of equal quantised entry.

    For a query, a segment's impact is the most that one of its postings adds to a score. Segments of all dimensions are
    taken by falling impact. A row that has met `seen` of its postings can still gain no more than the next impact for each
    of the others, so rows whose sum and gain stay below the k-th best known score are out for good.
    """

    def __init__(self, vectors: np.ndarray, step: int = STEP):
        n, dims = vectors.shape
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable").T
        values = np.take_along_axis(vectors.T, order, 1)
        level = values // step
        cut = np.ones((dims, n), bool)
        cut[:, 1:] = level[:, 1:] != level[:, :-1]
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], dims * n)
        self.dim = self.start // n
        self.rows, self.values = np.ascontiguousarray(order).ravel(), np.ascontiguousarray(values, float).ravel()
        self.least, self.most = self.values[self.start].astype(np.int64), self.values[self.end - 1].astype(np.int64)
        self.bits = int(dims).bit_length()
        self.reach = int(np.abs(vectors).max(initial=0))

    def fits(self, q: np.ndarray) -> bool:
        """Whether a sum and a count fit one double as whole numbers."""
        return self.reach * int(np.abs(q).max(initial=0)) * max(len(q), 1) << self.bits < 1 << 51

    def members(self, q: np.ndarray, k: int, known: int | None, own: int) -> np.ndarray:
        """Rows that may be among the best k, a superset without a gap. `known`: a score that k other rows reach; `own`: a row that is left out."""
        n, dims = self.vectors.shape
        weight = q[self.dim]
        impact = np.where(weight >= 0, weight * self.most, weight * self.least)
        order = np.argsort(-impact, kind="stable")
        falling = impact[order]
        total, shift = np.zeros(n), 1 << self.bits
        steps = zip(self.start[order].tolist(), self.end[order].tolist(), (weight[order] * float(shift)).tolist(), strict=True)
        rows, values, mask, looked = self.rows, self.values, shift - 1, 0
        for i, (a, b, w) in enumerate(steps, 1):
            np.add.at(total, rows[a:b], values[a:b] * w + 1)                   # the low bits count the postings met
            if i % LOOK == 0 and i < len(falling) and 3 * i >= len(falling):
                so_far = total.astype(np.int64)
                if known is None or looked % 4 == 0:
                    known = self._better(so_far, q, k, known, own)
                looked += 1
                if known is not None:
                    gain = (dims - (so_far & mask)) * falling[i]
                    left = np.flatnonzero((so_far >> self.bits) + gain >= known)
                    if len(left) <= FEW:
                        return left
        if known is None:
            return np.arange(n)
        return np.flatnonzero((total.astype(np.int64) >> self.bits) >= known)

    def _better(self, total: np.ndarray, q: np.ndarray, k: int, known: int | None, own: int) -> int | None:
        """The k-th best exact score among the rows that lead so far, if it is better than `known`."""
        lead = min(4 * k + 1, len(total))
        rows = np.argpartition(-total, lead - 1)[:lead]
        scores = np.sort(self.vectors[rows[rows != own]] @ q)[::-1]
        if len(scores) < k:
            return known
        return int(scores[k - 1]) if known is None else max(known, int(scores[k - 1]))


def _best(k: int, *found: tuple) -> tuple:
    """The first k of (score, vec_id, uid) by falling score, then id, then row."""
    score, vec, uid = (np.concatenate(c) for c in zip(*found, strict=True))
    first = np.lexsort((uid, vec, -score))[:k]
    return score[first], vec[first], uid[first]


def _plain(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores whose sums may leave 64 bits on the way, held at the ends of their range."""
    return np.array([min(max(x, -(1 << 63) + 1), (1 << 63) - 1) for x in (vectors.astype(object) @ q.astype(object)).tolist()], np.int64)


def search_block(vectors: np.ndarray, vec: np.ndarray, uid: np.ndarray, queries: np.ndarray, query_uid: np.ndarray, k: int, best: list) -> None:
    """Bring `best`, the first k so far of each query, up to date with a block."""
    index = ImpactIndex(vectors)
    place = {u: i for i, u in enumerate(uid.tolist())}
    for i, q in enumerate(queries):
        own, held = place.get(int(query_uid[i]), -1), best[i]
        if not index.fits(q):
            rows = np.arange(len(vectors))
            scores = _plain(vectors, q)
        else:
            known = int(held[0][-1]) if held is not None and len(held[0]) == k else None
            rows = index.members(q, k, known, own)
            scores = vectors[rows] @ q
        if own >= 0:
            other = rows != own
            rows, scores = rows[other], scores[other]
        if len(rows):
            new = (scores, vec[rows], uid[rows])
            best[i] = _best(k, new) if held is None else _best(k, held, new)


def exact_top_k(rows: DataFrame, queries: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product for every row that meets `queries` (a condition on vec_id), among all other rows.

    Entries count as floor(scale * entry), scores are whole numbers, ties go to the smaller id. Rows are dealt evenly to the tasks,
    which index them in blocks; queries come to them in groups of bounded size, as a broadcast. Each task returns its best k a
    query, and the best of those are kept. A search ends when what is left cannot change the answer; the possible members are then
    scored exactly, so nothing is approximate.

    Columns: query_id, rank from 1, vec_id, score. Rows with a null id, or a vector that is null or holds a null or non-finite entry, take
    no part. Repeated ids are rows of their own: each is searched for, and finds the others. Shorter vectors count as filled up with
    zeros. With fewer than k other rows all are returned. An empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = settle(usable(rows, id, vector).where(F.col("vec_id").isNotNull()).withColumn("uid", F.monotonically_increasing_id()))
    n, dims = longest(vectors)
    asked = vectors.where(queries)
    groups = -(-asked.count() // QUERY_BLOCK)
    if not groups or not dims:
        return spark.createDataFrame([], HITS)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    dealt = vectors.repartition(tasks, "uid")
    found = None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g).toArrow()
        sent = spark.sparkContext.broadcast((_matrix(part["embedding"], dims, scale), part["uid"].to_numpy(), part["vec_id"].to_numpy()))
        one = dealt.mapInArrow(_searcher(sent, dims, scale, k), FOUND)
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), np.int64)
    return np.vstack([scaled(c, dims, scale) for c in column.chunks if len(c)])


def _searcher(sent, dims: int, scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_uid, query_id = sent.value
        best: list = [None] * len(queries)
        held: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                held.append((scaled(piece.column(1), dims, scale), piece.column(0).to_numpy(), piece.column(2).to_numpy()))
                if sum(len(h[1]) for h in held) >= BLOCK:
                    search_block(*(np.concatenate(c) for c in zip(*held, strict=True)), queries, query_uid, k, best)
                    held.clear()
        if held:
            search_block(*(np.concatenate(c) for c in zip(*held, strict=True)), queries, query_uid, k, best)
        hits = [(i, b) for i, b in enumerate(best) if b is not None]
        if not hits:
            return
        each = np.repeat([i for i, _ in hits], [len(b[0]) for _, b in hits])
        score, vec, uid = (np.concatenate([b[c] for _, b in hits]) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_uid[each], query_id[each], vec, uid, score)], names=[c.split()[0] for c in FOUND.split(", ")])
    return run


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
