"""Whitening of embeddings: an exact covariance, its eigenvectors by polar decompositions, and a broadcast projection."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.vectors import longest, scaled, usable
from visorlake.session import settle

COMPONENTS = 32
EPS = float(np.finfo(float).eps)
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Rows of one output batch.
OUT_ROWS = 65_536


# ---------------------------------------------------------------- eigenvectors of one small symmetric matrix
def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps through QR.

    For a symmetric matrix the factor is its matrix sign: +1 on eigenvectors above zero, -1 below.
    """
    n = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(n)
    x = a / scale
    low = max(1 / np.linalg.cond(x, 1) / math.sqrt(n), EPS)
    for _ in range(40):
        squared = low * low
        d = (4 * (1 - squared) / (squared * squared)) ** (1 / 3) if low < 1 else 0.0
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - squared) / (squared * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(n)]))
        step = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        step = (step + step.T) / 2
        moved = np.linalg.norm(step - x)
        x = step
        low = min(1.0, low * (wa + wb * squared) / (1 + wc * squared))
        if moved < 1e-14 * math.sqrt(n) or low > 1 - 1e-15 and moved < 1e-9:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces above and below a shift inside the spectrum; None if there is nothing to part."""
    n = len(a)
    mean = np.trace(a) / n
    shifts = [float(np.median(np.diag(a))), float(mean), float((np.diag(a).max() + np.diag(a).min()) / 2)]
    for shift in shifts:
        sign = polar_factor(a - shift * np.eye(n))
        above = round((np.trace(sign) + n) / 2)
        if not 0 < above < n:
            continue
        # Range and kernel of the projector: one orthogonal basis of it applied to a fixed random block, and a second pass.
        projector = (sign + np.eye(n)) / 2
        block = np.random.default_rng(7).standard_normal((n, n))
        for _ in range(2):
            first, _ = np.linalg.qr(projector @ block[:, :above])
            second, _ = np.linalg.qr((np.eye(n) - projector) @ block[:, above:])
            block = np.hstack([first, second])
        basis, _ = np.linalg.qr(block)
        if np.linalg.norm(basis[:, :above].T @ a @ basis[:, above:]) <= 1e-10 * np.linalg.norm(a):
            return basis[:, :above], basis[:, above:]
    return None


def _pair(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a 2 x 2 matrix by one rotation."""
    angle = 0.5 * math.atan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    c, s = math.cos(angle), math.sin(angle)
    return np.array([[c, -s], [s, c]])


def _divide(a: np.ndarray, scale: float) -> np.ndarray:
    n = len(a)
    off = a - np.diag(np.diag(a))
    if n == 1 or np.linalg.norm(off) <= 4 * EPS * scale:
        return np.eye(n)
    if n == 2:
        return _pair(a)
    parts = _halves(a)
    if parts is None:
        # The spectrum is so narrow that no shift parts it: sweep plane rotations.
        return _rotations(a)
    return np.hstack([part @ _divide(_symmetric(part.T @ a @ part), scale) for part in parts])


def _rotations(a: np.ndarray) -> np.ndarray:
    n, a, v = len(a), a.copy(), np.eye(len(a))
    for _ in range(30):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * np.linalg.norm(a):
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                turn = _pair(a[np.ix_([i, j], [i, j])])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j]] = turn.T @ a[[i, j]]
                v[:, [i, j]] = v[:, [i, j]] @ turn
    return v


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _polished(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One quadratic correction of nearly exact eigenvectors: orthogonality and the off-diagonal rest to first order."""
    r = _symmetric(np.eye(len(a)) - v.T @ v)
    s = _symmetric(v.T @ a @ v)
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    wide = np.abs(gap) > 1e-8 * max(np.abs(e).max(), 1e-300)
    fix = np.where(wide, (s + e[None, :] * r) / np.where(wide, gap, 1.0), r / 2)
    return v + v @ fix


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix from the largest down, and unit eigenvectors as columns.

    Spectral divide and conquer: the polar factor of the matrix shifted into its spectrum gives projectors to the
    spaces above and below the shift; each half is a smaller problem.
    """
    a = _symmetric(np.asarray(a, float))
    if not len(a):
        return np.zeros(0), a
    v = _divide(a, np.linalg.norm(a)) if np.linalg.norm(a) else np.eye(len(a))
    for _ in range(2):
        v = _polished(a, v)
    v /= np.linalg.norm(v, axis=0)
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


# ---------------------------------------------------------------- sums over the table
def _sums(vectors: DataFrame, dims: int, part) -> list:
    """Adds up what `part` (a function of a matrix of rows) gives for every batch: in each task, then in about the square root of as
    many tasks, then here. All parts have the same shape; whole numbers stay whole."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch.column(0))
                total = own if total is None else total + own
        if total is not None:
            yield _cell(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                own = _matrix(cell.as_py())
                total = own if total is None else total + own
        if total is not None:
            yield _cell(total)

    parts = vectors.select("embedding").mapInArrow(gather, "cell binary")
    tasks = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    return [_matrix(r[0]) for r in parts.repartition(tasks).mapInArrow(merge, "cell binary").collect()]


def _cell(m: np.ndarray) -> pa.RecordBatch:
    whole = m.dtype == np.int64
    head = np.array([int(whole), *m.shape], np.int64)
    return pa.RecordBatch.from_arrays([pa.array([head.tobytes() + np.ascontiguousarray(m).tobytes()], pa.binary())], names=["cell"])


def _matrix(cell: bytes) -> np.ndarray:
    whole, rows, cols = np.frombuffer(cell[:24], np.int64)
    return np.frombuffer(cell[24:], np.int64 if whole else float).reshape(rows, cols)


def _exact_total(parts: list[np.ndarray]) -> np.ndarray:
    """Whole-number parts added without overflow, as Python integers."""
    return sum((p.astype(object) for p in parts[1:]), parts[0].astype(object))


def whiten(rows: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector on its leading principal components, one row per vector and component.

    Entries become the whole numbers x = floor(scale * entry) + offset. Sums and centred products are added up as whole numbers
    in the tasks, so the covariance is exact up to one rounding. Its eigenvectors come from polar decompositions (`eigenvectors`); the
    matrix has the width of a vector and is the only thing the driver works on. Rows are then projected where they are.

    Columns: vec_id, component, n, deviation (squared distance from the mean, times n * n), whitened, explained (share of the total
    variance), identity_error (from a further pass over the whitened values).

    Vectors that are null or hold a null or non-finite entry take no part. A null id is passed on; repeated rows count each time.
    Shorter vectors count as filled up with zeros. With no variance along a component (also for one vector, or equal ones) `whitened`
    is null and identity_error covers the others; explained is then 0. A deviation beyond 64 bits is null. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = settle(usable(rows, id, vector))
    n, dims = longest(vectors)
    if not n or not dims:
        return spark.createDataFrame([], ROWS)

    # Sums around zero first, so that they stay small; the offset is added afterwards.
    s0 = _exact_total(_sums(vectors, dims, lambda c: scaled(c, dims, scale).sum(axis=0, keepdims=True)))[0]
    centre = np.array([round(int(s) / n) for s in s0], np.int64)

    def product(column: pa.Array) -> np.ndarray:
        y = scaled(column, dims, scale) - centre
        reach = float(np.abs(y).max(initial=0))
        if reach * reach * len(y) < 2.0 ** 52:
            return np.rint(y.astype(float).T @ y.astype(float)).astype(np.int64)         # sums of whole numbers below 2^53 are exact
        return y.T @ y if reach * reach * n < 2.0 ** 62 else y.astype(float).T @ y.astype(float)

    parts = _sums(vectors, dims, product)
    rest = [int(s) - n * int(c) for s, c in zip(s0, centre, strict=True)]
    if all(p.dtype == np.int64 for p in parts):
        total = _exact_total(parts)
        cov = np.array([[(n * int(total[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    else:
        cov = sum(p.astype(float) for p in parts) / n - np.outer(rest, rest) / float(n) / float(n)
    values, basis = eigenvectors(cov)
    trace, keep = float(np.trace(cov)), min(components, dims)
    flat = values[:keep] <= max(abs(values[0]), 0.0) * dims * EPS * 8
    weights = basis[:, :keep] / np.sqrt(np.where(flat, 1.0, values[:keep]))
    shares = np.where(flat, 0.0, values[:keep] / trace if trace > 0 else 0.0)
    mean_rest = np.array([r / n for r in rest])

    def project(y: np.ndarray) -> np.ndarray:
        return (y - mean_rest) @ weights

    seen = _sums(vectors, dims, lambda c: (lambda w: np.vstack([w.T @ w, w.sum(axis=0)]))(project(scaled(c, dims, scale) - centre)))
    moments = sum(seen[1:], seen[0])
    mean = moments[-1] / n
    error = np.abs(moments[:-1] / n - np.outer(mean, mean) - np.eye(keep))[np.ix_(~flat, ~flat)]
    identity_error = float(error.max(initial=0.0))
    rests = np.array(rest, object)

    def deviations(y: np.ndarray) -> list:
        reach = float(np.abs(y).max(initial=0)) * n + float(max(map(abs, rest)))
        if reach * reach * dims < 2.0 ** 62:
            far = n * y - rests.astype(np.int64)
            return np.einsum("ij,ij->i", far, far).tolist()
        far = n * y.astype(object) - rests
        return [d if d < 1 << 63 else None for d in (far * far).sum(axis=1).tolist()]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, OUT_ROWS // keep)
        names = [c.split()[0] for c in ROWS.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                m = batch.num_rows
                y = scaled(batch.column(1), dims, scale) - centre
                w = project(y)
                each = np.repeat(np.arange(m), keep)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * keep, n, np.int64)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), mask=np.tile(flat, m)),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * keep, identity_error)),
                ], names=names)

    return vectors.select(F.col("vec_id"), F.col("embedding")).mapInArrow(out, ROWS)
