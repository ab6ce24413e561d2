"""Vector maths, landmark distances and 64-bit hashes."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

LANDMARKS = 21
WRIST, MIDDLE_MCP = 0, 9


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda v: v.cast("double") / (n + eps))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v * v))


def hamming(a, b) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def pack_bits(bits) -> Column:
    """64 booleans to a BIGINT, first bit highest."""
    return F.aggregate(_c(bits), F.lit(0).cast("long"),
                       lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def median_bits(coeffs) -> Column:
    """One bit per coefficient: above the median of all but the first."""
    coeffs = _c(coeffs)
    rest = F.array_sort(F.slice(coeffs, 2, 63))
    return F.transform(coeffs, lambda v: v > rest[31])


def byte_sum(h) -> Column:
    """Sum of the eight bytes of a hash."""
    return sum((F.shiftrightunsigned(_c(h), 8 * i).bitwiseAND(F.lit(255).cast("long"))
                for i in range(1, 8)), _c(h).bitwiseAND(F.lit(255).cast("long")))


def pairwise_distance_features(points, n: int = LANDMARKS) -> Column:
    """Distances of all point pairs over the wrist to middle-knuckle distance."""
    points = _c(points)

    def gap(p, q):
        return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))

    scale = gap(points[WRIST], points[MIDDLE_MCP]) + 1e-6
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.transform(
        F.sequence(i + 1, F.lit(n - 1)), lambda j: gap(F.get(points, i), F.get(points, j)) / scale))
    return F.flatten(each)
