"""Image measures over decoded pixels of the `image` source, as Arrow-batched functions."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Decoded BGR(A) or grey bytes as a height x width x 3 array in BGR order."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, :3]


def grey(px: np.ndarray) -> np.ndarray:
    """BT.601 luma, rounded."""
    return np.rint(px @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resize(px: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resize to a square, pixel centres aligned."""
    def axis(n):
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    r0, r1, fr = axis(px.shape[0])
    c0, c1, fc = axis(px.shape[1])
    shape = (-1, 1) + (1,) * (px.ndim - 2)
    rows = px[r0] * (1 - fr).reshape(shape) + px[r1] * fr.reshape(shape)
    fc = fc.reshape((1, -1) + (1,) * (px.ndim - 2))
    return np.rint(rows[:, c0] * (1 - fc) + rows[:, c1] * fc)


def _dct_basis(n: int = 32, keep: int = 8) -> np.ndarray:
    k, i = np.arange(keep)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def phash_one(px: np.ndarray) -> int:
    basis = _dct_basis()
    low = (basis @ resize(grey(px), 32) @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">i8")[0])


def hue_sat(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue in [0, 180) and saturation in [0, 255] of BGR pixels."""
    b, g, r = (px[..., i].astype(float) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.where(top > low, top - low, 1.0)
    hue = np.select([top == r, top == g], [60 * (g - b) / span, 120 + 60 * (b - r) / span],
                    240 + 60 * (r - g) / span)
    hue = np.rint(np.where(top > low, hue % 360, 0) / 2) % 180
    sat = np.rint(np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0))
    return hue, sat


def descriptor_one(px: np.ndarray) -> np.ndarray:
    g = resize(grey(px), 16).ravel() / 255.0
    hue, _ = hue_sat(resize(px, 64))
    hist = np.histogram(hue, bins=12, range=(0, 180))[0].astype(float)
    v = np.concatenate([g, hist / (hist.sum() + 1e-6)])
    return v / (np.linalg.norm(v) + 1e-6)


def green_one(px: np.ndarray) -> float:
    hue, sat = hue_sat(resize(px, 64))
    return float(((hue > 30) & (hue < 90) & (sat > 60)).mean())


def sharpness_one(px: np.ndarray) -> float:
    b, g, r = (px[..., i].astype(int) for i in range(3))
    y = (r * 77 + g * 150 + b * 29) >> 8
    if min(y.shape) < 3:
        return 0.0
    lap = 4 * y[1:-1, 1:-1] - y[1:-1, :-2] - y[1:-1, 2:] - y[:-2, 1:-1] - y[2:, 1:-1]
    return float(lap.var())


def thumb_one(px: np.ndarray) -> np.ndarray:
    return resize(px, 64).astype(np.int32).ravel()


def _over_images(fn, kind: T.DataType, many: bool = False):
    """`fn` on each image of an Arrow batch, whose bytes are not copied; numbers, or with `many` vectors of one length, are written into one array."""
    @F.arrow_udf(T.ArrayType(kind) if many else kind)
    def run(img: pa.Array) -> pa.Array:
        high, wide, deep, data = (img.field(n) for n in ("height", "width", "nChannels", "data"))
        out = None
        for i, (h, w, c) in enumerate(zip(high.to_pylist(), wide.to_pylist(), deep.to_pylist(), strict=True)):
            v = np.asarray(fn(to_array(h, w, c, data[i].as_buffer())))
            out = np.empty((len(img), *v.shape), v.dtype) if out is None else out
            out[i] = v
        own = pa.float64() if isinstance(kind, T.DoubleType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()
        if out is None:
            return pa.array([], pa.list_(own) if many else own)
        values = pa.array(out.ravel()).cast(own)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], values) if many else values
    return run


def phash(image="image") -> Column:
    """64-bit perceptual hash: low 8x8 band of the 32x32 cosine transform against its median."""
    return _over_images(phash_one, T.LongType())(image)


def appearance_descriptor(image="image") -> Column:
    """16x16 grey plus a 12-bin hue histogram, unit length."""
    return _over_images(descriptor_one, T.DoubleType(), many=True)(image)


def green_fraction(image="image") -> Column:
    """Share of pixels with hue between 30 and 90 and saturation above 60."""
    return _over_images(green_one, T.DoubleType())(image)


def sharpness(image="image") -> Column:
    """Variance of the 4-neighbour Laplacian of integer luma."""
    return _over_images(sharpness_one, T.DoubleType())(image)


def thumbnail(image="image") -> Column:
    """64x64 colour thumbnail, for the mean-difference dedup."""
    return _over_images(thumb_one, T.IntegerType(), many=True)(image)
