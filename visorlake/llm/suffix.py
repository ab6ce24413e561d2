"""Removal of byte strings that occur more than once, by buckets of sparse suffixes that are refined in rounds.

This is not bucket-pointer refinement: no bucket number of a later offset is sorted on or used again. See the README for the reason.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visorlake.llm import spans
from visorlake.llm.spans import Entries, mix

WINDOW = 200
#: Suffixes start at the least Q-gram of a window, so two equal windows have theirs at the same offset.
Q = 16
#: Offsets are told apart in steps of SIDE at first and of STEP after the first refinement.
SIDE, STEP = 93, 12
#: Bytes that are hashed at a time.
SEGMENT = 3_000_000
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
POSITIVE, REFINE = 1, 2


@cache
def _tables(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of the base and of its inverse."""
    base, n = BASES[which], SEGMENT + 2 * WINDOW
    values = np.random.default_rng(17 + which).integers(1, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    power = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    return values, power(base), power(pow(base, -1, 2 ** 64))


class Strings:
    """Hashes of any strings of a segment from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        values, power, self.inverse = _tables(which)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[:len(data)])])

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((self.sums[z] - self.sums[a]) * self.inverse[a])


def anchors(strings: Strings, n: int) -> np.ndarray:
    """For each window start of a segment of n bytes, the leftmost position of its least Q-gram."""
    width, grams = WINDOW - Q + 1, n - Q + 1
    at = np.arange(grams)
    value = (strings.of(at, at + Q) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    rows = -(-grams // width)
    padded = np.full(rows * width, np.uint64(2 ** 64 - 1))
    padded[:grams] = value
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - WINDOW + 1)
    return (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _layout(chunk: spans.Chunk) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(b) for b in chunk.body], np.int64)
    return np.cumsum(size) - size, size


def _ranges(chunk: spans.Chunk, flag: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start, in the chunk, of the marks that carry `flag`."""
    first, _ = _layout(chunk)
    lo = [first[d] + m["at"][m["code"] & flag > 0].astype(np.int64) for d, m in enumerate(chunk.marks)]
    more = [(m["code"][m["code"] & flag > 0] >> 2).astype(np.int64) for m in chunk.marks]
    lo, more = np.concatenate(lo), np.concatenate(more)
    return lo, lo + more


def _segments(chunk: spans.Chunk, wanted: tuple[np.ndarray, np.ndarray] | None):
    """Segments of the chunk's bytes: offset, bytes, which window starts count (all whole ones, or the wanted ones)."""
    first, size = _layout(chunk)
    data = np.frombuffer(b"".join(chunk.body), np.uint8)
    edge = np.zeros(len(data) + 1, np.int32)
    if wanted is None:
        fits = size >= WINDOW
        np.add.at(edge, first[fits], 1)
        np.add.at(edge, first[fits] + size[fits] - WINDOW + 1, -1)
    else:
        np.add.at(edge, wanted[0], 1)
        np.add.at(edge, wanted[1] + 1, -1)
    use = np.cumsum(edge)[:-1] > 0
    for s in range(0, len(data), SEGMENT):
        part = data[s:s + SEGMENT + WINDOW - 1]
        ok = use[s:s + len(part) - WINDOW + 1] if len(part) >= WINDOW else use[:0]
        if ok.any():
            yield s, part, ok


def ask_buckets(batches: Iterator[pa.RecordBatch], buckets: int, step: int, wanted: int) -> Iterator[pa.RecordBatch]:
    """Entries of runs of windows with one anchor and one class of offsets (anchor - start) // step.

    key: the bucket, a hash of the bytes all windows of the class share; more: a hash of all bytes the run touches.
    """
    for chunk in spans.chunks(batches):
        first, _ = _layout(chunk)
        found = []
        for s, data, ok in _segments(chunk, _ranges(chunk, wanted) if wanted else None):
            strings = Strings(data)
            anchor = anchors(strings, len(data))
            start = np.flatnonzero(ok)
            kind = (anchor[start] - start) // step
            doc = np.searchsorted(first, start + s, "right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(anchor[start]) != 0) | (np.diff(kind) != 0) | (np.diff(start) != 1) | (np.diff(doc) != 0)
            head = np.flatnonzero(new)
            lo, hi = start[head], start[np.append(head[1:], len(start)) - 1]
            p, c = anchor[lo], kind[head]
            last = np.maximum(p - (c + 1) * step + 1, p - WINDOW + Q)          # the earliest start of the class
            shared = strings.of(p - c * step, last + WINDOW)
            whole = strings.of(lo, hi + WINDOW)
            key = mix(shared + c.astype(np.uint64) * spans.GOLDEN)
            more = mix(whole ^ ((p - lo).astype(np.uint64) * np.uint64(256) + (hi - lo).astype(np.uint64)) * spans.GOLDEN)
            d = doc[head]
            k, part = np.array(chunk.k, np.int64), np.array(chunk.part, np.uint32)
            found.append(Entries(key, more, k[d], part[d], (lo + s - first[d]).astype(np.uint32), ((hi - lo) << 2).astype(np.uint16)))
        if found:
            yield from _send(spans.join(found), buckets)


def _send(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """At most two entries per bucket and chunk: copies within the chunk are positive at once, a bucket that is
    mixed within the chunk is refined whatever the others hold."""
    e = e.take(np.lexsort((e.more, e.key)))
    same, bucket = spans.runs(e.key, e.more), spans.runs(e.key)
    head = np.flatnonzero(np.diff(same, prepend=-1))
    count = np.bincount(same)
    copies = np.setdiff1d(np.flatnonzero(count[same] > 1), head)
    known = e.take(copies)
    known.code = known.code | np.uint16(POSITIVE)
    one = e.take(head)
    one.code = one.code | np.where(count > 1, POSITIVE, 0).astype(np.uint16)
    group = bucket[head]
    edge = np.concatenate([np.diff(group, prepend=-1) > 0, [True]])
    outer = edge[:-1] | edge[1:]
    mixed = np.bincount(group)[group] > 1
    inner = one.take(mixed)
    inner.code = inner.code | np.uint16(REFINE)
    return spans.packed(one.take(outer), spans.join([known, inner]), buckets)


def refine(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Within a bucket: equal runs are positive; if there are different ones, one of each is refined."""
    order = np.lexsort((e.more, e.key))
    key, more = e.key[order], e.more[order]
    same, bucket = spans.runs(key, more), spans.runs(key)
    head = np.diff(same, prepend=-1) > 0
    positive = (np.bincount(same) + np.bincount(same, e.code[order] & POSITIVE))[same] > 1
    mixed = np.bincount(bucket, head)[bucket] > 1
    code = (e.code[order] & ~np.uint16(3)) | np.where(positive, POSITIVE, 0).astype(np.uint16) | np.where(mixed & head, REFINE, 0).astype(np.uint16)
    told = code & 3 > 0
    return order[told], code[told]


def ask_strings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of single windows, by 128 bits, where a bucket of the last refinement is still mixed."""
    for chunk in spans.chunks(batches):
        first, _ = _layout(chunk)
        found = []
        for s, data, ok in _segments(chunk, _ranges(chunk, REFINE)):
            start = np.flatnonzero(ok)
            doc = np.searchsorted(first, start + s, "right") - 1
            k, part = np.array(chunk.k, np.int64), np.array(chunk.part, np.uint32)
            found.append(Entries(Strings(data).of(start, start + WINDOW), Strings(data, 1).of(start, start + WINDOW), k[doc], part[doc],
                                 (start + s - first[doc]).astype(np.uint32), np.zeros(len(start), np.uint16)))
        if found:
            yield from spans.ask_repeated(spans.join(found), buckets)


def _removed(docs: DataFrame, id: str, text: str) -> DataFrame:
    base, buckets = spans.by_document(docs, id, text), spans.bucket_count(docs, text)
    ask = lambda rows, fn: rows.mapInArrow(fn, spans.ENTRIES)
    sides = spans.answered(ask(base, lambda b: ask_buckets(b, buckets, SIDE, 0)), refine)
    steps = spans.answered(ask(spans.with_marks(base, sides, "inner"), lambda b: ask_buckets(b, buckets, STEP, REFINE)), refine)
    strings = spans.answered(ask(spans.with_marks(base, steps, "inner"), lambda b: ask_strings(b, buckets)), spans.repeated)
    return spans.with_marks(base, sides.unionByName(steps).unionByName(strings), "left")


def _spans(n: int, marks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    m = marks[marks["code"] & POSITIVE > 0]
    lo = np.sort(m["at"].astype(np.int64))
    hi = (m["at"].astype(np.int64) + (m["code"] >> 2) + WINDOW)[np.argsort(m["at"], kind="stable")]
    out: list[tuple[int, int]] = []
    for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, min(z, n)))
    return out


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop each byte covered by a string of 200 bytes that also starts anywhere else in the corpus, the same document included.

    A sparse suffix array in rounds. The suffixes start at the least 16-gram of each 200-byte window, about one in 90 bytes. Their
    first buckets hold the 108 bytes that all windows on one side of the suffix share; buckets of one member drop out, equal runs are
    done, mixed buckets are refined by the 189 bytes at the offsets of 12 windows, and what is still mixed by whole windows. Buckets are hashes of
    bytes, not numbers of other buckets; only what the round before left open asks again.

    Texts are UTF-8 bytes, null and empty ones have none; matches never cross documents. Rows that repeat an id and a text are one
    document with the same result each; rows that repeat only the id are documents of their own. An empty table gives none. Ids are cast
    to long; other columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first and end byte of
    each removed run) and kept (the remaining bytes).
    """
    def finish(batches):
        for chunk in spans.chunks(batches, repeats=True):
            rows = []
            for k, body, marks in zip(chunk.k, chunk.body, chunk.marks, strict=True):
                gone = _spans(len(body), marks)
                edges = [0, *(x for pair in gone for x in pair), len(body)]
                kept = b"".join(body[a:z] for a, z in zip(edges[0::2], edges[1::2], strict=True))
                rows.append((None if k == spans.NULL_ID else k, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(),
                             [x for pair in gone for x in pair], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return _removed(docs, id, text).mapInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
