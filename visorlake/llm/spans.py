"""Finding repeated pieces of text over all documents with few bytes per piece.

Documents are dealt out by id once; all passes over the texts read that one exchange. What a pass asks about its pieces
travels in columns of packed numbers, a row per chunk of documents and bucket, instead of a row per piece. A
chunk sends at most two entries for a key, however often the key occurs, so a piece that a third of all documents share
costs its bucket two entries per chunk. The answers come back as marks: document, place and a code.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import whole

#: Bytes of text worked on at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Buckets of packed entries: at least LEAST_BUCKETS, and one for each BUCKET_BYTES of text.
LEAST_BUCKETS, BUCKET_BYTES = 1_024, 64_000_000
#: A mark: which of the documents that share the id (in the order of their keys), where in it, and what is known.
MARK = np.dtype([("part", "<u4"), ("at", "<u4"), ("code", "<u2")])
NULL_ID = -(1 << 63)
ENTRIES = "bucket int, key binary, more binary, doc binary, part binary, at binary, code binary"
MARKS = "k long, marks binary"
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def by_document(docs: DataFrame, id: str, text: str) -> DataFrame:
    """k (the id; the lowest long for a null), copy_key, text, dealt out and sorted by both."""
    return (docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("k"), whole(text).alias("text"))
            .withColumn("copy_key", F.xxhash64("text")).repartition("k").sortWithinPartitions("k", "copy_key"))


def with_marks(base: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """`base` with the marks of its documents as an array of binaries."""
    return base.join(marks.groupBy("k").agg(F.collect_list("marks").alias("marks")), "k", how)


def bucket_count(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(whole(text)))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


@dataclass
class Chunk:
    """Some documents: ids, parts, texts as bytes and their marks."""
    k: list[int] = field(default_factory=list)
    part: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)
    marks: list[np.ndarray] = field(default_factory=list)
    size: int = 0


def chunks(batches: Iterator[pa.RecordBatch], repeats: bool = False) -> Iterator[Chunk]:
    """Documents in chunks of about CHUNK_BYTES. Rows that repeat an id and a text count once, unless `repeats`."""
    last, part, now = (None, None), 0, Chunk()
    for b in batches:
        marks = b.column("marks").to_pylist() if "marks" in b.schema.names else [None] * b.num_rows
        for k, key, body, m in zip(b.column("k").to_pylist(), b.column("copy_key").to_pylist(), b.column("text"), marks, strict=True):
            same = (k, key) == last
            part = part if same else part + 1 if k == last[0] else 0
            last = (k, key)
            if same and not repeats:
                continue
            own = np.frombuffer(b"".join(m), MARK) if m else np.zeros(0, MARK)
            text = body.as_buffer().to_pybytes()
            now.k.append(k)
            now.part.append(part)
            now.body.append(text)
            now.marks.append(own[own["part"] == part] if len(own) else own)
            now.size += len(text) + 100
            if now.size >= CHUNK_BYTES:
                yield now
                now = Chunk()
    if now.k:
        yield now


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers byte plane by byte plane, so that high bytes, mostly zero, compress away."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _steps(name: str, x: np.ndarray) -> np.ndarray:
    """Ids as differences, small ones where entries come in the order of their documents; differences wrap around."""
    return np.diff(x.view(np.uint64), prepend=np.uint64(0)) if name == "doc" else x


def _numbers(name: str, planes: bytes) -> np.ndarray:
    kind = KINDS[name]
    x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x.view(np.uint64), dtype=np.uint64).view(np.int64) if name == "doc" else x


KINDS = {"key": "<u8", "more": "<u8", "doc": "<i8", "part": "<u4", "at": "<u4", "code": "<u2"}


@dataclass
class Entries:
    """Pieces that ask: key, a second hash, and whose they are."""
    key: np.ndarray
    more: np.ndarray
    doc: np.ndarray
    part: np.ndarray
    at: np.ndarray
    code: np.ndarray

    def take(self, rows) -> Entries:
        return Entries(*(getattr(self, f)[rows] for f in KINDS))


def packed(sent: Entries, known: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRIES: `sent` by bucket; `known`, already answered, as one row with empty keys under a bucket of its own."""
    rows = []
    if len(sent.key):
        bucket = (mix(sent.key) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((sent.at, sent.part, sent.doc, bucket))
        sent, bucket = sent.take(order), bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows.append((int(bucket[a]), *(_planes(_steps(f, getattr(sent, f)[a:z]), kind) for f, kind in KINDS.items())))
    if len(known.key):
        rows.append((int(mix(np.array([int(known.doc[0]) & (2 ** 64 - 1)], np.uint64))[0] % np.uint64(buckets)), b"", b"",
                     *(_planes(_steps(f, getattr(known, f)), kind) for f, kind in list(KINDS.items())[2:])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))],
                                         [c.split()[0] for c in ENTRIES.split(", ")])


def answered(entries: DataFrame, settle_bucket: Callable[[Entries], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Marks from entries. `settle_bucket` gets all entries of some keys and returns the numbers and codes of those it marks."""
    def run(batch: pa.Table) -> pa.Table:
        columns = {f: batch.column(f).to_pylist() for f in KINDS}
        asked = [i for i, key in enumerate(columns["key"]) if key]
        out = []
        if asked:
            e = Entries(*(np.concatenate([_numbers(f, columns[f][i]) for i in asked]) for f in KINDS))
            rows, code = settle_bucket(e)
            out.append((e.doc[rows], e.part[rows], e.at[rows], code))
        for i, key in enumerate(columns["key"]):
            if not key:
                out.append(tuple(_numbers(f, columns[f][i]) for f in ("doc", "part", "at", "code")))
        doc, part, at, code = (np.concatenate([o[j] for o in out]) for j in range(4))
        order = np.argsort(doc, kind="stable")
        marks = np.empty(len(doc), MARK)
        marks["part"], marks["at"], marks["code"] = part[order], at[order], code[order]
        doc = doc[order]
        cuts = np.append(np.flatnonzero(np.diff(doc, prepend=doc[0] - 1 if doc[0] > NULL_ID else 1)), len(doc)) if len(doc) else np.zeros(1, int)
        return pa.table({"k": pa.array(doc[cuts[:-1]]), "marks": pa.array([marks[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(run, MARKS)


def join(parts: list[Entries]) -> Entries:
    if not parts:
        return Entries(*(np.zeros(0, kind) for kind in KINDS.values()))
    return Entries(*(np.concatenate([getattr(p, f) for p in parts]) for f in KINDS))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each row of sorted arrays belongs to."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


# ---------------------------------------------------------------- which pieces occur more than once
REPEATED = np.uint16(1)


def ask_repeated(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """One entry per (key, more) of a chunk; those that repeat within it are marked at once and sent as repeated."""
    order = np.lexsort((e.more, e.key))
    e = e.take(order)
    run = runs(e.key, e.more)
    count = np.bincount(run)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    many = count[run] > 1
    sent = e.take(first)
    sent.code = np.where(count > 1, REPEATED, 0).astype(np.uint16)
    known = e.take(many)
    known.code = np.full(len(known.key), REPEATED)
    return packed(sent, known, buckets)


def repeated(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a (key, more) that has two entries, or one sent as repeated."""
    order = np.lexsort((e.more, e.key))
    run = runs(e.key[order], e.more[order])
    count = np.bincount(run) + np.bincount(run, e.code[order])
    rows = order[count[run] > 1]
    return rows, np.full(len(rows), REPEATED)
