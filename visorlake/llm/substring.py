"""Removal of word windows that occur earlier in the corpus, found through difference-cover anchors."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm import spans
from visorlake.llm.spans import Entries, mix

#: For any two positions there is a shift below PERIOD that puts both on the cover: every difference modulo 13 occurs once.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
#: Words under an anchor: an anchor after any shift still ends within the window.
ANCHOR = WINDOW - PERIOD + 1
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_BYTES = b" \t\n\x0b\x0c\r"
BASE1, BASE2 = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
SEGMENT = 4_000_000


def _byte_values(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


VALUES = _byte_values()
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE_BYTES)] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base)]))


def word_spans(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes."""
    ink = np.concatenate([[False], ~IS_WHITE[np.frombuffer(body, np.uint8)], [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word; long texts are hashed in segments that end between words."""
    starts, ends = word_spans(body)
    out = np.empty(len(starts), np.uint64)
    data = np.frombuffer(body, np.uint8)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        a, z = int(starts[i]), int(ends[j - 1])
        size = ends[i:j] - starts[i:j]
        cut = starts[i:j] - a
        place = np.arange(z - a) - np.repeat(cut, np.diff(np.append(cut, z - a)))
        power = _powers(BASE1, int(place.max()) + 1)
        values = np.where(IS_WHITE[data[a:z]], np.uint64(0), VALUES[data[a:z]] * power[place])
        out[i:j] = mix(np.add.reduceat(values, cut) + size.astype(np.uint64) * spans.GOLDEN)
        i = j
    return starts, ends, out


def window_hashes(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of each n consecutive words."""
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * base + words[k:len(words) - n + 1 + k]
    return mix(total)


def _chunk_words(chunk: spans.Chunk):
    """Concatenated word hashes of the documents, with document number and position of each word, and words left to the end."""
    hashes = [word_hashes(b)[2] if b else np.zeros(0, np.uint64) for b in chunk.body]
    size = np.array([len(h) for h in hashes])
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate(hashes), doc, at, size[doc] - at


def _entries(chunk: spans.Chunk, key, more, doc, at) -> Entries:
    k, part = np.array(chunk.k, np.int64), np.array(chunk.part, np.uint32)
    return Entries(key, more, k[doc], part[doc], at.astype(np.uint32), np.zeros(len(key), np.uint16))


def ask_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    on_cover = np.isin(np.arange(PERIOD), COVER)
    for chunk in spans.chunks(batches):
        words, doc, at, left = _chunk_words(chunk)
        if len(words) < ANCHOR:
            continue
        rows = np.flatnonzero(on_cover[at % PERIOD] & (left >= ANCHOR) & ((at + left) >= WINDOW))
        if len(rows):
            key = window_hashes(words, ANCHOR, BASE1)[rows] >> np.uint64(16)       # only a filter: 48 bits travel for less
            yield from spans.ask_repeated(_entries(chunk, key, np.zeros(len(rows), np.uint64), doc[rows], at[rows]), buckets)


def _candidates(marks: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of a document of n words that hold a repeated anchor."""
    edge = np.zeros(n + 1, np.int64)
    anchor = marks["at"].astype(np.int64)
    np.add.at(edge, np.maximum(anchor - (WINDOW - ANCHOR), 0), 1)
    np.add.at(edge, np.minimum(anchor + 1, n), -1)
    return np.flatnonzero(np.cumsum(edge)[:max(n - WINDOW + 1, 0)] > 0)


def ask_windows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One entry, the earliest, per window text of a chunk; later ones are marked at once."""
    for chunk in spans.chunks(batches):
        words, doc, _, _ = _chunk_words(chunk)
        first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(chunk.k)))])
        rows = [first[d] + _candidates(m, int(first[d + 1] - first[d])) for d, m in enumerate(chunk.marks)]
        rows = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        if not len(rows):
            continue
        e = _entries(chunk, window_hashes(words, WINDOW, BASE1)[rows], window_hashes(words, WINDOW, BASE2)[rows], doc[rows],
                     rows - first[doc[rows]])
        order = np.lexsort((e.at, e.part, e.doc, e.more, e.key))
        e = e.take(order)
        start = np.diff(spans.runs(e.key, e.more), prepend=-1) > 0
        later = e.take(~start)
        later.code = np.full(len(later.key), spans.REPEATED)
        yield from spans.packed(e.take(start), later, buckets)


def later_ones(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """All entries but the earliest of each window text."""
    order = np.lexsort((e.at, e.part, e.doc, e.more, e.key))
    rows = order[np.diff(spans.runs(e.key[order], e.more[order]), prepend=-1) == 0]
    return rows, np.full(len(rows), spans.REPEATED)


def _kept(body: bytes, marks: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_spans(body) if body else (np.zeros(0, int), np.zeros(0, int))
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, marks["at"].astype(np.int64), 1)
    np.add.at(edge, np.minimum(marks["at"].astype(np.int64) + WINDOW, len(starts)), -1)
    return len(starts), np.cumsum(edge)[:len(starts)] == 0, starts, ends


def _removed(docs: DataFrame, id: str, text: str) -> DataFrame:
    base, buckets = spans.by_document(docs, id, text), spans.bucket_count(docs, text)
    anchors = spans.answered(base.mapInArrow(lambda b: ask_anchors(b, buckets), spans.ENTRIES), spans.repeated)
    windows = spans.answered(spans.with_marks(base, anchors, "inner").mapInArrow(lambda b: ask_windows(b, buckets), spans.ENTRIES), later_ones)
    return spans.with_marks(base, windows, "left")


def remove_repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop each word covered by a window of 20 words that also starts earlier in the corpus.

    Anchors of 8 words at the positions of a difference cover modulo 13 (4 of 13) are compared first: two equal windows share an anchor at
    the same offset, wherever they start. Only windows around an anchor that occurs twice are extended to their 20 words and compared
    by 128 bits; all but the earliest of equal windows are marked. Windows are judged on the input.

    Words are runs of bytes other than white space; documents are ordered by id, those that share an id by a hash of their text,
    a null id first. Rows that repeat an id and a text are one document and get the same result each. Null and empty texts have no
    words. An empty table gives none. Ids are cast to long; other columns are ignored.
    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space).
    """
    def finish(batches):
        for chunk in spans.chunks(batches, repeats=True):
            rows = []
            for k, body, marks in zip(chunk.k, chunk.body, chunk.marks, strict=True):
                n, keep, starts, ends = _kept(body, marks)
                kept = b" ".join([body[a:z] for a, z in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                rows.append((None if k == spans.NULL_ID else k, n, n - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return _removed(docs, id, text).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


WINDOW_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
     s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) AS i FROM w),
     h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY words[i + 1:i + 20] ORDER BY doc_id, i) > 1 AS dup FROM s),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM h WHERE dup),
     g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
     k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
                  array_to_string(CASE WHEN gone IS NULL THEN words ELSE
                      list_transform(list_filter(range(len(words)), lambda p: NOT list_contains(gone, p)), lambda p: words[p + 1]) END, ' ') AS kept
           FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
