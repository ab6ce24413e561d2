"""SimHash near-duplicates found by Golay-code fuzzy hashing."""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import keyed, without
from visorlake.operators.duplicates import connected_components
from visorlake.scale import look_up
from visorlake.session import settle

#: The generator polynomial of the (23, 12) Golay code, and the seed of the shingle hash.
GENERATOR, SEED = 0b101011100011, 42
#: The 64 bits are cut into three segments (first bit, bits); shorter ones are padded with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The most differing bits for which the keys below are complete.
MOST_BITS = 4
SHINGLE_BLOCK = 100_000


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str, n: int = 4) -> int:
    """64 bits, unsigned: each is set if set in over half of the hashes of the n-word shingles.

    A-Z is lower-cased first, nothing else. Fewer than n words are one shingle, no word gives 0.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = min(n, len(words))
    starts, ends = starts[:len(words) - n + 1], ends[n - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLE_BLOCK):
        block = [xxh64_intdigest(line[s:e], SEED)
                 for s, e in zip(starts[at:at + SHINGLE_BLOCK].tolist(), ends[at:at + SHINGLE_BLOCK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy_key and the fingerprint as a signed long, from whole texts; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.fromiter((fingerprint(t.as_py(), n) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy_key"), pa.array(marks)], ["doc_id", "copy_key", "mark"])

    rows = keyed(docs, id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, copy_key long, mark long")


# ---------------------------------------------------------------- the code
def _remainder(words: np.ndarray) -> np.ndarray:
    """23-bit words modulo the generator: their syndromes."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def near_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the error patterns of weight up to 5, lightest first, and how many have weight up to 4.

    The code is perfect: each syndrome has exactly one pattern of weight up to 3, its decoding. Patterns are padded with -1.
    """
    words = [sum(1 << b for b in c) for w in range(6) for c in combinations(range(23), w)]
    words = np.array(words, np.int64)
    weight = np.bitwise_count(words.astype(np.uint64)).astype(np.int64)
    syndrome = _remainder(words)
    order = np.lexsort((words, weight, syndrome))
    words, weight, syndrome = words[order], weight[order], syndrome[order]
    starts = np.searchsorted(syndrome, np.arange(2048))
    column = np.arange(len(words)) - starts[syndrome]
    table = np.full((2048, column.max() + 1), -1, np.int64)
    table[syndrome, column] = words
    return table, np.bincount(syndrome[weight <= 4], minlength=2048)


def _segments(marks: np.ndarray) -> list[np.ndarray]:
    u = marks.view(np.uint64)
    return [(u >> np.uint64(first) & np.uint64((1 << n) - 1)).astype(np.int64) for first, n in SEGMENTS]


def stored_keys(marks: np.ndarray) -> np.ndarray:
    """(n, 3): for each pair of segments the codeword indices of their decodings."""
    table, _ = near_patterns()
    index = [(s ^ table[_remainder(s), 0]) >> 11 for s in _segments(marks)]
    return np.stack([p << 24 | index[a] << 12 | index[b] for p, (a, b) in enumerate(combinations(range(3), 2))], axis=1)


def probe_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys under which any fingerprint within 4 bits is stored.

    Four errors in three segments leave two of them with at most (1, 1), (0, 2) or (2, 0). The decoding of a segment lies
    within 3 of it, so within 4 or 5 of a segment with one or two errors: these codewords are the keys.
    """
    table, within4 = near_patterns()
    rows, keys = [], []
    near = []
    for s in _segments(marks):
        syn = _remainder(s)
        patterns = table[syn]
        codes = np.where(patterns < 0, -1, (s[:, None] ^ patterns) >> 11)
        near.append((codes, within4[syn]))
    for p, (a, b) in enumerate(combinations(range(3), 2)):
        (ca, na), (cb, nb) = near[a], near[b]
        for i in range(ca.shape[1]):
            for j in range(cb.shape[1]):
                if i and j and (i >= na.max() or j >= nb.max()):
                    continue
                ok = (ca[:, i] >= 0) & (cb[:, j] >= 0)
                if i and j:
                    ok &= (i < na) & (j < nb)
                at = np.flatnonzero(ok)
                rows.append(at)
                keys.append(p << 24 | ca[at, i] << 12 | cb[at, j])
    return np.concatenate(rows), np.concatenate(keys)


# ---------------------------------------------------------------- links and groups
def near_marks(marks: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `most` (up to 4) bits; a pair may come more than once.

    One equi-join on the keys, verified on the spot. No pair is lost: both orders of a pair share a key.
    """
    if most > MOST_BITS:
        raise ValueError(f"the keys are complete up to {MOST_BITS} bits")

    def store(batches):
        for b in batches:
            m = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(stored_keys(m).ravel().astype(np.int32)), pa.array(np.repeat(m, 3))], ["code", "a"])

    def probe(batches):
        for b in batches:
            every = np.asarray(b.column(0))
            for at in range(0, len(every), 2_000):
                m = every[at:at + 2_000]
                rows, keys = probe_keys(m)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(m[rows])], ["code", "b"])

    stored = marks.select("mark").mapInArrow(store, "code int, a long")
    probes = marks.select("mark").mapInArrow(probe, "code int, b long")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return stored.join(probes, "code").where(close).select("a", "b")


def simhash_groups(docs: DataFrame, most: int = MOST_BITS, n: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its fingerprint and the component it falls into under links of at most `most` bits.

    Equal fingerprints are one node, so groups of copies cost one row; distinct fingerprints get three stored and about 180
    probing keys, and components come from randomised contraction. A fingerprint has at most 679,120 others within 4 bits,
    so no node's links grow with the data without bound.

    A null or empty text has fingerprint zero and is linked like any other. Null ids never name a component unless they are
    alone in it. Rows that repeat an id and a text get the same row each; rows that repeat only the id are documents of
    their own. An empty table gives none. Other columns are ignored.
    Returns doc_id, copy_key, fingerprint (16 hex digits), component_id, first (whether it is the document that stays).
    """
    marked = settle(fingerprints(docs, n, id, text))
    order = F.struct(F.isnull("doc_id").alias("z"), "doc_id", "copy_key")
    nodes = settle(marked.groupBy("mark").agg(F.min(order).alias("_o")))
    found = connected_components(near_marks(nodes, most)).select(F.col("id").alias("mark"), "cluster")
    joined = settle(nodes.join(found, "mark", "left").withColumn("cluster", F.coalesce("cluster", "mark")))
    heads = joined.groupBy("cluster").agg(F.min("_o").alias("_head"))
    named = settle(look_up(joined, heads, ["cluster"]).select("mark", "_head"))
    return look_up(marked, named, ["mark"]).select(
        "doc_id", "copy_key", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), F.col("_head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.col("copy_key") == F.col("_head.copy_key"))).alias("first"))


def without_near_copies(docs: DataFrame, most: int = MOST_BITS, n: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose document stays: one of each group. Rows that repeat an id and a text stay or go together."""
    return without(docs, settle(simhash_groups(docs, most, n, id, text)).where("NOT first"), id, text)
