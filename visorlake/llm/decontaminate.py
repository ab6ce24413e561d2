"""Benchmark decontamination: stretches with enough words of an item, aligned with it, and their latent cosine."""
from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import keyed, whole, without
from visorlake.session import settle

#: Words are hashed to so many terms; document frequencies of all of them fit the driver.
TERMS = 1 << 20
#: Latent dimensions, extra random directions, power rounds. All documents and all benchmark items fit the latent space.
RANK, EXTRA, ROUNDS = 128, 16, 2
#: Benchmark items searched at a time. More items take more passes.
ITEM_BLOCK = 5_000
#: Of the words an item must share with a stretch, this part is looked for among its rarest words before its other words are counted.
KEYS = 1 / 5
#: Places of key words handled at a time, characters of texts that are split and words of texts that are searched together.
PLACES, CHARS, WORDS = 1_000_000, 4_000_000, 100_000
#: A stretch of twice the item's words and one more is a leak if so much of the item, and of its last third (the answer), is a common subsequence.
SHARE, ANSWER = 0.6, 0.5
#: Shorter items name nothing in particular; they are leaks only of texts that consist of them.
LEAST_WORDS = 5
#: Characters of scripts that set no blanks between words; each counts as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Stands for every word that no item holds.
OTHER = TERMS


def term_of(bare: str) -> int:
    return zlib.crc32(bare.encode()) % TERMS


def lowered(text: str) -> str:
    """Lower-case text with blanks around characters of scripts without blanks."""
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.lower()


def raw_words(text: str) -> list[str]:
    """Lower-case words by white space, characters of scripts without blanks one by one."""
    return lowered(text).split()


def bare_words(text: str) -> list[str]:
    """Lower-case words without outer punctuation."""
    return [w for w in (r.strip(string.punctuation) for r in raw_words(text)) if w]


class _Terms(dict):
    """Terms of the words of some items. Other words need no place here, so it never grows."""

    def __init__(self, words):
        super().__init__((w, term_of(w)) for w in words)

    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The terms of the bare words of each text, OTHER for words that are not known.

        Texts are split and their words looked up together, CHARS at a time.
        """
        held, size = [], 0
        for t in texts:
            held.append(lowered(t))
            size += len(t)
            if size >= CHARS:
                yield from self._split(held)
                held, size = [], 0
        yield from self._split(held)

    def _split(self, texts: list[str]) -> Iterator[np.ndarray]:
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))   # the same white space as str.split
        bare = pc.ascii_trim(words.flatten(), string.punctuation)
        at = pc.fill_null(pc.index_in(bare, pa.array(self, pa.large_string())), len(self)).to_numpy()
        ids = np.array([*self.values(), OTHER], np.int64)[at]
        full = pc.binary_length(bare).to_numpy() > 0
        ends = words.offsets.to_numpy()
        upto = np.append(0, np.cumsum(full))[ends].tolist()
        ids = ids[full]
        for lo, hi in zip(upto, upto[1:]):
            yield ids[lo:hi]


def count_terms(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """The terms of `words` in each whole text and how often each is there, packed (columns term, n; int32)."""
    sent = docs.sparkSession.sparkContext.broadcast(_Terms(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ids in sent.value.ids(t.as_py() for t in b.column(0)):
                rows.append([part.astype(np.int32).tobytes() for part in np.unique(ids[ids != OTHER], return_counts=True)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["term", "n"])

    return docs.select(whole(text).alias("text")).mapInArrow(count, "term binary, n binary")


def _with_term(texts: Iterable[np.ndarray]) -> pa.RecordBatch:
    """How many of some texts hold each term, from the distinct terms of each text; their number stands at -1."""
    total, n = np.zeros(TERMS, np.int64), 0
    for terms in texts:
        total[terms] += 1
        n += 1
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])


def _idf(parts: DataFrame) -> tuple[np.ndarray, int]:
    found = parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, times = (found.column(k).to_numpy() for k in range(2))               # at most the terms of the items
    df, n = np.zeros(TERMS), int(times[term < 0].sum())
    df[term[term >= 0]] = times[term >= 0]
    return np.log((1 + n) / (1 + df)) + 0.1, n


def idf(counted: DataFrame) -> tuple[np.ndarray, int]:
    """log((1 + documents) / (1 + documents with the term)) + 0.1 over all texts of `count_terms`, and the number of texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _with_term(np.frombuffer(t.as_py(), np.int32) for b in batches for t in b.column(0))

    return _idf(counted.select("term").mapInArrow(count, "term long, n long"))


def idf_of_texts(docs: DataFrame, words: list[str], text: str = "text") -> tuple[np.ndarray, int]:
    """`idf` where nobody needs the counts of each text: words are counted and summed in one Python worker of a task.

    A Python stage that reads another one has a worker each, and idle workers keep their memory until the executor has been idle for a while.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_Terms(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _with_term(np.unique(ids[ids != OTHER]) for b in batches for ids in sent.value.ids(t.as_py() for t in b.column(0)))

    return _idf(docs.select(whole(text).alias("text")).mapInArrow(count, "term long, n long"))


@dataclass
class Index:
    """Benchmark items of one block: their key words by term, and their place in the latent space."""
    ids: list
    words: list[list[str]]
    terms: _Terms
    codes: list[dict]        # for each item the places of its terms, as bits
    need: np.ndarray         # words that a leak shares with the item
    span: np.ndarray         # words of a stretch
    keys: np.ndarray         # places of key words that a leak has in its stretch
    first: np.ndarray        # of a term: where its items start in `of`
    count: np.ndarray        # of a term: how many items have it as a key word
    of: np.ndarray
    row: np.ndarray          # latent row of a term, -1 if it is in no item
    basis: np.ndarray        # (terms in items and a zero row, RANK), scaled by idf
    vectors: np.ndarray      # unit latent vectors of the items


def _key_terms(terms: np.ndarray, need: int, keys: int, weight: np.ndarray) -> np.ndarray:
    """The rarest terms of an item, so many that its other words are `need - keys` at most.

    A common subsequence of `need` words then has `keys` of them at least, each at a place of its own in the text.
    """
    found, times = np.unique(terms, return_counts=True)
    order = np.lexsort((found, -weight[found]))
    left = len(terms) - np.cumsum(times[order])
    return found[order[:int(np.argmax(left <= need - keys)) + 1]]


def _vectors(at, vectors) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(at, np.int32)), pa.array([v.tobytes() for v in vectors], pa.binary())], ["at", "v"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each term; all rows of a term are in the same partition."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(v)
            total[at] = total[at] + x if at in total else x
    if total:
        yield _vectors(list(total), total.values())


def latent_basis(passages: DataFrame, row: np.ndarray, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of `passages` (columns term, n, w) by randomised subspace iteration.

    Each round multiplies the matrix and its transpose with a narrow random block, partition by partition; the sums per
    term, (terms in items) x (rank + EXTRA) numbers, are made orthogonal on the driver.
    """
    n = int(row.max()) + 1
    width = min(rank + EXTRA, n)
    q = np.random.default_rng(11).standard_normal((n, width))
    for last in [False] * ROUNDS + [True]:
        q = np.linalg.qr(q)[0] if width else q
        block = q.astype(np.float32)

        def multiply(batches, block=block):
            total = np.zeros((n, width))
            for b in batches:
                part = np.zeros((n, width), np.float32)                        # of one batch, so that long sums stay in double
                for t, c, w in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    at = row[np.frombuffer(t, np.int32)]
                    x = np.frombuffer(c, np.int32) * weight[at]
                    size = np.sqrt(x @ x)
                    if size:
                        x = (x * (w / size)).astype(np.float32)
                        part[at] += np.outer(x, x @ block[at])                 # a term is once in `at`
                total += part
            used = np.flatnonzero(np.abs(total).sum(1))
            yield _vectors(used, total[used])

        sums = passages.select("term", "n", "w").mapInArrow(multiply, "at int, v binary").repartition("at").mapInArrow(_add_up, "at int, v binary").toArrow()   # terms in items
        out = np.zeros((n, width))
        for at, v in zip(sums.column("at").to_pylist(), sums.column("v").to_pylist(), strict=True):
            out[at] = np.frombuffer(v)
        if last:
            values, turn = np.linalg.eigh(block.T.astype(float) @ out)
            return q @ turn[:, np.argsort(-values)[:min(rank, width)]]
        q = out + 1e-12 * np.eye(n, width)
    return q


def fit_basis(counted: DataFrame, items: list, words: list[str], row: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Fit the latent space on all documents (`count_terms`, so many) and on the items, which together weigh as much as the documents."""
    spark = counted.sparkSession
    own = settle(count_terms(spark.createDataFrame([(t,) for _, t in items], "text string"), words)).withColumn("w", F.lit(float(np.sqrt(max(1.0, docs / len(items))))))
    few = max(spark.sparkContext.defaultParallelism, counted.rdd.getNumPartitions() // 4)   # the counts are a fraction of the texts; each task sends a row for every term
    return latent_basis(counted.withColumn("w", F.lit(1.0)).coalesce(few).unionByName(own.coalesce(1)), row, weight)


def build_index(counted: DataFrame | None, items: list, weight: np.ndarray, docs: int = 0, latent: bool = True) -> Index:
    """All that the search needs of some items; without `latent` there is no latent space, and cosines are 0."""
    words = [bare_words(t) for _, t in items]
    term_lists = [np.array([term_of(w) for w in ws], np.int64) for ws in words]
    used = np.unique(np.concatenate(term_lists))
    row = np.full(TERMS + 1, -1)
    row[used] = np.arange(len(used))
    known = sorted({w for ws in words for w in ws})
    basis = fit_basis(counted, items, known, row, weight[used], docs) * weight[used][:, None] if latent else np.zeros((len(used), 0))
    vectors = np.stack([basis[row[ids]].sum(0) for ids in term_lists])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    size = np.array([len(w) for w in words])
    need = np.where(size < LEAST_WORDS, size, np.ceil(SHARE * size - 1e-9)).astype(np.int64)
    keys = np.maximum(1, (need * KEYS).astype(np.int64))
    key_terms = [_key_terms(t, n, k, weight) for t, n, k in zip(term_lists, need.tolist(), keys.tolist(), strict=True)]
    pairs_term, pairs_item = np.concatenate(key_terms), np.repeat(np.arange(len(items)), [len(t) for t in key_terms])
    order = np.argsort(pairs_term, kind="stable")
    count = np.bincount(pairs_term, minlength=TERMS + 1)
    codes = []
    for t in term_lists:
        bits: dict[int, int] = {}
        for k, x in enumerate(t.tolist()):
            bits[x] = bits.get(x, 0) | 1 << k
        codes.append(bits)
    return Index([i for i, _ in items], words, _Terms(known), codes, need, np.where(size < LEAST_WORDS, size, 2 * size + 1), keys, (np.cumsum(count) - count).astype(np.int32),
                 count.astype(np.int32), pairs_item[order], row.astype(np.int32),
                 np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32), vectors.astype(np.float32))


# ---------------------------------------------------------------- alignment
def common_subsequence(a: list[str], b: list[str]) -> list[bool]:
    """Which words of `a` belong to one longest common subsequence with `b`."""
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    full = v = (1 << len(b)) - 1
    rows = [v]                                                                 # zeros among the first j bits of row i: what i and j words share
    for w in a:
        u = v & places.get(w, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    hit, i, j = [False] * len(a), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            hit[i - 1] = True
            i, j = i - 1, j - 1
            continue
        upto = (1 << j) - 1
        if (rows[i - 1] & upto).bit_count() == (rows[i] & upto).bit_count():
            i -= 1
        else:
            j -= 1
    return hit


def common_length(bits: list[int], size: int) -> int:
    """Length of the longest common subsequence of `size` words and a text, given the places of each word of the text as bits."""
    full = v = (1 << size) - 1
    for m in bits:
        u = v & m
        v = (v + u | v - u) & full
    return size - v.bit_count()


def _stretches(ids: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(item number, first start, last start) of all stretches that may hold enough of an item's words. None that does is left out."""
    places = index.count[ids]
    upto = np.cumsum(places, dtype=np.int64)
    widest, at = int(index.span.max()), 0
    while len(ids) and at < len(ids):
        end = min(len(ids), max(at + widest, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES))))
        stop = min(len(ids), end + widest)                                     # stretches from here to `end` are whole
        here = at + np.flatnonzero(places[at:stop])
        n = places[here].astype(np.int64)
        total = int(n.sum())
        if total:
            item = index.of[np.repeat(index.first[ids[here]] - (np.cumsum(n) - n), n) + np.arange(total)]
            big = len(ids) + widest + 1
            key = np.sort(item * big + np.repeat(here, n))
            item = key // big
            last = np.arange(total) + index.keys[item] - 1
            ok = np.flatnonzero(last < total)
            ok = ok[key[last[ok]] - key[ok] < index.span[item[ok]]]            # so many key words within a stretch of this item
            if len(ok):
                base, k = item[ok] * big, item[ok]
                low, high = np.maximum(key[last[ok]] - base - index.span[k] + 1, at), key[ok] - base
                cut = np.append(0, 1 + np.flatnonzero((k[1:] != k[:-1]) | (low[1:] > high[:-1] + 1)))
                tops = np.append(cut[1:], len(ok)) - 1
                yield from zip(k[cut].tolist(), low[cut].tolist(), high[tops].tolist(), strict=True)
        at = end


def _together(texts: list[np.ndarray], index: Index) -> list[list[tuple[int, int, int]]]:
    """`_stretches` of each of some texts. They are laid in a row, so far apart that no stretch reaches from one to the next."""
    sizes = np.array([len(ids) for ids in texts]) + int(index.span.max()) + 2
    starts = (np.cumsum(sizes) - sizes).tolist()
    row = np.full(int(sizes.sum()), OTHER, np.int64)
    for start, ids in zip(starts, texts, strict=True):
        row[start:start + len(ids)] = ids
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for item, low, high in _stretches(row, index):
        k = bisect_right(starts, high) - 1
        found[k].append((item, max(low - starts[k], 0), high - starts[k]))
    return found


def leaks_of_all(texts: Sequence[str], index: Index) -> Iterator[list[tuple]]:
    """`leaks_of` each text; short ones are searched together, WORDS at a time with what lies between them."""
    held: list[tuple[str, np.ndarray]] = []
    size, gap = 0, int(index.span.max()) + 2

    def search():
        for (text, ids), near in zip(held, _together([ids for _, ids in held], index), strict=True):
            yield leaks_of(text, index, ids, near)

    for text, ids in zip(texts, index.terms.ids(texts), strict=True):
        held.append((text, ids))
        size += len(ids) + gap
        if size >= WORDS:
            yield from search()
            held, size = [], 0
    if held:
        yield from search()


def leaks_of(text: str, index: Index, ids: np.ndarray | None = None, stretches: Iterable[tuple[int, int, int]] | None = None) -> list[tuple]:
    """(item number, latent cosine, share of the item, share of its answer, first word of the stretch) of each item found in a text.

    `ids`, `stretches`: the text's terms and its stretches that may hold enough of an item, if they are at hand.
    """
    ids = next(index.terms.ids([text])) if ids is None else ids
    best: dict[int, tuple] = {}
    words: list[str] | None = None
    for item, low, high in _stretches(ids, index) if stretches is None else stretches:
        if item in best and best[item][2] == 1.0 or len(index.words[item]) < LEAST_WORDS and len(ids) != len(index.words[item]):
            continue
        code, size, span, need = index.codes[item], len(index.words[item]), int(index.span[item]), int(index.need[item])
        near = ids[low:high + span].tolist()
        at = [k for k, t in enumerate(near) if t in code]                      # a stretch may as well start at its first common word
        if len(at) < need:
            continue
        own = [code[near[k]] for k in at]
        found, z = [], 0
        for k, start in enumerate(at):
            if start > high - low:
                break
            while z < len(at) and at[z] < start + span:
                z += 1
            if z - k >= need and (n := common_length(own[k:z], size)) >= need:
                found.append((-n, low + start))
        for n, start in sorted(found):
            if item in best and -n / size <= best[item][2]:
                break
            words = bare_words(text) if words is None else words               # two words may be one term
            hit = common_subsequence(index.words[item], words[start:start + span])
            tail = hit[-max(1, len(hit) // 3):]
            share, answer = sum(hit) / len(hit), sum(tail) / len(tail)
            if share >= (SHARE if size >= LEAST_WORDS else 1) and answer >= ANSWER and (item not in best or share > best[item][2]):
                v = index.basis[index.row[ids[start:start + span]]].sum(axis=0)  # the last row of the basis is zero
                best[item] = (item, float(v @ index.vectors[item] / max(np.linalg.norm(v), 1e-9)), share, answer, start)
    return [best[i] for i in sorted(best)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", block: int = ITEM_BLOCK, cosine: bool = True) -> DataFrame:
    """Pairs of documents and the benchmark items they hold: doc_id, copy_key, item_id, cosine, share, answer_share, at_word.

    A pair is found if some stretch of twice the item's words (and one) has SHARE of the item as a longest common subsequence, which
    tolerates changed, added and missing words, and ANSWER of the item's last third in it. No such stretch is passed over: it must
    hold a certain number of the item's rarest words, and those are looked up for every word of every whole text. How rare a word is
    (its document frequency over all texts) and what stands around an item decide the time, not the result. The cosine is that
    of the stretch and the item in the latent space of a distributed randomised SVD of the TF-IDF of all documents; it decides nothing. Without
    `cosine` that space is not fitted and the column is left out.

    The benchmark goes to the tasks `block` items at a time, so what is sent is bounded; a block takes two passes over the texts, one that
    counts its words and one that searches. An item of fewer than `LEAST_WORDS` words is
    found in texts of just these words. In scripts without blanks
    every character is a word. Null or empty texts match nothing, nor do items without words; rows that repeat an item, or an id and a
    text, give the same pairs each. Empty tables give none. Other columns are ignored.
    """
    rows = keyed(docs, id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, copy_key long, item_id long, cosine double, share double, answer_share double, at_word int"
    names = [f.split()[0] for f in schema.split(", ")]
    shown = [c for c in names if cosine or c != "cosine"]
    items = settle(benchmark.select(F.col(item).cast("long").alias("item_id"), whole(item_text).alias("item_text"))
                   .groupBy("item_id", "item_text").agg(F.count(F.lit(1)).alias("times")))
    blocks = max(1, -(-items.count() // block))
    numbered = items.withColumn("_b", F.pmod(F.xxhash64("item_text", "item_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows_of = {(r["item_id"], r["item_text"]): r["times"] for r in numbered.where(F.col("_b") == b).collect()}    # about `block` items
        part = sorted((p for p in rows_of if bare_words(p[1])), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        if not part:
            continue
        times = [rows_of[p] for p in part]
        words = sorted({w for _, t in part for w in bare_words(t)})
        counted = settle(count_terms(docs, words, text)) if cosine else None
        weight, n = idf(counted) if cosine else idf_of_texts(docs, words, text)
        sent = docs.sparkSession.sparkContext.broadcast(build_index(counted, part, weight, n, cosine))

        def search(batches, sent=sent, times=times):
            index = sent.value
            for batch in batches:
                found = [(d, k, index.ids[i], v, s, a, at) for d, k, leaks in
                         zip(batch.column("doc_id").to_pylist(), batch.column("copy_key").to_pylist(), leaks_of_all(batch.column("text").to_pylist(), index), strict=True)
                         for i, v, s, a, at in leaks for _ in range(times[i])]
                if found:
                    cols = list(zip(*found, strict=True))
                    types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        pairs = rows.select("doc_id", "copy_key", "text").mapInArrow(search, schema).select(*shown)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema).select(*shown)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", cosine: bool = False) -> DataFrame:
    """The rows of `docs` that hold no benchmark item.

    With `cosine` the whole of `find_leaks` is done and settled, the latent cosine of each leak included, before rows are dropped by it. The
    cosine decides nothing about them; without it the latent space is not fitted.
    """
    leaks = find_leaks(docs, benchmark, id, text, cosine=cosine)
    return without(docs, settle(leaks if cosine else leaks.select("doc_id", "copy_key")), id, text)
