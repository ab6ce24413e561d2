"""Token counts that follow edits: only the touched regions of a document are encoded again."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import whole
from visorlake.llm.tokens import FastTokenizer

#: A pre-token always starts at a single space or line feed between visible characters, whatever surrounds it.
CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
#: A leaf closes at the first cut after so many characters.
LEAF = 256
TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>"


class SegmentTree:
    """Leaves of whole pre-tokens with their characters and tokens, and sums of both for each subtree.

    The sums are a heap: node i has the children 2i and 2i + 1, leaf j sits at `base` + j.
    """

    def __init__(self, leaves: list[str], tokens: list[int], count):
        self.leaves, self.count, self.encoded = leaves, count, 0
        self._build(tokens)

    @classmethod
    def of(cls, text: str, count) -> SegmentTree:
        leaves = split(text)
        return cls(leaves, [count(x) for x in leaves], count)

    def _build(self, tokens: list[int]) -> None:
        self.base = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        if self.leaves:
            self.sums[self.base:self.base + len(self.leaves)] = np.stack([[len(x) for x in self.leaves], tokens], axis=1)
        level = self.base
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf_tokens(self) -> list[int]:
        return self.sums[self.base:self.base + len(self.leaves), 1].tolist()

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end of the text) and the place in it, by descent."""
        if at >= self.chars:
            last = len(self.leaves) - 1
            return last, at - self.chars + len(self.leaves[last])
        node = 1
        while node < self.base:
            node *= 2
            if at >= self.sums[node, 0]:
                at -= int(self.sums[node, 0])
                node += 1
        return node - self.base, at

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace `removed` characters at `at` by `inserted`; both are clipped to the text."""
        at = min(max(at, 0), self.chars)
        removed = min(max(removed, 0), self.chars - at)
        if not removed and not inserted:
            return
        if not self.leaves:
            self._replace(0, 0, inserted)
            return
        i, a = self.find(at)
        j, z = self.find(at + removed)
        text = self.leaves[i][:a] + inserted + self.leaves[j][z:]
        first, last = i, j
        while first and not (text and CUT.match(self.leaves[first - 1][-1:] + text[:2], 1)):    # the seam before is no longer a cut
            first -= 1
            text = self.leaves[first] + text
        while last + 1 < len(self.leaves) and not (text and CUT.match(text[-1:] + self.leaves[last + 1][:2], 1)):
            last += 1
            text += self.leaves[last]
        self._replace(first, last + 1, text)

    def _replace(self, first: int, end: int, text: str) -> None:
        fresh = split(text)
        tokens = [self.count(x) for x in fresh]
        self.encoded += len(text)
        if len(fresh) == end - first:                                          # same shape: update the sums above the leaves
            for k, (leaf, n) in enumerate(zip(fresh, tokens, strict=True), first):
                self.leaves[k] = leaf
                node = self.base + k
                change = np.array([len(leaf), n]) - self.sums[node]
                while node:
                    self.sums[node] += change
                    node //= 2
            return
        counts = self.leaf_tokens()
        self.leaves[first:end] = fresh
        self._build(counts[:first] + tokens + counts[end:])


def split(text: str) -> list[str]:
    """Leaves of at least LEAF characters, but the last, that end at cuts."""
    cuts, last = [0], 0
    for m in CUT.finditer(text):
        if m.start() - last >= LEAF:
            last = m.start()
            cuts.append(last)
    return [text[a:z] for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True)] if text else []


def _counter(tokenizer: str, ranks: str):
    encoder = FastTokenizer(tokenizer, ranks)
    return lambda leaf: len(encoder.ids(leaf)) // 4


def count_tokens(docs: DataFrame, tokenizer: str, ranks: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens, n_tokens: the segment tree of every whole text, by its leaves.

    A null or empty text has no leaves and no tokens. Ids are passed on as they are, repeated or null. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer, ranks)
        for b in batches:
            leaves = [split(t.as_py()) for t in b.column(1)]
            tokens = [[count(x) for x in some] for some in leaves]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([[len(x) for x in some] for some in leaves], pa.list_(pa.int32())),
                 pa.array(tokens, pa.list_(pa.int32())), pa.array([sum(t) for t in tokens], pa.int64())],
                ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    rows = docs.select(F.col(id).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {TREE}, n_tokens long")


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str, ranks: str) -> DataFrame:
    """Trees after edits (doc_id, seq, at, removed, inserted), applied to each document in the order of `seq`.

    Documents and edits meet sorted by id, document first, and stream through the task, so a document with very many edits costs one tree and a batch.
    Leaves that an edit touches, and a neighbour where the cut between them is gone, are encoded again; the sums above them follow.

    Null and out-of-range places are clipped, null strings are empty; equal `seq` go by place and string. Edits of unknown
    documents are left out. Of rows that share an id, the first by a hash of its text is edited, the others stay.
    Returns the columns of `trees` and n_tokens_before, n_edits, chars_encoded.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    docs = trees.select("doc_id", F.lit(0).alias("_what"), F.xxhash64("text").alias("_order"), "text", "leaf_chars", "leaf_tokens",
                        F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_removed"))
    todo = edits.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lit(1).alias("_what"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("_order"),
                        F.coalesce("inserted", F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("leaf_chars"),
                        F.lit(None).cast("array<int>").alias("leaf_tokens"), F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("_at"),
                        F.coalesce(F.col("removed").cast("long"), F.lit(0)).alias("_removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer, ranks)
        key, tree, before, edits_done, out, held = None, None, 0, 0, [], 0

        def done():
            leaves = tree.leaves
            out.append((key[0], "".join(leaves), [len(x) for x in leaves], tree.leaf_tokens(), tree.tokens, before, edits_done, tree.encoded))
            return len(out[-1][1])

        for b in batches:
            doc, what, _, text, chars, tokens, at, removed = (b.column(i) for i in range(8))
            for r in range(b.num_rows):
                now = (doc[r].as_py(),)
                if not what[r].as_py():
                    if tree is not None and now != key:
                        held += done()
                        tree = None
                    body, sizes, counts = text[r].as_py(), chars[r].as_py(), tokens[r].as_py()
                    if tree is None:
                        ends = np.cumsum([0, *sizes]).tolist()
                        key, edits_done = now, 0
                        tree = SegmentTree([body[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], counts, count)
                        before = tree.tokens
                    else:
                        out.append((now[0], body, sizes, counts, sum(counts), sum(counts), 0, 0))
                        held += len(body)
                elif tree is not None and now == key:
                    tree.edit(at[r].as_py(), removed[r].as_py(), text[r].as_py())
                    edits_done += 1
                if held > 8_000_000:
                    yield _edited(out, b.schema.field(0).type)
                    held = 0
        if tree is not None:
            done()
        if out:
            yield _edited(out, None)

    kinds = f"doc_id {kind}, {TREE}, n_tokens long, n_tokens_before long, n_edits int, chars_encoded long"
    rows = docs.unionByName(todo).repartition("doc_id").sortWithinPartitions("doc_id", "_what", "_order", "_at", "text")
    return rows.mapInArrow(run, kinds)


def _edited(rows: list[tuple], kind) -> pa.RecordBatch:
    kinds = (kind, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_tokens_before", "n_edits", "chars_encoded"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    rows.clear()
    return batch


def sample_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Three edits for each document, made from its own text: an insertion, a deletion and a replacement, at places set by a hash of the id."""
    t, n = whole(text), F.char_length(whole(text))
    place = lambda k: F.pmod(F.xxhash64(F.col(id), F.lit(k)), n + 1)
    edit = lambda seq, at, removed, inserted: F.struct(F.lit(seq).alias("seq"), at.alias("at"), removed.alias("removed"), inserted.alias("inserted"))
    some = F.array(edit(1, place(1), F.lit(0), F.substring(t, 1, 24)), edit(2, place(2), F.lit(40), F.lit("")),
                   edit(3, place(3), F.lit(7), F.reverse(F.substring(t, 1, 12))))
    return docs.select(F.col(id).alias("doc_id"), F.explode(some).alias("_e")).select("doc_id", "_e.*")
