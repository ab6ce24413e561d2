"""Sum-of-squares packing of tokenized documents into sequences of bounded length."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import whole
from visorlake.llm.tokens import FastTokenizer

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
#: Windows a task keeps open. Beyond that their pieces are cut to fill windows, as at the end of a task.
OPEN_WINDOWS = 4_096


class LevelPacker:
    """Places pieces into windows so that the sum of squared counts of partly filled windows grows least.

    `count[h]` is the number of open windows filled to `h`; `windows[h]` are those windows, each a list of
    (document, start, bytes of ids). A full window is handed to `close` at once.
    """

    def __init__(self, size: int, close):
        self.size, self.close = size, close
        self.count = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, n: int) -> int:
        """The level to put `n` ids on; 0 opens a window. Ties go to the fullest window."""
        full = self.size - n
        at = np.flatnonzero(self.count[1:full + 1]) + 1
        grow = 2 * self.count[n] + 1 if n < self.size else 0
        if not len(at):
            return 0
        cost = 2 * (self.count[at + n] - self.count[at]) + 2
        cost[at + n == self.size] -= 1
        best = len(at) - 1 - int(np.argmin(cost[::-1]))
        return int(at[best]) if cost[best] <= grow else 0

    def add(self, doc, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        if n == self.size:
            self.close([(doc, start, ids)])
            return
        h = self.level_for(n)
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
        else:
            window, self.n_open = [], self.n_open + 1
        window.append((doc, start, ids))
        if h + n == self.size:
            self.n_open -= 1
            self.close(window)
            return
        self.windows.setdefault(h + n, []).append(window)
        self.count[h + n] += 1
        if self.n_open >= OPEN_WINDOWS:
            self.settle(last=False)

    def settle(self, last: bool = True) -> None:
        """Cut the pieces of all open windows into full ones. The rest goes on in one window or, at the last, into lengths that need no padding."""
        pieces = [p for h in sorted(self.windows, reverse=True) for w in self.windows[h] for p in w]
        self.windows, self.n_open = {}, 0
        self.count[:] = 0
        left = sum(len(ids) // 4 for _, _, ids in pieces)
        aim = lambda: self.size if left >= self.size or not last else _power(left)
        target, have, window = aim(), 0, []
        for doc, start, ids in pieces:
            while ids:
                take = min(target - have, len(ids) // 4)
                window.append((doc, start, ids[:4 * take]))
                start, ids, have, left = start + take, ids[4 * take:], have + take, left - take
                if have == target:
                    self.close(window)
                    have, window = 0, []
                    target = aim()
        if window:
            self.windows[have], self.n_open = [window], 1
            self.count[have] = 1


def _power(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1) if n else 0


def pack(docs: DataFrame, tokenizer: str, ranks: str, size: int = 2048, end: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents and their places in sequences of at most `size` ids.

    A document is its ids followed by `end`. Whole windows are cut off the front of long documents, the rest is placed
    online at the fill level that keeps the squared counts of partly filled windows smallest. A task packs the
    documents it reads, in their order, holding at most `OPEN_WINDOWS` windows; what is open at the end is
    cut so that only full sequences and powers of two remain, which need no padding. Nothing is shuffled.

    A null text is empty and gives the one id `end`. Null and repeated ids are passed on, each row being packed on its
    own. An empty table gives no rows. Other columns are ignored. `size` should be a power of two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, tail = FastTokenizer(tokenizer, ranks), np.array([end], "<u4").tobytes()
        base, rows, serial = TaskContext.get().partitionId() << 40, [], 0

        def close(window) -> None:
            nonlocal serial
            at = 0
            for (doc, total), start, ids in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, base + serial, at))
                at += n
            serial += 1

        packer = LevelPacker(size, close)
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(body.as_py()) + tail
                total, step = len(ids) // 4, 4 * size
                for at in range(0, len(ids), step):
                    packer.add((doc, total), at // 4, ids[at:at + step])
            if rows:
                yield _batch(rows)
                rows.clear()
        packer.settle()
        if rows:
            yield _batch(rows)

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [p.split()[0] for p in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
