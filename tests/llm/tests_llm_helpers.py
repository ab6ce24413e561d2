"""Brute force that several tests share."""
from __future__ import annotations

import collections

from visorlake.llm.queries import vocabulary


def near_groups(marks: list[tuple[int, int]], most: int = 4) -> set[int]:
    """The smallest id of each component of fingerprints within `most` bits."""
    parent = {i: i for i, _ in marks}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, m) in enumerate(marks):
        for j, n in marks[:a]:
            if bin(m ^ n).count("1") <= most:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {find(i) for i, _ in marks}


def packed_whole(docs: list[tuple], pieces: list, size: int = 2048) -> None:
    """Every id of every document lies in one piece, sequences have no gap and none is too long."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    length = {i: len(t.encode(text or "", add_special_tokens=False).ids) + 1 for i, text in docs}
    own, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        own[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in length.items():
        assert _end(own[i]) == n
    assert all(_end(x) <= size for x in fill.values()) and set(own) == set(length)


def _end(spans: list[tuple[int, int]]) -> int:
    at = 0
    for start, n in sorted(spans):
        assert start == at
        at += n
    return at
