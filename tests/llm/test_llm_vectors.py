"""Whitening, prefix trie and top-k search against brute force."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visorlake.llm import prefix_trie, top_k, whitening
from visorlake.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score string, uid string, component string, n string"
TURNS = "conv_id long, turn long, role string, text string, pos string, n string, path string, depth string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], VECTORS).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def filled(v, dims):
    return [np.float32(x) for x in v] + [0.0] * (dims - len(v))


# ---------------------------------------------------------------- eigenvectors, whitening
@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["any", "covariance", "two values", "close values", "diagonal", "zero"])
def test_eigenvectors(n, kind):
    r = np.random.default_rng(n)
    turn = np.linalg.qr(r.standard_normal((n, n)))[0]
    a = {"any": lambda: r.standard_normal((n, n)), "covariance": lambda: np.cov(r.standard_normal((n, 5 * n))).reshape(n, n),
         "two values": lambda: turn @ np.diag([1.0] * (n // 2) + [3.0] * (n - n // 2)) @ turn.T,
         "close values": lambda: turn @ np.diag(1 + 1e-9 * np.arange(n)) @ turn.T, "diagonal": lambda: np.diag(r.integers(-3, 4, n).astype(float)),
         "zero": lambda: np.zeros((n, n))}[kind]()
    a = (a + a.T) / 2
    e, v = whitening.eigenvectors(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size)
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-12 and np.abs(a @ v - v * e).max() < 1e-11 * size and (np.diff(e) <= 1e-12 * size).all()


def test_polar_factor_is_the_sign():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((30, 30)))[0]
    signs = np.where(np.arange(30) % 3, 1.0, -1.0)
    a = q @ np.diag(signs * np.geomspace(1e-9, 1, 30)) @ q.T
    assert np.abs(whitening.polar_factor(a) - q @ np.diag(signs) @ q.T).max() < 1e-5
    a = q @ np.diag(signs * np.geomspace(1e-3, 1, 30)) @ q.T
    assert np.abs(whitening.polar_factor(a) - q @ np.diag(signs) @ q.T).max() < 1e-11


def slow_whitening(rows, components=32):
    kept = [(i, v) for i, v in rows if usable(v)]
    dims, n = max(len(v) for _, v in kept), len(kept)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in filled(v, dims)] for _, v in kept]
    s = [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[a - b / n for a, b in zip(r, s, strict=True)] for r in x])
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return [(i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)), w, v) for (i, _), r, y in zip(kept, x, centred, strict=True)
            for k, (w, v) in enumerate(zip(y @ q / np.sqrt(np.where(e > 1e-9, e, 1)), e / np.trace(cov), strict=True))]


def same_whitening(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[3], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    by = collections.defaultdict(list)
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - w[5]) <= 1e-4 * w[5] + 1e-12 and g[6] < 1e-4
        by[g[1]].append((g[4], w[4]))
    for pairs in by.values():
        a, b = np.array(pairs).T
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7)


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    same_whitening(queries()["op11_whitening"](spark, FOLDER).collect(), slow_whitening(rows))


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, (100 * r.standard_normal(4) * [1, 2, 4, 8]).tolist()) for i in range(60)]
    rows += [(100, None), (101, [None, 1.0]), (102, [math.nan]), (103, [math.inf, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (104, [7.0]), (105, []), rows[3]]
    same_whitening(whitening.whiten(vectors(spark, rows)).collect(), slow_whitening(rows))
    same_whitening(whitening.whiten(vectors(spark, rows), components=2).collect(), slow_whitening(rows, 2))


def test_whitening_without_variance(spark):
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 1.0, 2.0]) for i in range(9)])).collect()
    assert len(flat) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["identity_error"] < 1e-9
    assert {r["explained"] for r in flat if r["component"] > 1} == {0.0}
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0)] * 2
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0 and whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    got = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert {r["vec_id"]: r["deviation"] for r in got}[1] is None and len(got) == 6


# ---------------------------------------------------------------- top k
def slow_top(rows, asked, k=5):
    kept = [(i, v) for i, v in rows if usable(v) and i is not None]
    dims = max((len(v) for _, v in kept), default=0)
    whole = [[math.floor(256 * float(c)) for c in filled(v, dims)] for _, v in kept]
    out = []
    for a, (i, _) in enumerate(kept):
        if asked(i):
            best = sorted((-sum(x * y for x, y in zip(whole[a], w, strict=True)), j) for b, ((j, _), w) in enumerate(zip(kept, whole, strict=True)) if a != b)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_of_odd_rows(spark, monkeypatch):
    r = np.random.default_rng(6)
    for block, group in ((16_384, 20_000), (17, 6)):
        monkeypatch.setattr(top_k, "BLOCK", block)
        monkeypatch.setattr(top_k, "QUERY_BLOCK", group)
        rows = [(i, r.integers(-2, 3, 5).astype(float).tolist()) for i in range(150)]                 # many ties
        rows += [(200, None), (250, [None, 1.0]), (300, [math.nan]), (None, [9.0] * 5), (350, [1.0]), (400, []), rows[0], rows[100], (3, [1e6] * 5), (450, [1e6, 0.0, -1e6])]
        got = top_k.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
        assert sorted(map(tuple, got)) == slow_top(rows, lambda i: i % 50 == 0)
    few = vectors(spark, [(0, [1.0]), (50, [2.0]), (7, [-1.0])])
    assert sorted(map(tuple, top_k.exact_top_k(few, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 50, 131072), (0, 2, 7, -65536), (50, 1, 0, 131072), (50, 2, 7, -131072)]
    none = top_k.exact_top_k(few.limit(0), F.col("vec_id") % 50 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert top_k.exact_top_k(few, F.col("vec_id") < 0).count() == 0


def test_members_are_a_superset_of_the_best():
    r = np.random.default_rng(7)
    for dims, n, step in ((1, 40, 8), (3, 300, 4), (64, 3_000, 32)):
        block = np.floor(r.standard_normal((n, dims)) * 32).astype(np.int64)
        index = top_k.ImpactIndex(block, step)
        for own in (-1, 5):
            for q in (block[5], -block[7], np.zeros(dims, np.int64)):
                scores = block @ q
                if own >= 0:
                    scores[own] = -10 ** 9
                best = np.sort(scores)[::-1][4]
                for known in (None, int(best), int(best) - 50):
                    assert set(np.flatnonzero(scores >= best)) - {own} <= set(index.members(q, 5, known, own))
    assert len(index.members(block[9], 5, int((block @ block[9]).max()), -1)) < n / 4


# ---------------------------------------------------------------- prefix trie
def slow_trie(rows, every=20):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    built = {c: turns.get(c - int(math.fmod(c, every)), [])[:h[c]] + turns[c][h[c]:] for c in turns}
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        own_saved = (len(members[p]) - 1) * words
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own_saved + sum(below[k][1] for k in kids[p]))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def check_trie(spark, rows):
    frame = spark.createDataFrame([(*r, *"abcd") for r in rows], TURNS).repartition(5)
    got = sorted(map(tuple, prefix_trie.conversation_trie(frame).collect()))
    assert got == slow_trie(rows)
    return got


def conversations(seed, n=120, longest=9):
    r = random.Random(seed)
    say = lambda: r.choice(["yes", "no it is", " a\tb  c ", "", None, "é ü"])
    rows = [(c, t, r.choice(["user", "bot"]), say()) for c in r.sample(range(-30, 2 * n), n) for t in range(r.randint(1, longest))]
    rows += [(5_000, t, None, None) for t in (3, None, 1)] + [(5_001, 1, "user", "x"), (5_001, 1, "user", "x"), (5_001, 1, "bot", None), (None, 1, "user", "x")]
    return rows + [(c, t, "user", f"same {t}") for c in range(6_000, 6_300) for t in range(3)]


@pytest.mark.parametrize("narrow, block, segment, piece", [(1_000, 100_000, 16, 10), (0, 0, 3, 2), (40, 60, 2, 4), (130, 1, 16, 10)])
def test_trie_equals_brute_force(spark, monkeypatch, narrow, block, segment, piece):
    monkeypatch.setattr(prefix_trie, "NARROW", narrow)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SLICE", 2 * segment)
    monkeypatch.setattr(prefix_trie, "ID_PIECE", piece)
    check_trie(spark, conversations(segment))


def test_trie_of_one_very_long_conversation(spark):
    rows = [(20, t, "user", f"w{t} x") for t in range(6_000)] + [(21, t, "user", f"w{t} x") for t in range(5_000)] + [(c, 0, "bot", "z") for c in (23, 40, 41)]
    got = check_trie(spark, rows)
    assert max(r[1] for r in got) == 6_000


def test_turnless_and_empty(spark):
    only = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 == 3][:3]
    got = check_trie(spark, [(c, 0, "user", "gone") for c in only])                  # their own turns are dropped, nothing takes their place
    assert [r[:2] for r in got] == [(min(only), 0)] and got[0][3] == 3
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(none).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", *"abcd")], TURNS)).count() == 0


def test_steps_cover_every_level_once():
    r = random.Random(2)
    for _ in range(50):
        lengths = sorted({r.randint(0, 300): r.choice([1, 5, 400, 2_000]) for _ in range(r.randint(1, 20))}.items(), reverse=True)
        steps = list(prefix_trie._steps(lengths))
        assert [d for low, high, _ in steps for d in range(high, low, -1)] == list(range(lengths[0][0], 0, -1))
        for low, high, narrow in steps:
            longer = [sum(c for n, c in lengths if n >= d) for d in range(low + 1, high + 1)]
            assert all(x <= prefix_trie.NARROW for x in longer) and (sum(longer) <= prefix_trie.BLOCK_TURNS or high == low + 1) if narrow else low // 16 == (high - 1) // 16
