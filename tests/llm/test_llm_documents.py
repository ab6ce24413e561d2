"""Exact and near duplicates, repeated strings and packing against brute force."""
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from visorlake.llm import exact_dedup, packing, simhash, spans, substring, suffix
from visorlake.llm.queries import OPERATORS, checks, queries, vocabulary

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, mark string, copy_key string, row string, k string, _sha string, _id string"
WORDS = "the of and to red blue green stone river".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], SCHEMA).repartition(3)


def shared(seed, n=40, longest=60, words=WORDS):
    """Documents glued from shared passages, with repeats inside and between them."""
    r = random.Random(seed)
    parts = [" ".join(r.choices(words, k=r.randint(5, longest))) for _ in range(6)]
    glue = lambda: r.choice([" ", "\n", " \t ", "  "])
    out = [(i, glue().join(r.choice(parts) if r.random() < 0.6 else " ".join(r.choices(words, k=r.randint(1, 25))) for _ in range(r.randint(1, 5)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "é ü ß 漢字 " * 40), (n + 3, "é ü ß 漢字 " * 40), (3, out[3][1]), (None, out[5][1])]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(checks()))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    result = con.execute(checks()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(f.__name__.split("_")[0][2:]) for f in OPERATORS) == list(range(1, 14))


# ---------------------------------------------------------------- exact
def test_exact_duplicates(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (2, "a  b"), (4, None), (5, ""), (None, " \n "), (6, "xé"), (None, "xé")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_points"]): r for r in got}
    assert by[1, 3]["keep_id"] == 2 and by[1, 3]["group_size"] == 4 and not by[1, 3]["kept"]
    assert sum(r["kept"] for r in got if r["doc_id"] == 2) == 1
    assert by[None, 3]["kept"] and by[4, 0]["keep_id"] is None and by[6, 2]["kept"] and not by[None, 2]["kept"]
    assert by[6, 2]["text_sha256"] == hashlib.sha256("xé".encode()).hexdigest()
    kept = exact_dedup.without_copies(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r["doc_id"], r["text"], r["kept"]) for r in kept.where("doc_id IS NOT NULL").collect()) == [(2, "a  b", "a"), (6, "xé", "a")]
    assert kept.count() == 3


def test_heavy_and_light_digests_agree(spark, monkeypatch):
    rows = frame(spark, [(i, f"t{i % 7 if i % 3 else i}") for i in range(600)])
    want = sorted(map(tuple, exact_dedup.exact_duplicates(rows).collect()))
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    monkeypatch.setattr(exact_dedup, "COUNTERS", 16)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(rows).collect())) == want


# ---------------------------------------------------------------- near
def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "A b C d", "x y z w v u É é q", "the red\x1fblue stone  the red stone"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_golay_keys_lose_no_pair():
    r = np.random.default_rng(3)
    a = r.integers(-2 ** 63, 2 ** 63, 4_000)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    stored = simhash.stored_keys(a)
    rows, keys = simhash.probe_keys(b)
    held = collections.defaultdict(set)
    for i, k in zip(rows.tolist(), keys.tolist(), strict=True):
        held[i].add(k)
    assert all(held[i] & set(stored[i].tolist()) for i in range(len(a)))
    assert len(rows) < 220 * len(a)
    table, near = simhash.near_patterns()
    weight = np.bitwise_count(table[:, 0].astype(np.uint64))
    assert weight.max() == 3 and (near >= 1).all()                             # a perfect code of radius three


def test_near_marks_equal_brute_force(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    marks = sorted({m ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for m in base for _ in range(6)})
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    got = {tuple(x) for x in simhash.near_marks(spark.createDataFrame([(m,) for m in signed], "mark long")).collect()}
    assert got == {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4}


def test_simhash_groups(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + [(900, None), (901, ""), (902, "One two")]
    marks = [slow_fingerprint(t or "") for _, t in docs]
    group = components(marks, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = collections.defaultdict(lambda: 10 ** 9)
    for (i, _), g in zip(docs, group, strict=True):
        least[g] = min(least[g], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(frame(spark, docs)).collect()}
    assert got == {i: (f"{m:016x}", least[g]) for (i, _), m, g in zip(docs, marks, group, strict=True)}
    kept = {r["doc_id"] for r in simhash.without_near_copies(frame(spark, docs)).collect()}
    assert kept == set(least.values())


# ---------------------------------------------------------------- repeated strings
def slow_windows(rows, n=20):
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, out = set(), {}
    for i, t in docs:
        w = t.encode().split()
        gone, own = set(), [tuple(w[p:p + n]) for p in range(len(w) - n + 1)]
        for p, x in enumerate(own):
            if x in seen:
                gone.update(range(p, p + n))
            seen.add(x)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def slow_bytes(rows, n=200):
    docs = {i: (t or "").encode() for i, t in rows}
    count = collections.Counter(b[p:p + n] for b in docs.values() for p in range(len(b) - n + 1))
    out = {}
    for i, b in docs.items():
        gone = [0] * (len(b) + 1)
        for p in range(len(b) - n + 1):
            if count[b[p:p + n]] > 1:
                gone[p:p + n] = [1] * n
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), len(b) - len(kept), sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [2_000_000, 700])
def test_repeated_windows(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(spans, "CHUNK_BYTES", chunk)
    rows = shared(seed, words=WORDS if seed else WORDS[:2])
    got = substring.remove_repeated_windows(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == slow_windows(rows)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [2_000_000, 900])
def test_repeated_bytes(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(spans, "CHUNK_BYTES", chunk)
    rows = shared(seed, longest=90, words=WORDS if seed else ["a", "b"])
    rows.append((777, "x" * 450))
    got = suffix.remove_repeated_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == slow_bytes(rows)


def test_segments_do_not_matter(monkeypatch):
    """Word hashes and string hashes are the same however a long text is cut to be hashed."""
    body = " ".join(random.Random(1).choices(WORDS, k=3_000)).encode()
    want = substring.word_hashes(body)[2]
    monkeypatch.setattr(substring, "SEGMENT", 100)
    assert (substring.word_hashes(body)[2] == want).all()


def test_same_id_other_text(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long + " x"), (1, long)]
    got = substring.remove_repeated_windows(frame(spark, rows)).collect()
    assert sorted(r["n_removed"] for r in got) in ([0, 0, 30], [0, 30, 30])
    assert sorted(r["n_removed"] for r in suffix.remove_repeated_bytes(frame(spark, [(1, "q" * 199), (1, long * 3), (1, long * 3)])).collect())[0] == 0


# ---------------------------------------------------------------- packing
def check_packing(docs, got, size=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want = collections.Counter()
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    ids_of = {(i, len(t.encode(text or "", add_special_tokens=False).ids) + 1): np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4") for i, text in docs}
    for r in got:
        ids = ids_of[r["doc_id"], r["doc_tokens"]][r["start"]:r["start"] + r["length"]]
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    covered = collections.Counter()
    for r in got:
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(covered[i, n] == n * sum(c for (j, m, _), c in want.items() if (j, m) == (i, n)) for i, n, _ in want)
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_packing(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (902, "a  b\n\n c <|endoftext|> d"), (902, "x"), (None, "é" * 3_000), (903, " \x1c  tab\t ")]
    got = packing.pack(frame(spark, docs), vocabulary(), vocabulary("byte_bpe_50k.tiktoken")).collect()
    check_packing(docs, got)


def test_packer_keeps_few_windows(monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 20)
    closed = []
    p = packing.LevelPacker(64, closed.append)
    r = random.Random(2)
    for i in range(3_000):
        p.add((i, 0), 0, bytes(4 * r.choice([33, 40, 50, 64, 3, 20])))
        assert p.n_open < 20 and p.n_open == sum(p.count) == sum(map(len, p.windows.values()))
    p.settle()
    sizes = collections.Counter(sum(len(ids) // 4 for _, _, ids in w) for w in closed)
    assert all(n & (n - 1) == 0 for n in sizes) and sum(sizes.values()) - sizes[64] <= 6


def test_sum_of_squares_choice():
    """The level that leaves the smallest sum of squares over all levels, full windows not counted; of equal ones the fullest."""
    def squares(count, h, n):
        after = list(count)
        after[h] -= h > 0
        after[h + n] += 1
        return sum(c * c for c in after[1:-1])

    r = random.Random(4)
    for _ in range(300):
        size = r.randint(2, 16)
        p = packing.LevelPacker(size, lambda w: None)
        p.count[1:size] = [r.choice([0, 0, 1, 2, 5]) for _ in range(size - 1)]
        for n in range(1, size):
            levels = [0, *(h for h in range(1, size - n + 1) if p.count[h])]
            least = min(squares(p.count, h, n) for h in levels)
            assert p.level_for(n) == max(h for h in levels if squares(p.count, h, n) == least)


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    files = vocabulary(), vocabulary("byte_bpe_50k.tiktoken")
    for out in (exact_dedup.exact_duplicates(none), exact_dedup.without_copies(none), simhash.simhash_groups(none), simhash.without_near_copies(none),
                substring.remove_repeated_windows(none), suffix.remove_repeated_bytes(none), packing.pack(none, *files)):
        assert out.agg(F.count(F.lit(1))).first()[0] == 0
