"""Toxicity scores after restoring disguised words with a noisy-channel decoder."""
from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.llm.common import whole
from visorlake.session import settle

#: The letters that a look-alike character may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "µ": "u"}
#: Characters set between letters to split a word.
SPLITTERS = "._-*~ "
#: Symbols of the language model: 0 for a boundary, 1-26 for a-z, 27 for any other letter.
SYMBOLS = 28
#: At most so many labelled documents are used to fit, chosen by a hash of their id.
FIT_ROWS = 20_000
#: At most so many word features, the most telling ones, form the lexicon.
LEXICON = 20_000
CACHED = 150_000
PREFIXES = (4, 5, 6)
STRONGEST = 4


# ---------------------------------------------------------------- language model
def _symbol_table() -> np.ndarray:
    """Symbol of each UTF-8 byte; the bytes after the first of a longer character are 255."""
    t = np.zeros(256, np.uint8)
    for i, c in enumerate(string.ascii_lowercase):
        t[ord(c)] = t[ord(c.upper())] = i + 1
    t[0x80:0xC0], t[0xC0:] = 255, 27
    return t


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Letter trigrams of all whole texts, (28, 28, 28). Each task sends at most 21,952 sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _symbol_table(), np.zeros(SYMBOLS ** 3, np.int64)
        for b in batches:
            for t in b.column(0):
                s = of[np.frombuffer(b"  %s  " % t.as_py().encode(), np.uint8)]
                s = s[s != 255].astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(whole(text).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS ** 3)
    for r in rows:                                                             # at most 28 ** 3
        out[r["gram"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed towards the pair and single counts."""
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0) + 5 * (one / one.sum())
    three = counts + 5 * (two / two.sum(1, keepdims=True))
    return np.log(three / three.sum(2, keepdims=True))


# ---------------------------------------------------------------- noisy channel
DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W\d_][0-9@$!|+€£(µ._\-*~]|.*[0-9@$!|+€£(µ][^\W\d_]|.*(.)\1\1)")
PAIR = re.compile(r"([^\W\d_])(?<!\1\1)\1(?!\1)")
#: Up to so many pairs of a token of letters are shortened in every combination, more by the letter model.
FEW_PAIRS = 2
#: A letter or look-alike on its own, with or without punctuation beside it; a spaced word is a run of them, splitters between them or not.
SINGLE = r"[^\w\s@$!|+€£(µ]*[\w@$!|+€£(µ](?:[^\w\s@$|+€£(µ])*"
SPACED = re.compile(rf"(?<!\S){SINGLE}(?:(?:\s+[._*~\-]+)*\s+{SINGLE}){{2,}}(?!\S)")
BESIDE = re.compile(r"[^\w\s@$!|+€£(µ._*~\-]|(?<=\w)!+(?= |\Z)")
#: A run of more single characters is cut into pieces of so many, each half over the one before.
PIECE = 64


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


@lru_cache(10_000)
def _readings(c: str, n: int, pairs: bool) -> tuple[tuple[str, float, tuple[int, ...]], ...]:
    """What a run of n equal characters may stand for: letters, the cost of reading it so, and their symbols."""
    letters = c if c.isalpha() else LOOK_ALIKES.get(c, "")
    price = 0.0 if c.isalpha() else -0.7 * n
    options = [("", -0.3 * n if c in SPLITTERS else -4.0 * n)] if not c.isalpha() else []
    for a in letters:
        options += [(a * k, price - 0.5 * (n != k)) for k in ({1, 2} if n > 2 - pairs else {n})]
    if c == " ":
        options.append((" ", 0.0))
    return tuple((more, cost, tuple(map(_symbol, more))) for more, cost in options)


def restore(token: str, lm: list, pairs: bool = False) -> str:
    """The likeliest plain word behind a lower-case token: Viterbi over the lattice of look-alikes, splitters and repeats.

    A blank is a splitter or the end of a word, so a run of single characters may give several words. With `pairs`, runs of two may
    be shortened as well.

    The state is the last two symbols. A letter passes for free; reading a look-alike as a letter, dropping a splitter and shortening a
    run cost a little each; a character that is none of these must be dropped at a price.
    """
    states = {(0, 0): (0.0, "")}
    for c, run in groupby(token):
        options = _readings(c, sum(1 for _ in run), pairs)
        then: dict = {}
        for (a, b), (score, word) in states.items():
            for more, cost, symbols in options:
                s, x, y = score + cost, a, b
                for z in symbols:
                    s += lm[x][y][z]
                    x, y = y, z
                if (x, y) not in then or then[x, y][0] < s:
                    then[x, y] = (s, word + more)
        states = then
    ends = [(s + lm[a][b][0], w) for (a, b), (s, w) in states.items()]
    return max(ends)[1] if ends else ""


def plain_words(token: str, lm: list) -> tuple[str, ...]:
    """A lower-case token without outer punctuation and, if it looks disguised, the words restored from it.

    Of a run of single characters, the words that are only found if some of its blanks are ends of words.
    """
    if " " in token:
        joined = plain_words(token.replace(" ", ""), lm)
        return tuple(dict.fromkeys(w for w in restore(token, lm).split() if len(w) > 2 and w not in joined))
    bare = token.strip(string.punctuation)
    words = [bare] if bare else []
    disguised, at = DISGUISED.match(token), [m.start() for m in PAIR.finditer(bare)]
    if disguised and bare.isalpha() and not DISGUISED.match(bare) and not LOOK_ALIKES.keys() & set(token.replace(bare, "", 1)):
        plain = True                                                           # the lattice has one way through, and it gives `bare`
    else:
        plain = not disguised
    if not disguised and len(at) <= FEW_PAIRS:
        for k in at[::-1]:
            words += [w[:k] + w[k + 1:] for w in words]                        # from the end, so the places before stay
        return tuple(words[:1] + [w for w in words[1:] if len(w) > 2])
    for pairs in [False] * (not plain) + [True] * bool(at):
        found = restore(token, lm, pairs)
        if len(found) > 2 and found not in words:
            words.append(found)
    return tuple(words)


def features(word: str) -> list[str]:
    return [f"={word}"] + [word[:k] for k in PREFIXES if len(word) >= k]


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, and runs of single characters set apart by white space as one token each, without and with blanks."""
    low = text.lower()
    found = set(low.split())
    for m in SPACED.finditer(low):
        run = m[0].split()
        for k in range(0, max(1, len(run) - PIECE // 2), PIECE // 2):
            piece = BESIDE.sub("", " ".join(run[k:k + PIECE]))
            if any(map(str.isalpha, piece)):
                found.update((piece, piece.replace(" ", "")))
    return found


# ---------------------------------------------------------------- model
@dataclass
class Model:
    """The letter model, the weight of each lexicon feature and the coefficients of the final logistic step."""
    lm: np.ndarray
    weights: dict[str, float]
    beta: np.ndarray

    def reader(self):
        lm, known = self.lm.tolist(), self.weights.get

        @lru_cache(CACHED)
        def weight(token: str) -> float:
            most = 0.0
            for word in plain_words(token, lm):
                most = max(most, known("=" + word, 0.0))
                for k in PREFIXES[:max(0, len(word) - PREFIXES[0] + 1)]:
                    most = max(most, known(word[:k], 0.0))
            return most
        return weight


def evidence(text: str, weight) -> list[float]:
    """What the final step sees: the strongest weights of distinct tokens, and how many weigh more than 2."""
    ws = sorted((w for w in map(weight, tokens(text)) if w > 0), reverse=True)
    top = (ws[:STRONGEST] + [0.0] * STRONGEST)[:STRONGEST]
    return [1.0, *top, math.log1p(sum(w > 2 for w in ws))]


def held_out(id: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))), F.lit(folds)) == fold


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    return np.log((toxic + 0.25) / (n_toxic + 1)) - np.log((clean + 0.25) / (n_clean + 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton steps for a ridge logistic regression on a bounded sample."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that are not held out; the letter model counts every document.

    Labels enter as (id, label) only; several labels of an id count as toxic if one says so, null labels and ids are left out.
    Feature counts are summed in Spark; the driver gets `LEXICON` of them and six numbers per fitting document.
    The final step is fitted on weights that were learned from the other half of the documents.
    """
    lm = language_model(trigram_counts(docs, text))
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").alias("_fit_id")).agg(F.max(F.col(label).cast("int")).alias("_toxic")))
    chosen = settle(known.orderBy(F.xxhash64("_fit_id"), "_fit_id").limit(rows))
    used = settle(docs.select(F.col(id).alias("_id"), whole(text).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_fit_id"))
                  .select("_toxic", F.pmod(F.xxhash64("_fit_id", F.lit(7)), F.lit(2)).cast("int").alias("_half"), "text"))

    def spell(batches):
        table = lm.tolist()
        words = lru_cache(CACHED)(lambda t: tuple(f for w in plain_words(t, table) for f in features(w)))
        for b in batches:
            for toxic, half, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = sorted({f for t in tokens(body.as_py()) for f in words(t)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32()),
                                                  pa.array([half] * len(found), pa.int32())], ["feature", "toxic", "half"])

    sizes = {(r["_toxic"], r["_half"]): r["n"] for r in used.groupBy("_toxic", "_half").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda toxic, halves: sum(sizes.get((toxic, h), 0) for h in halves)
    cells = [F.sum(((F.col("toxic") == t) & (F.col("half") == h)).cast("long")).alias(f"n{t}{h}") for t in (0, 1) for h in (0, 1)]
    t, c = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    gain = F.log((t + 0.25) / (size(1, (0, 1)) + 1)) - F.log((c + 0.25) / (size(0, (0, 1)) + 1))
    found = (used.select("_toxic", "_half", "text").mapInArrow(spell, "feature string, toxic int, half int").groupBy("feature").agg(*cells)
             .where(t >= 2).withColumn("_gain", gain * F.sqrt(t)).where(gain > 0.5)
             .orderBy(F.desc("_gain"), "feature").limit(LEXICON).collect())
    names = [r["feature"] for r in found]
    n = {k: np.array([r[k] for r in found], float) for k in ("n00", "n01", "n10", "n11")}

    def weights(halves) -> dict[str, float]:
        toxic, clean = sum(n[f"n1{h}"] for h in halves), sum(n[f"n0{h}"] for h in halves)
        odds = _log_odds(toxic, clean, size(1, halves), size(0, halves))
        return {f: w for f, w, k in zip(names, odds.tolist(), toxic.tolist(), strict=True) if w > 0 and k >= 2}

    other = [Model(lm, weights((1 - h,)), np.zeros(0)) for h in (0, 1)]

    def measure(batches):
        readers = [m.reader() for m in other]
        for b in batches:
            rows = [evidence(body.as_py(), readers[h]) for h, body in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    seen = used.select("_toxic", "_half", "text").mapInArrow(measure, "toxic int, x array<double>").collect()   # at most `rows`
    x = np.array([r["x"] for r in seen]).reshape(-1, STRONGEST + 2)
    y = np.array([r["toxic"] for r in seen], float)
    beta = _logistic(x, y) if 0 < y.sum() < len(y) else np.array([-6.0] + [1.0] * (STRONGEST + 1))
    return Model(lm, weights((0, 1)), beta)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from `threshold` on) of every whole text.

    A row per input row, repeated rows included; null and empty texts are scored like any text without words. A null id is
    hashed as an empty text. An empty table gives none; other columns are ignored. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)                     # at most LEXICON weights

    def run(batches):
        m = sent.value
        weight = m.reader()
        for b in batches:
            x = np.array([evidence(t.as_py(), weight) for t in b.column(2)]).reshape(-1, STRONGEST + 2)
            p = 1 / (1 + np.exp(-np.clip(x @ m.beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id).alias("doc_id"), held_out(id).alias("held_out"), whole(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with their columns; the texts are scored where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        weight = m.reader()
        for b in batches:
            at = b.schema.get_field_index(text)
            x = np.array([evidence(t.as_py() or "", weight) for t in b.column(at)]).reshape(-1, STRONGEST + 2)
            p = 1 / (1 + np.exp(-np.clip(x @ m.beta, -30, 30)))
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
