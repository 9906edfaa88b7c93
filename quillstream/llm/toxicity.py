"""Toxicity scores (op6) by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (one small table of counts a task).
2. Words that look disguised are decoded: digits and symbols among letters, letters three times
   in a row, single letters set apart by spaces or dots. Every character opens a column of a
   lattice (the letters that it may stand for, or none), and Viterbi finds the likeliest spelling
   under the channel's costs and the model.
3. Features are the restored words and their first four to six letters. On a sample of labelled rows the
   documents that hold a feature are counted by label; kept are the features that are so much
   commoner with label 1 that chance does not explain it after allowing for all features tested.
4. A text's evidence is, over its distinct words, the sum of each word's strongest log-likelihood
   ratio. A logistic regression turns evidence, number of such words and length into the score, for a long
   clean text meets a rare word by chance more often than a short one.

The classifier is fitted on at most about SAMPLE labelled rows (chosen by a hash of doc_id, so the
bound holds at any size); near copies among them count once, by their least hash of three words. What reaches the
driver is bounded: the model's table of 28^3 counts, features seen in LEAST toxic rows or more, and three
numbers a sampled row.

Defined results: a null text is an empty one; a text without any such word scores what the regression says
of its length, an empty text as the shortest of the sample; without labels of both kinds every text scores FLOOR; of several labels for a doc_id the largest counts, and null labels none; a null
doc_id is never learned from, and is not held out; rows that repeat score alike; an empty table
gives no rows; further columns are ignored by score() and passed on by kept_documents().
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import kept
from ._workers import lean

#: Labelled rows that the classifier is fitted on, at most (about: rows are chosen by hash).
SAMPLE = 40_000
THRESHOLD = 0.3
FLOOR = 0.02
#: Rows of label 1 with a feature, at least; features that may be kept by luck.
LEAST, LUCK = 3, 0.5
#: Shrinks a feature's precision towards the rate of label 1, by so many rows.
PRIOR_ROWS = 4.0
LETTERS = 28  # a-z, any other letter, and what ends a word
#: What a character may stand for besides itself, with costs in nats (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "*": "aeiou", "#": "h", "%": ""}
#: Dropping a mark that may stand for a letter costs more than one that stands between letters.
COST_LOOK, COST_DROP, COST_BETWEEN, COST_REPEAT = 1.0, 5.0, 1.0, 0.5
#: Dropping a mark at either end, which may be punctuation.
COST_EDGE = 2.0
#: Marks at an end that are looked at; length up to which a token of more than two marks a letter is.
EDGE_MARKS, MOSTLY_MARKS = 3, 8
#: Characters that are dropped unseen: soft hyphen, zero-width and direction marks, byte order mark.
UNSEEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Three or more single characters set apart by one space, tab or mark.
SPACED = re.compile(r"(?<!\S)(?:[^\s][ \t]){2,}[^\s](?!\S)")
EDGE = re.compile(r"^[^\w]+|[^\w]+$|_+$|^_+")
WORDS = re.compile(r"[^\W\d_]+")
#: Marks around a word that are never letters.
PLAIN = ".,;:?'\"-)]}«»“”…"
#: Tokens that a worker remembers before it forgets them (with their features while fitting, a fourth as many), the longest it
#: remembers, and features that it counts before it hands the counts on.
MEMORY, REMEMBERED, COUNTED = 160_000, 48, 100_000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> letter code: 1 to 26 (accents dropped), 27 other letters, 0 the rest."""
    out = np.zeros(0x110000, dtype=np.int8)
    for i in range(0x3000):
        c = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        out[i] = ord(c) - 96 if "a" <= c <= "z" else 27 if chr(i).isalpha() else 0
    out[0x3000:] = 27
    return out


def _count(texts: list[str | None]) -> np.ndarray:
    table, total = letter_table(), np.zeros(LETTERS**3, dtype=np.int64)
    for i in range(0, len(texts), 500):
        joined = "\n\n".join(["", *(t for t in texts[i : i + 500] if t), ""])
        c = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
        total += np.bincount(c[:-2] * LETTERS * LETTERS + c[1:-1] * LETTERS + c[2:], minlength=LETTERS**3)
    return total


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all letter trigrams of all texts, as an array of LETTERS^3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            total += _count(batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(LETTERS**3, dtype=np.int64)
    for r in rows.collect():
        out[r.code] = r.n
    return out


class Decoder:
    """Viterbi over the lattice of a disguised word."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + LETTERS)
        pair = n.sum(axis=0)
        two = (pair + 5 * one) / (pair.sum(axis=1, keepdims=True) + 5)
        three = (n + 5 * two) / (n.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(three)).tolist()
        self.table = letter_table()

    def decode(self, word: str, core: tuple[int, int] | None = None) -> str:
        """The likeliest spelling: letters only, in lower case. core: where the word starts and ends without the marks at its edges."""
        low, high = core or (0, len(word))
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before, run = "", 0
        for at, c in enumerate(word):
            run = run + 1 if c == before else 1
            options = [(c, 0.0)] if c.isalpha() else [(x, COST_LOOK) for x in LOOKS.get(c, "")]
            skip = COST_REPEAT if c == before and c.isalpha() else None if c.isalpha() else COST_DROP if LOOKS.get(c) else COST_BETWEEN
            if not low <= at < high and skip is not None:
                skip = min(skip, COST_EDGE)
            before = c
            if run > 3 and c.isalpha():
                continue  # a fourth copy of a letter says no more than a third
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in paths.items():
                if skip is not None:
                    old = after.get((a, b))
                    if old is None or cost + skip < old[0]:
                        after[a, b] = (cost + skip, path)
                for x, more in options:
                    i = int(self.table[ord(x)]) or 27
                    total = cost + more + self.cost[a][b][i]
                    old = after.get((b, i))
                    if old is None or total < old[0]:
                        after[b, i] = (total, (x, path))
            paths = after
        _, path = min(((cost + self.cost[a][b][0], path) for (a, b), (cost, path) in paths.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


def _disguised(token: str) -> tuple[str, tuple[int, int]] | None:
    """What of a token is to be decoded, if it looks disguised, and where it stands without the marks at its edges."""
    core = EDGE.sub("", token)
    # A few marks at an end may be letters; a longer run is noise, and so are exclamation marks alone.
    head, _, tail = token.partition(core) if core else (token, "", "")
    head = head if len(head) <= EDGE_MARKS and all(c in LOOKS for c in head) else ""
    tail = tail if len(tail) <= EDGE_MARKS and all(c in LOOKS for c in tail) and tail.strip("!") else ""
    word = head + core + tail
    letters = sum(c.isalpha() for c in word)
    looks = sum(c in LOOKS for c in word)
    marks = len(word) - letters
    if letters and marks and letters + looks >= 3 and (letters >= marks / 2 or (looks == marks and len(word) <= MOSTLY_MARKS)):
        return word, (len(head), len(head) + len(core))
    return (core, (0, len(core))) if TRIPLE.search(core) else None


def _named(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) > k)]


def features_of(token: str, decoder: Decoder) -> set[str]:
    """Features of a token in lower case: of its words as they stand, and of what it decodes to."""
    if (plain := token.strip(PLAIN)).isalpha() and not TRIPLE.search(plain):  # most tokens: one word as it stands
        return set(_named(plain)) if len(plain) > 1 else set()
    token = UNSEEN.sub("", token)
    out = {f for w in WORDS.findall(token) if len(w) > 1 for f in _named(w)}
    found = _disguised(token)
    if found is not None and len(restored := decoder.decode(*found)) > 1:
        out.update(_named(restored))
    return out


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text in lower case; letters set apart are joined to one more token each."""
    text = text.lower()
    return {*text.split(), *("".join(m.group().split()) for m in SPACED.finditer(text))}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _least_shingle(text: str) -> int:
    from hashlib import blake2b

    w = text.lower().split()
    return min(int.from_bytes(blake2b(" ".join(w[i : i + 3]).encode("utf-8", "replace"), digest_size=7).digest(), "big") for i in range(max(1, len(w) - 2)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text of the sampled labelled rows, copies and near copies once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > sample:  # xxhash64 is even over the long range, so about `sample` rows pass
        known = known.where(F.xxhash64("doc_id", F.lit(6)) <= int(-(2**63) + 2**64 * (sample / n)))
    known = F.broadcast(known)  # at most about `sample` rows of two numbers

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("least", pa.array([_least_shingle(t or "") for t in batch.column("text").to_pylist()], pa.int64()))

    rows = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("h"))
    schema = T.StructType([*rows.schema.fields, T.StructField("least", T.LongType())])
    rows = kept(rows.mapInArrow(lean(least), schema), "toxicity-rows")
    # Of rows that repeat an id one text counts, so there are no more rows than ids known.
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("least", "h")).alias("m")).select("doc_id", "toxic", "m.*")
    one = one.groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "h")).alias("m")).select("m.*")
    return rows.join(F.broadcast(one), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")


def _tail(n: int, t: int, p: float) -> float:
    """Chance of t or more of n at rate p, in logs from its largest term."""
    log = math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1) + t * math.log(p) + (n - t) * math.log1p(-p)
    ratio = (n - t) * p / ((t + 1) * (1 - p))
    return math.exp(log) / (1 - ratio) if ratio < 1 else 1.0


def fit(rows: DataFrame, counts: np.ndarray) -> dict[str, float]:
    """Log-likelihood ratio of each feature that speaks for label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, by = Decoder(counts), (Counter(), Counter())
        memory: dict[str, set[str]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            names = list({*by[0], *by[1]})
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "replace").decode() for x in part]), pa.array([by[1][x] for x in part], pa.int64()), pa.array([by[0][x] for x in part], pa.int64())], names=["feature", "t", "c"])
            by[0].clear()
            by[1].clear()

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own: set[str] = set()
                for t in tokens_of(text or ""):
                    if (found := memory.get(t)) is None:
                        found = features_of(t, decoder)
                        if len(t) <= REMEMBERED:
                            memory[t] = found
                    own |= found
                by[toxic > 0].update(own)
                if len(memory) > MEMORY // 4:
                    memory.clear()
                if len(by[0]) + len(by[1]) > COUNTED:
                    yield from told()
        yield from told()

    sums = {bool(r.toxic): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sums) < 2:
        return {}
    rate = sums[True] / (sums[True] + sums[False])
    found = kept(rows.mapInArrow(lean(run), "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-features")
    # A feature of few rows can't reach a small chance, so it does not count as tested.
    sizes = {r.n: r.k for r in found.groupBy((F.col("t") + F.col("c")).alias("n")).agg(F.count("*").alias("k")).collect()}
    least = LEAST
    while rate**least * sum(k for n, k in sizes.items() if n >= least) > LUCK and least < 1000:
        least += 1
    tested = max(1, sum(k for n, k in sizes.items() if n >= least))
    out = {}
    for r in found.where((F.col("t") >= least) & (F.col("t") > 2 * rate * (F.col("t") + F.col("c")))).collect():
        n = r.t + r.c
        p = (r.t + PRIOR_ROWS * rate) / (n + PRIOR_ROWS)
        if p >= THRESHOLD and _tail(n, r.t, rate) * tested <= LUCK:
            out[r.feature] = math.log((r.t + 0.5) / (sums[True] + 1) * (sums[False] + 1) / (r.c + 0.5))
    return out


def _inputs(evidence: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the regression sees of texts."""
    size = np.log1p(words) - 5
    return np.stack([np.ones(len(words)), evidence, np.log1p(hits), size, np.where(hits > 0, size, 0.0), np.log((hits + 0.05) / (words + 50)) + 7], axis=1)


def regress(evidence: np.ndarray, hits: np.ndarray, words: np.ndarray, toxic: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of _inputs() by Newton steps with a ridge."""
    x, y = _inputs(evidence, hits, words), toxic.astype(float)
    w = np.zeros(x.shape[1])
    cost = np.full(len(w), ridge)
    cost[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + np.diag(cost), x.T @ (y - p) - cost * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Line(NamedTuple):
    """The regression's weights, and the least and most words of a sampled text: others count as these, for nothing is known beyond."""

    weights: np.ndarray
    low: float
    high: float

    def scores(self, evidence: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = _inputs(evidence, hits, np.clip(words, self.low, self.high))
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(axis=1), -30, 30)))


def calibrate(rows: DataFrame, weights: dict[str, float], counts: np.ndarray) -> Line | None:
    """The regression from the sampled rows; None if they hold one label only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(weights, None, counts)
        for batch in batches:
            found = [own.evidence(t) for t in batch.column("text").to_pylist()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c, pa.float64()) for c in columns)], names=["toxic", "e", "h", "n"])

    got = sorted(rows.mapInArrow(lean(run), "toxic int, e double, h double, n double").collect())  # in one order, so that sums agree
    toxic, e, h, n = (np.array([float(r[i]) for r in got]) for i in range(4))
    toxic = toxic > 0
    return Line(regress(e, h, n, toxic), float(n.min()), float(n.max())) if toxic.any() and not toxic.all() else None


class Scorer:
    """Scores of texts; remembers tokens that it has seen."""

    def __init__(self, weights: dict[str, float], line: Line | None, counts: np.ndarray):
        self.weights, self.line, self.decoder = weights, line, Decoder(counts)
        self.seen: set[str] = set()
        self.flagged: dict[str, float] = {}
        #: The first letters of all features; a plain word that starts otherwise has none of them.
        self.starts = {f.rstrip("-")[:4] for f in weights}

    def ratio(self, token: str) -> float | None:
        """The strongest ratio of a token's features."""
        plain = token.strip(PLAIN)
        if plain[:4] not in self.starts and plain.isalpha() and not TRIPLE.search(plain):
            return None
        return max((self.weights[f] for f in features_of(token, self.decoder) if f in self.weights), default=None)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Sum of ratios, number of distinct words that have one, and number of words."""
        text = text or ""
        tokens = tokens_of(text)
        found = [self.flagged[t] for t in tokens & self.flagged.keys()]
        for t in tokens - self.seen:
            if (ratio := self.ratio(t)) is not None:
                found.append(ratio)
            if len(t) <= REMEMBERED:
                self.seen.add(t)
                if ratio is not None:
                    self.flagged[t] = ratio
        found.sort()
        if len(self.seen) > MEMORY:
            self.seen.clear()
            self.flagged.clear()
        return float(sum(found)), float(len(found)), float(len(text.split()))

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.line is None:
            return [FLOOR] * len(texts)
        e, h, n = np.array([self.evidence(t) for t in texts]).reshape(-1, 3).T
        return self.line.scores(e, h, n).tolist()


Model = tuple[dict[str, float], "Line | None", np.ndarray]


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Feature weights, the regression and the trigram counts."""
    counts = character_counts(docs)
    rows = kept(training_rows(docs, labels, sample), "toxicity-sample")
    weights = fit(rows, counts)
    return weights, calibrate(rows, weights, counts), counts


def with_score(docs: DataFrame, fitted: Model, name: str = "score") -> DataFrame:
    """docs with one column more."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*fitted)
        for batch in batches:
            scores = pa.array(own.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(run), schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    out = with_score(docs.select("doc_id", "text"), model(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    name = next(f"_score{i}" for i in range(len(docs.columns) + 1) if f"_score{i}" not in docs.columns)
    return with_score(docs, model(docs, labels, sample), name=name).where(F.col(name) < THRESHOLD).drop(name)
