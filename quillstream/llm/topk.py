"""Exact top-k inner products (op4) by a three-phase uniform threshold.

A vector's score is the sum of its partial scores over groups of dimensions; for a query, each
group of each block of rows is a list. Phase 1 takes the first k entries of every list and scores
them in full: the k-th best of those is reached by k rows, so it is a safe cut-off t. Phase 2 sends
every query's t to all blocks: a row that scores t or more has a partial score of t / m or more in
one of m groups at least (were all below, their sum were), which selects the entries that suffice.
Phase 3 scores only these rows in full. Ties at the cut-off stay in.

Queries go out in blocks of at most QUERY_BLOCK rows, so what is broadcast is bounded (8 MB at 64
dimensions) however many queries there are; vectors stay where they are read. From a batch of rows
each query gets at most k results, so a query gathers k rows a batch.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component take no
part, nor do rows whose vec_id is null; vectors meet only those of their own length; rows that
repeat a vec_id: the least vector is the query, and none of them is a candidate for that id; an
empty table gives no rows; a query with fewer than k candidates returns them all; components or scores that
do not fit in 64 bits raise an error; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import kept

K = 10
SCALE = 1024
QUERY_EVERY = 100
#: Queries that go out at a time; rows scored at a time; groups of dimensions.
QUERY_BLOCK, ROWS, GROUPS = 16_384, 1024, 4
#: Sums below this are exact in float64.
EXACT = 2**53


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of scale times the components as array<bigint>, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where((F.size("embedding") > 0) & fine)
    # A product beyond the whole numbers of 64 bits can't be scored: it raises, rather than being cut to the largest.
    fits = lambda a: F.when(F.abs(a * F.lit(float(scale))) < float(2**63), F.floor(a * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component does not fit in 64 bits")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, fits).alias("v"))


def _size(x: np.ndarray) -> float:
    return max(abs(float(x.max())), abs(float(x.min()))) if x.size else 0.0


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q.T in int64, by float64 where that is exact. A sum beyond 64 bits raises, it does not wrap."""
    most = _size(x) * _size(q) * x.shape[1]
    if most < EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most < 2**61:  # room for the sum of all groups
        return x @ q.T
    exact = x.astype(object) @ q.astype(object).T
    if max(map(abs, exact.ravel()), default=0) >= 2**61:
        raise OverflowError("a score does not fit in 64 bits")
    return exact.astype(np.int64)


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a batch's rows, for each length of vector, a bounded number of rows at a time."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    v = batch.column("v")
    ends = v.offsets.to_numpy()
    lengths, flat = np.diff(ends), v.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        for i in range(0, len(at), ROWS):
            own = at[i : i + ROWS]
            yield ids[own], flat[ends[own][:, None] + np.arange(d)]


def _groups(d: int) -> list[slice]:
    m = min(GROUPS, d)
    return [slice(d * g // m, d * (g + 1) // m) for g in range(m)]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a column, ties to smaller ids; all that tie with the k-th are looked at."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _phase1(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """From every batch: each query's k best scores among the heads of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {d: np.full((len(q[0]), k), np.iinfo(np.int64).min) for d, q in queries.items()}
        seen = {d: np.zeros(len(q[0]), dtype=np.int64) for d, q in queries.items()}
        for batch in batches:
            for ids, x in _arrays(batch):
                if x.shape[1] not in queries:
                    continue
                own_ids, q = queries[x.shape[1]]
                for a in range(0, len(q), 2048):
                    part = q[a : a + 2048]
                    full = np.zeros((len(x), len(part)), dtype=np.int64)
                    head = np.zeros(full.shape, dtype=bool)
                    n = min(k + 1, len(x))  # one more, for the query's own row may be among them
                    for g in _groups(x.shape[1]):
                        p = _dot(x[:, g], part[:, g])
                        full += p
                        np.put_along_axis(head, np.argpartition(p, len(x) - n, axis=0)[len(x) - n :], True, axis=0)
                    head &= ids[:, None] != own_ids[None, a : a + 2048]
                    full[~head] = np.iinfo(np.int64).min
                    top = np.concatenate([best[x.shape[1]][a : a + 2048], full.T], axis=1)
                    best[x.shape[1]][a : a + 2048] = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
                    seen[x.shape[1]][a : a + 2048] += head.sum(axis=0)
        for d, (own_ids, _) in queries.items():
            got = seen[d] > 0
            if got.any():
                scores = [np.sort(r)[::-1][: min(k, n)] for r, n in zip(best[d][got], seen[d][got], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[got]), pa.array(scores, pa.list_(pa.int64()))], names=["query_id", "scores"])

    return run


def _phase3(queries: dict[int, tuple[np.ndarray, np.ndarray]], cutoffs: dict[int, int], k: int):
    """From every batch: each query's k best rows among those with a sufficient partial score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.iinfo(np.int64).min
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for ids, x in _arrays(batch):
                if x.shape[1] not in queries:
                    continue
                own_ids, q = queries[x.shape[1]]
                groups = _groups(x.shape[1])
                cut = np.array([cutoffs.get(int(i), least) for i in own_ids])
                share = -(-cut // len(groups))  # partial scores are whole: t / m, rounded up
                share[cut == least] = least
                for a in range(0, len(q), 2048):
                    part = q[a : a + 2048]
                    partial = [_dot(x[:, g], part[:, g]) for g in groups]
                    enough = np.logical_or.reduce([p >= share[None, a : a + 2048] for p in partial])
                    enough &= ids[:, None] != own_ids[None, a : a + 2048]
                    i, j = np.nonzero(enough)
                    score = sum(p[i, j] for p in partial)
                    keep = score >= cut[a + j]
                    i, j, score = i[keep], j[keep], score[keep]
                    if not len(j):
                        continue
                    order = np.argsort(j, kind="stable")
                    i, j, score = i[order], j[order], score[order]
                    starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
                    for s, e in zip(starts, [*starts[1:], len(j)], strict=True):
                        at = s + _first(score[s:e], ids[i[s:e]], k)
                        out.append((np.full(len(at), own_ids[a + j[s]]), ids[i[at]], score[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    rows = kept(quantized(vectors, scale), "topk-rows")
    queries = kept(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK * 2)) if n > QUERY_BLOCK else 1
    found = None
    for b in range(blocks):  # one pass over the rows for each block of queries
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r.v) for r in own}:
            some = sorted(r for r in own if len(r.v) == d)
            by[d] = (np.array([r.vec_id for r in some], dtype=np.int64), np.array([r.v for r in some], dtype=np.int64))
        heads = rows.mapInArrow(_phase1(by, k), "query_id long, scores array<long>")
        cut = heads.select("query_id", F.explode("scores").alias("s")).groupBy("query_id").agg(F.collect_list("s").alias("s"))
        cut = cut.where(F.size("s") >= k).select("query_id", F.element_at(F.sort_array("s", asc=False), k).alias("t"))
        cutoffs = {r.query_id: r.t for r in cut.collect()}
        part = rows.mapInArrow(_phase3(by, cutoffs, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
