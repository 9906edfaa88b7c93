"""N-gram Jaccard join (op9) by chosen paths: texts whose five-word shingle sets have a similarity of 0.8 or more.

1. Every text becomes its set of shingle hashes, a 128-bit name of that set and a MinHash sketch, whose
   entries are tokens that similar sets share with the probability of their similarity. Texts with the same set
   are copies; from here on one set stands for all of them.
2. Chosen paths: in each of RUNS runs all sets are split by one sketch token. A bucket of more than
   SMALL sets is split again by further tokens that its own path chooses (one, or two in a quarter of
   the cases, so that a pair at the threshold keeps one common path on average), until it is small, its sets
   are too alike to be split, or after LEVELS tokens.
3. Buckets are searched by brute force on sketches of a byte an entry; large ones in blocks, every pair of
   blocks a task of its own. Sets that may be similar are joined to groups (components).
4. In each group the exact similarity of all pairs is computed from the whole shingle sets as sums of
   bits, again by pairs of blocks of bounded size. Only counts and a spanning forest leave a task,
   never the pairs.

A pair at similarity 0.8 shares a path in a run with a probability of 0.8 if buckets are small, and of about
0.8 * 0.84^2 = 0.56 after two more splits, for which runs_for() takes as many runs as miss less than 0.03 %; the
exact step also finds a pair that all runs missed if its group holds both. Tests measure the recall on buckets
beyond SMALL and BLOCK.

Defined results: words are runs of characters other than ASCII white space; a text of one to four words
is one shingle; a text without words (null, empty) is alone in its class without links; rows that repeat are
copies; a class is named by its least doc_id (null if it has none); rows that share a doc_id but not their text
are told apart by the text; an empty table gives no rows; further columns are ignored by classes() and passed on by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spread import PLACE, at_places, place, places, with_totals
from ._store import drop, kept
from ._workers import lean
from .components import components

WORDS = 5
#: Similarity of at least ABOVE / BELOW.
ABOVE, BELOW = 4, 5
SKETCH, RECALL = 64, 0.9997
#: Splits of a path at most; the share of a bucket that a split must take off for the path to go on.
LEVELS, SHRINKS = 5, 0.1
#: Sets in a bucket that is not split further; in a block of a bucket; least equal sketch entries of 64 (0.8 gives fewer once in 100,000).
SMALL, BLOCK, LEAST_EQUAL = 1024, 4096, 36
#: Sets and shingles in a block of the exact step.
EXACT_SETS, EXACT_SHINGLES = 1024, 1 << 21
#: Bytes of text that are hashed at a time (a longer text alone).
CHUNK = 1 << 20
#: Up to this many documents of groups are broadcast (about 60 bytes each).
BROADCAST_DOCS = 100_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.int64).astype(np.uint64) | np.uint64(1)


_PLACES = _random(WORDS, 11)
_MULTIPLY, _ADD = _random(SKETCH, 12), _random(SKETCH, 13)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    """The first n powers of _BASE modulo 2^64, n of 1 at least."""
    values = np.ones(1, dtype=np.uint64)
    while len(values) < n:
        values = np.concatenate([values, values * np.uint64(pow(_BASE, len(values), 1 << 64))])
    return values[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    words = np.zeros(0, dtype=np.uint64)
    if len(starts):  # a word's bytes, each times the power of its place in the word
        inside = np.flatnonzero(~space)
        place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
        words = _mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    first = np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes) + 1)])
    first[-1] = len(starts)
    out = []
    joined = np.zeros(0, dtype=np.uint64)
    if len(words) >= WORDS:
        joined = np.zeros(len(words) - WORDS + 1, dtype=np.uint64)
        for k in range(WORDS):
            joined += words[k : k + len(joined)] * _PLACES[k]
        joined = _mix(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(joined[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    start, n = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > start and n + size > CHUNK:
            yield slice(start, i)
            start, n = i, 0
        n += size
    if texts:
        yield slice(start, len(texts))


def _name(own: np.ndarray) -> bytes | None:
    return blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), set_id, n, sketch of every text; set_id is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _chunks(texts):
                sets = shingles(texts[part])
                counts = np.array([len(s) for s in sets])
                some = counts > 0
                values = np.zeros((SKETCH, len(sets)), dtype=np.uint32)
                if some.any():
                    flat = np.concatenate(sets)
                    at = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
                    for t in range(SKETCH):
                        values[t, some] = np.minimum.reduceat((flat * _MULTIPLY[t] + _ADD[t]) >> np.uint64(32), at).astype(np.uint32)
                rows = values.T.copy().view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], batch.column("h")[part], pa.array([_name(s) for s in sets], pa.binary()), pa.array(counts, pa.int64()), pa.array(list(rows), pa.list_(pa.int32()))],
                    names=["doc_id", "h", "set_id", "n", "sketch"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, set_id binary, n long, sketch array<int>")


def _streams(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of the runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new).tolist()
        for a, b in zip(at, [*at[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of each node to the first of its component, from a symmetric matrix."""
    left = near.any(axis=1)
    while left.any():
        root = int(left.argmax())
        reached = np.zeros(len(near), dtype=bool)
        reached[root] = True
        front = reached
        while front.any():
            front = near[front].any(axis=0) & ~reached
            reached |= front
        left &= ~reached
        for i in np.flatnonzero(reached):
            if i != root:
                yield root, int(i)


def runs_for(recall: float = RECALL, levels: int = 3) -> int:
    """Runs after which a pair at the threshold has met with this probability: each run keeps it with 0.8 at its first token and
    0.84 at each split after that."""
    met = 0.8 * 0.84 ** (levels - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


RUNS = runs_for()


def paths(reps: DataFrame, small: int = SMALL, levels: int = LEVELS, runs: int = RUNS) -> DataFrame:
    """bucket, members and set_id: the buckets with more than one set where paths end.

    A path ends where its bucket is small, where the last split took off less than SHRINKS (its sets are so
    alike that splitting would part only pairs that belong together), or after so many splits.
    """
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(F.lit("run"), r, F.get("sketch", r)))
    active = reps.select("set_id", F.explode(first).alias("bucket"), F.lit(None).cast("long").alias("before"))
    done = None
    for level in range(levels):
        sized = with_totals(active, "bucket", "set_id", F.count("*").alias("members")).where(F.col("members") > 1)
        rows = kept(sized.select("bucket", "members", "set_id", "before"), "jaccard-paths")
        alike = F.coalesce(F.col("members") > (1 - SHRINKS) * F.col("before"), F.lit(False))
        goes_on = (F.col("members") > small) & ~alike & F.lit(level < levels - 1)
        ends = rows.where(~goes_on).select("bucket", "members", "set_id")
        done = ends if done is None else done.union(ends)
        large = rows.where(goes_on)
        if level == levels - 1 or large.isEmpty():
            break
        # The path so far chooses the next tokens among those that no run starts with.
        large = large.join(reps.select("set_id", "sketch"), "set_id")
        token = lambda k: (F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(SKETCH - runs)) + runs).cast("int")
        child = lambda k: F.xxhash64("bucket", F.lit(k), F.get("sketch", token(k)))
        children = F.when(F.pmod(F.xxhash64("bucket", F.lit(-1)), F.lit(4)) == 0, F.array(child(0), child(1))).otherwise(F.array(child(0)))
        active = large.select("set_id", F.explode(children).alias("bucket"), F.col("members").alias("before"))
    return done


def _pairs_of_blocks(rows: DataFrame, blocks, block) -> DataFrame:
    """Rows once for each pair of blocks (i <= j) that their own block is part of."""
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(other, block).alias("i"), F.greatest(other, block).alias("j")))
    return rows.withColumn("own", block).select("*", F.inline(pairs))


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[bytes, bytes]] = []
    for (_, i, j), table in _streams(batches, ["bucket", "i", "j"]):
        if table.num_rows < 2:
            continue
        ids, own, n = table.column("set_id").to_pylist(), table.column("own").to_numpy(), table.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8).reshape(len(ids), SKETCH)
        near = np.zeros((len(ids), len(ids)), dtype=bool)
        for a in range(0, len(ids), 256):
            equal = np.zeros((len(sketch[a : a + 256]), len(ids)), dtype=np.uint8)
            for t in range(SKETCH):
                equal += sketch[a : a + 256, t, None] == sketch[None, :, t]
            part = equal >= LEAST_EQUAL
            part &= (n[a : a + 256, None] * BELOW >= n[None, :] * ABOVE) & (n[None, :] * BELOW >= n[a : a + 256, None] * ABOVE)
            if i != j:
                part &= own[a : a + 256, None] != own[None, :]
            near[a : a + 256] = part
        np.fill_diagonal(near, False)
        out.extend((ids[a], ids[b]) for a, b in _forest(near))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])


def groups(reps: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(node, component) of the sets that may be similar to another."""
    low = F.array_join(F.transform("sketch", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")), "")
    rows = paths(reps, small).join(reps.select("set_id", "n", F.unhex(low).alias("bytes")), "set_id")
    blocks = F.when(F.col("members") <= block, 1).otherwise(F.ceil(F.col("members") / block)).cast("int")
    rows = _pairs_of_blocks(rows, blocks, F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
    rows = rows.select("bucket", "i", "j", "own", "set_id", "n", "bytes").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return components(rows.mapInArrow(lean(_sketch_links), "a binary, b binary"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by bits of the shingles that two or more of them hold."""
    n = len(sets)
    which = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, which = flat[order], which[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column, counts = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(flat)))
    common = int((counts == n).sum())
    use = (counts > 1) & (counts < n)
    place = np.cumsum(use) - 1
    keep = use[column]
    which, column = which[keep], place[column[keep]]
    out = np.full((n, n), common, dtype=np.int64)
    width = 1 << 16
    for a in range(0, int(use.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        bits = np.zeros((n, width // 8), dtype=np.uint8)
        np.bitwise_or.at(bits, (which[lo:hi], (column[lo:hi] - a) >> 3), (1 << ((column[lo:hi] - a) & 7)).astype(np.uint8))
        last = -(-(int(column[hi - 1]) - a + 1) // 64) * 8
        words = np.ascontiguousarray(bits[:, :last]).view(np.uint64)
        for i in range(n):
            out[i] += np.bitwise_count(words & words[i]).sum(axis=1, dtype=np.int64)
    return out


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_id and the number of documents it is linked to, or a link of a spanning forest."""

    def rows(ids, links, other):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(links, pa.int64()), pa.array(other, pa.binary())], names=["set_id", "links", "other"])

    for (_, i, j), table in _streams(batches, ["component", "i", "j"]):
        if table.num_rows < 2:
            continue
        once = {x: k for k, x in enumerate(table.column("set_id").to_pylist())}  # rows that repeat a doc_id bring a set twice
        table = table.take(sorted(once.values()))
        ids, own, copies = table.column("set_id").to_pylist(), table.column("own").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        both = _intersections(sets)
        near = both * BELOW >= ABOVE * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(near, False)
        if i != j:
            near &= own[:, None] != own[None, :]
        links = near @ copies
        some = np.flatnonzero(links)
        if len(some):
            yield rows([ids[k] for k in some], links[some], [None] * len(some))
            forest = list(_forest(near))
            yield rows([ids[b] for _, b in forest], [None] * len(forest), [ids[a] for a, _ in forest])


def _with_shingles(rows: DataFrame) -> DataFrame:
    """Rows (text, set_id, component, copies, blocks) with the shingles in place of the text: those whose text is of that set, once a task."""
    names = ["set_id", "component", "copies", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("set_id").to_pylist()
            for part in _chunks(texts):
                sets = shingles(texts[part])
                use = []
                for s, x in zip(sets, own[part], strict=True):
                    use.append(x not in seen and _name(s) == x)
                    if use[-1]:
                        seen.add(x)
                out = pa.RecordBatch.from_arrays([*(batch.column(c)[part] for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
                yield out.filter(pa.array(use, pa.bool_()))

    return rows.select(*names, "text").mapInArrow(lean(run), "set_id binary, component binary, copies long, blocks int, shingles binary")


def _first() -> Column:
    """What orders rows: known ids first, then ids, then hashes of texts."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h"))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, h, class_id, links, _set and _rep (unknown, doc_id, h of the row that stands for the class; null without words) of every row of docs."""
    rows = kept(sketches(docs), "jaccard-docs")
    reps = rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(_first().alias("first"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), places(place("doc_id", "h")).alias("places"))
    reps = kept(reps, "jaccard-sets")
    found = kept(groups(reps).select(F.col("node").alias("set_id"), "component"), "jaccard-groups")
    # The texts of sets in groups, each to every pair of blocks of its group. A set's text is found by id and hash, so rows that share an id don't meet.
    told = found.join(reps.drop("sketch", "places"), "set_id")
    blocks = F.greatest(F.ceil(F.count("*") / EXACT_SETS), F.ceil(F.sum("n") / EXACT_SHINGLES)).cast("int")
    members = kept(with_totals(told, "component", "set_id", blocks.alias("blocks")).select("set_id", "component", "copies", "blocks", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h")), "jaccard-members")
    few = members.count() <= BROADCAST_DOCS
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = texts.join(F.broadcast(members) if few else members, (F.col("h") == F.col("rep_h")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    own = _with_shingles(texts)
    parts = _pairs_of_blocks(own, F.col("blocks"), F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    parts = parts.select("component", "i", "j", "own", "set_id", "copies", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    exact = kept(parts.mapInArrow(lean(_exact_links), "set_id binary, links long, other binary"), "jaccard-exact")
    drop(found, members)
    links = exact.where(F.col("links").isNotNull()).groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = components(exact.where(F.col("other").isNotNull()).select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    joined = joined.select(F.col("node").alias("set_id"), "component")
    linked = kept(links.join(joined, "set_id").join(reps.select("set_id", "first"), "set_id"), "jaccard-links")
    named = with_totals(linked, "component", "set_id", F.min("first").alias("_rep")).select("set_id", "links", "_rep")
    sets = reps.select("set_id", "copies", "places", "first").join(named, "set_id", "left")
    sets = sets.select("set_id", "places", F.coalesce("_rep", "first").alias("_rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    sets = kept(sets, "jaccard-classes")
    drop(exact, linked)
    # Copies are dealt over places as well; rows without words, all of one key, don't join.
    own = rows.select("doc_id", "h", "set_id", place("doc_id", "h").alias(PLACE))
    alone = own.where(F.col("set_id").isNull()).select("doc_id", "h", "set_id", F.lit(None).cast(sets.schema["_rep"].dataType).alias("_rep"), F.lit(0).cast("long").alias("links"))
    out = own.join(at_places(sets, "places"), ["set_id", PLACE]).select("doc_id", "h", "set_id", "_rep", "links").union(alone)
    class_id = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("_rep.doc_id"))
    return out.select("doc_id", "h", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("set_id").alias("_set"), "_rep")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, links (other rows with a similarity of 0.8 or more) and _set of every row of docs."""
    return _classes(docs).select("doc_id", "class_id", "links", "_set")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns: of each class one, that with the least known doc_id (of several texts under it, the least hash; of rows
    that repeat both, any); rows without words, which are alone in their class, all stay."""
    found = kept(_classes(docs).select("doc_id", "h", "_rep"), "jaccard-rows")
    known = found.where(F.col("_rep").isNotNull())
    stays = (F.col("h") == F.col("_rep.h")) & F.col("doc_id").eqNullSafe(F.col("_rep.doc_id"))
    gone = known.where(~stays).select(F.col("doc_id").alias("_d"), F.col("h").alias("_x")).distinct()
    again = kept(known.where(stays).groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_d"), F.col("h").alias("_x")), "jaccard-again")
    same = (F.col("_hash") == F.col("_x")) & F.col("_doc_id").eqNullSafe(F.col("_d"))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_hash"))
    rows = rows.join(gone, same, "left_anti")
    n = again.count()
    if n:  # rows that stay and repeat both id and text, once
        twice = F.broadcast(again) if n <= BROADCAST_DOCS else again
        rows = rows.join(twice, same, "left_anti").union(rows.join(twice, same, "left_semi").dropDuplicates(["_doc_id", "_hash"]))
    return rows.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
