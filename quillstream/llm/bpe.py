"""Byte-level BPE encoding and decoding (op8).

A text splits into pieces by the tokenizer's pattern; each distinct piece of a batch is encoded
once. Pieces of similar length share a matrix of token ids, one row a piece, padded on the right.
In each round every row merges its leftmost pair of least rank: the ranks of all neighbours
come from one lookup in a hashed pair table, the rows' least columns from one argmin, and the matrix is
compacted by shifting what lies right of each merge. Rows without a pair to merge leave the matrix.

A row needs a round for each merge, so a matrix costs the square of its length. Pieces of more than
LONG bytes (there is no bound on a run of letters) therefore merge by a heap of pairs in the same
order, in n log n.

Defined results: a null text is an empty one; an empty text has no tokens, and digests of no bytes;
equal texts have equal tokens; an empty table gives no rows; further columns are ignored by digests()
and passed on by encoded().
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._workers import lean

#: Bytes from which a piece merges by a heap; cells of one matrix; pieces that a worker remembers, and the characters of the longest.
LONG, CELLS, MEMORY, REMEMBERED = 256, 1 << 19, 1 << 17, 32
#: Characters of text that a worker encodes at a time.
CHUNK = 1 << 20
NONE = np.int64(1) << 40


class Codec:
    """Encoder and decoder for a rank file and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self._build_pairs()
        self.seen: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)

    def _build_pairs(self) -> None:
        """Open addressing: slot of a pair of ids -> rank of their joined bytes, for every way to split a token in two tokens."""
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int64)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):  # each pass places one key in each free slot
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            place = todo[free]
            _, first = np.unique(slot[place], return_index=True)
            place = place[first]
            self.keys[slot[place]], self.values[slot[place]] = keys[place], values[place]
            todo = np.setdiff1d(todo, place, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(29)).astype(np.int64)) & self.mask

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none."""
        keys = (a << 32) | b
        out = np.full(keys.shape, NONE, dtype=np.int64)
        at, slot = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel()), None
        keys, flat = keys.ravel(), out.ravel()
        slot = self._slot(keys[at])
        for _ in range(self.probes):
            if not len(at):
                break
            there = self.keys[slot]
            hit = there == keys[at]
            flat[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            at, slot = at[go], (slot[go] + 1) & self.mask
        return flat.reshape(out.shape)

    def _matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces of similar length."""
        width = max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, dtype=np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list[tuple[int, ...]] = [()] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ranks.shape[1]:
                col = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), col]
                done = best == NONE
            else:
                done = np.ones(len(rows), dtype=bool)
            for i in np.flatnonzero(done):
                out[rows[i]] = tuple(ids[i, : lengths[i]].tolist())
            if done.all():
                break
            if done.any():
                go = ~done
                ids, ranks, rows, lengths, col, best = ids[go], ranks[go], rows[go], lengths[go], col[go], best[go]
            at = np.arange(len(rows))
            ids[at, col] = best
            lengths -= 1
            width = ids.shape[1]
            source = np.arange(width - 1) + (np.arange(width - 1) > col[:, None])  # drops the column right of the merge
            ids = np.take_along_axis(ids, source, axis=1)
            if width < 3:
                ranks = np.empty((len(rows), 0), dtype=np.int64)
                continue
            gone = np.minimum(col, width - 3)
            ranks = np.take_along_axis(ranks, np.arange(width - 2) + (np.arange(width - 2) >= gone[:, None] + (col[:, None] > width - 3)), axis=1)
            right = col < width - 2  # new neighbours on both sides of the merged token
            ranks[at[right], col[right]] = self._rank(ids[at[right], col[right]], ids[at[right], col[right] + 1])
            left = col > 0
            ranks[at[left], col[left] - 1] = self._rank(ids[at[left], col[left] - 1], ids[at[left], col[left]])
        return out

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long piece."""
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one side has merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := pairs.get((r << 32) | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := pairs.get((ids[h] << 32) | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each piece."""
        out: dict[str, tuple[int, ...]] = {}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if b in self.ranks:
                out[p] = (self.ranks[b],)
            elif len(b) > LONG:
                out[p] = self._heap(b)
            else:
                by.setdefault(-(-len(b) // 4), []).append((p, b))
        for bucket, own in by.items():
            step = max(1, CELLS // (4 * bucket))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                out.update(zip((p for p, _ in part), self._matrix([b for _, b in part]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.seen) > MEMORY:
            self.seen.clear()
        split = [self.split(t) for t in texts]
        new = self.encode_pieces(list({p for s in split for p in s}.difference(self.seen)))
        self.seen.update((p, ids) for p, ids in new.items() if len(p) <= REMEMBERED)
        seen = self.seen
        return [[i for p in s for i in (seen.get(p) or new[p])] for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec.from_file(path, pattern)


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts, a bounded number of characters at a time (a longer text alone)."""
    part: list[str] = []
    n = 0
    for t in texts:
        t = t or ""
        if part and n + len(t) > CHUNK:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, decoded from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        names = {i: str(i) for i in own.bytes_of}
        for batch in batches:
            n, ids_sha, back_sha = [], [], []
            for texts in _chunks(batch.column("text").to_pylist()):
                for ids in own.encode(texts):
                    n.append(len(ids))
                    ids_sha.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    back_sha.append(sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with one column more, the ids of its text."""
    if ids in docs.columns:
        raise ValueError(f"docs has a column {ids} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [i for texts in _chunks(batch.column("text").to_pylist()) for i in own.encode(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return docs.mapInArrow(lean(run), schema)


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with one column more, decoded: the bytes that the ids stand for."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [own.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(lean(run), schema)
