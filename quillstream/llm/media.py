"""Media columns (op10): AVI with motion JPEG as a lossless store of bytes, and its timed clips.

A payload becomes frames of 16 x 12 grey samples. Each frame is one lossless JPEG (SOF3, 8 bits,
left predictor), so the samples come back exactly; the frames stand in an AVI 1.0 file with an idx1
index. Reading parses the RIFF chunks and the index, the JPEG segments of each frame (tables included),
and decodes the entropy-coded samples. All frames of a chunk of rows are encoded or decoded in
step: sample 1 of every frame, then sample 2, so the work is on numpy vectors.

A shot ends where the histogram of a frame differs from the frame before by a floor or more and by more
than the median of the other differences in the window around it plus three deviations, taken
from their median deviation, so that neither the tested difference nor another cut nearby hides it. With
fewer than FEW others, at which two more cuts could be half of them, the floor decides alone.

Defined results: a null text is an empty payload; a payload is filled with spaces to a positive multiple
of 192 bytes, so an empty text is one frame; equal texts have equal files and features; an empty
table gives no rows; further columns are ignored. AVI sizes have 32 bits and a column's value 2 GB, which bounds a
text to some 1.2 GB; a longer one raises an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._workers import lean

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
#: Payload bytes of the rows that are worked on at a time (a longer row alone), and frames that are coded in step: the arrays of
#: a step take some 50 bytes a sample, so a long row takes them for SLAB frames and not for itself.
CHUNK, SLAB = 2 << 20, 4096
#: Histogram bins; frames on each side of the adaptive window; least difference of a cut, in samples.
BINS, REACH, FLOOR = 16, 8, FRAME // 4
#: Other differences in a window from which they are asked.
FEW = 5
#: Code lengths of the difference categories 0 to 8: text mostly differs by 4 to 127.
CODE_LENGTHS = {3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 1: 4, 2: 4, 8: 4}


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Category -> (code, length) by the JPEG rule: codes count up within a length and double between lengths."""
    out, code, last = {}, 0, 0
    for cat, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[cat], last = (code, n), n
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_header() -> bytes:
    by_length = sorted(CODE_LENGTHS, key=CODE_LENGTHS.get)
    counts = bytes(sum(n == i for n in CODE_LENGTHS.values()) for i in range(1, 17))
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + counts + bytes(by_length))
        + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


HEADER, END = _jpeg_header(), b"\xff\xd9"


def frame_scans(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of all frames (n, FRAME), joined, and where each ends."""
    n = len(samples)
    x = samples.reshape(n, HEIGHT, WIDTH).astype(np.int32)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, FRAME)
    cat_of = np.array([int(i).bit_length() for i in range(256)], dtype=np.int32)
    codes = _canonical(CODE_LENGTHS)
    code, length = (np.array([codes[c][i] for c in range(9)], dtype=np.int32) for i in (0, 1))
    cat = cat_of[np.abs(d)]
    value = (code[cat] << cat) | np.where(d >= 0, d, d + (1 << cat) - 1)
    bits = length[cat] + cat
    ends = np.cumsum(bits, axis=1, dtype=np.int64)
    fill = -ends[:, -1] % 8  # the last byte of a frame is filled with ones
    size = (ends[:, -1] + fill) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    start = (ends - bits) + base[:-1, None] * 8
    shift = 24 - (start & 7) - bits
    wide = (value.astype(np.int64) << shift).ravel()
    at = (start >> 3).ravel()
    out = np.zeros(int(base[-1]) + 3)
    for k in range(3):
        out[k:] += np.bincount(at, weights=(wide >> (16 - 8 * k)) & 0xFF, minlength=len(out))[: len(out) - k]
    raw = out[: base[-1]].astype(np.uint8)
    raw[base[1:] - 1] |= ((1 << fill) - 1).astype(np.uint8)
    full = raw == 0xFF  # a zero byte follows each, lest it look like a marker
    stuffed = np.repeat(raw, 1 + full)
    places = np.cumsum(1 + full)
    stuffed[places[full] - 1] = 0
    return stuffed.tobytes(), places[base[1:] - 1]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_file(scans: list[bytes]) -> bytes:
    """An AVI file of frames with these scans."""
    frames, index, at = [], [], 4
    for s in scans:
        n = len(HEADER) + len(s) + 2
        odd = n & 1
        frames.append(b"".join((b"00dc", n.to_bytes(4, "little"), HEADER, s, END, b"\0" * odd)))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, n))
        at += 8 + n + odd
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(scans), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(scans), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    heads = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", heads) + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def encode(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads of whole frames."""
    counts = [len(p) // FRAME for p in payloads]
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME)
    own: list[bytes] = []
    for i in range(0, len(samples), SLAB):
        scans, places = frame_scans(samples[i : i + SLAB])
        ends = places.tolist()
        own += [scans[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    out, i = [], 0
    for c in counts:
        out.append(avi_file(own[i : i + c]))
        i += c
    return out


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places."""
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(end, at + 8 + n)
        at += 8 + n + (n & 1)


def frames_of(avi: bytes) -> tuple[list[bytes], int, int, float]:
    """JPEG frames by the file's index, width, height and frames a second."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, fps, size = None, b"", float(FPS), (0, 0)
    for name, a, b in riff_chunks(avi, 12, 8 + int.from_bytes(avi[4:8], "little")):
        if name == b"LIST" and avi[a : a + 4] == b"hdrl":
            for inner, c, _ in riff_chunks(avi, a + 4, b):
                if inner == b"avih":
                    fps = 1e6 / struct.unpack_from("<I", avi, c)[0]
                    size = struct.unpack_from("<II", avi, c + 32)
        elif name == b"LIST" and avi[a : a + 4] == b"movi":
            movi = a
        elif name == b"idx1":
            index = avi[a:b]
    if movi is None:
        raise ValueError("no movi list")
    rows = np.frombuffer(index, dtype=[("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")])
    rows = rows[rows["name"] == b"00dc"]
    places = (rows["at"].astype(np.int64) + movi + 8).tolist()
    return [avi[p : p + n] for p, n in zip(places, rows["n"].tolist(), strict=True)], *size, fps


def jpeg_scan(jpeg: bytes) -> tuple[bytes, int]:
    """The Huffman table's and frame's segments of a JPEG file, and where its scan starts."""
    at, heads = 2, b""
    while True:
        marker, n = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at] != 0xFF or n < 2:
            raise ValueError("broken JPEG")
        heads += jpeg[at : at + 2 + n]
        at += 2 + n
        if marker == 0xDA:
            return heads, at


def _tables(heads: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Height, width, and by the next 16 bits the category and the code's length, from JPEG segments."""
    at, height, width = 0, 0, 0
    cat, length = np.full(1 << 16, -1, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
    while at < len(heads):
        marker, n = heads[at + 1], int.from_bytes(heads[at + 2 : at + 4], "big")
        body = heads[at + 4 : at + 2 + n]
        if marker == 0xC4:
            code, k = 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    low = code << (16 - bits)
                    cat[low : low + (1 << (16 - bits))], length[low : low + (1 << (16 - bits))] = body[k], bits
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            height, width = struct.unpack_from(">HH", body, 1)
        at += 2 + n
    return height, width, cat, length


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (n, height * width) of lossless JPEG frames that share their tables."""
    first, start = jpeg_scan(frames[0])
    prefix = frames[0][:start]
    scans = []
    for f in frames:
        own = start if f.startswith(prefix) else None
        if own is None:
            heads, own = jpeg_scan(f)
            if heads != first:
                raise ValueError("frames differ in their tables")
        if f[-2:] != END:
            raise ValueError("frame without an end")
        scans.append(f[own:-2])
    tables = _tables(first)
    return np.concatenate([_decoded(scans[i : i + SLAB], *tables) for i in range(0, len(scans), SLAB)])


def _decoded(scans: list[bytes], height: int, width: int, cat_of: np.ndarray, length_of: np.ndarray) -> np.ndarray:
    """Samples of frames, by their entropy-coded bytes, all frames in step."""
    sizes = np.array(list(map(len, scans)))
    data = np.frombuffer(b"".join(scans), dtype=np.uint8)
    stuffed = np.zeros(len(data), dtype=bool)
    stuffed[1:] = (data[1:] == 0) & (data[:-1] == 0xFF)
    left = np.concatenate([[0], np.cumsum(~stuffed)])
    starts = left[np.concatenate([[0], np.cumsum(sizes)[:-1]])]
    data = np.concatenate([data[~stuffed], np.zeros(4, dtype=np.uint8)]).astype(np.int64)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    pos = starts.astype(np.int64) * 8
    d = np.empty((height * width, len(scans)), dtype=np.int32)
    for i in range(height * width):  # in step through all frames
        w = words[pos >> 3] << (pos & 7)
        top = (w >> 16) & 0xFFFF
        cat = cat_of[top]
        n = length_of[top]
        extra = ((w >> (32 - n - cat)) & ((1 << cat) - 1)).astype(np.int32)
        d[i] = np.where(extra < (1 << cat) >> 1, extra - (1 << cat) + 1, extra)
        pos += n + cat
    x = d.T.reshape(len(scans), height, width)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return (np.cumsum(x, axis=2) & 0xFF).astype(np.uint8).reshape(len(scans), height * width)


def differences(samples: np.ndarray) -> np.ndarray:
    """Samples that change their histogram bin from each frame to the next."""
    n = len(samples)
    bins = np.bincount(((np.arange(n) * BINS)[:, None] + samples // (256 // BINS)).ravel(), minlength=n * BINS).reshape(n, BINS)
    return np.abs(np.diff(bins, axis=0)).sum(axis=1) // 2


def cuts(diff: np.ndarray) -> np.ndarray:
    """Frames that start a new shot, from the differences between neighbours; whole numbers only, so that runs agree."""
    n = len(diff)
    at = np.flatnonzero(diff >= FLOOR)
    if not len(at):
        return at + 1
    near = at[:, None] + np.array([i for i in range(-REACH, REACH + 1) if i])
    there = (near >= 0) & (near < n)
    others = diff[np.clip(near, 0, n - 1)].astype(np.int64)
    k = there.sum(axis=1)
    middle = _twice_median(others, there, k)
    spread = _twice_median(np.abs(2 * others - middle[:, None]), there, k)  # four times the median deviation
    # 1.4826 median deviations stand for a standard deviation.
    return at[(k < FEW) | (10_000 * (4 * diff[at].astype(np.int64) - 2 * middle) > 3 * 14_826 * spread)] + 1


def _twice_median(x: np.ndarray, there: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Twice the median of each row's k values that are there (0 for none)."""
    x = np.sort(np.where(there, x, np.iinfo(np.int64).max), axis=1)
    row, low = np.arange(len(x)), np.maximum(k - 1, 0) // 2
    both = np.stack([x[row, low], x[row, np.maximum(k // 2, low)]])
    return np.where(k > 0, both, 0).sum(axis=0)


def _parts(rows: list[bytes]) -> Iterator[slice]:
    start, n = 0, 0
    for i, r in enumerate(rows):
        if i > start and n + len(r) > CHUNK:
            yield slice(start, i)
            start, n = i, 0
        n += len(r)
    if rows:
        yield slice(start, len(rows))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            payloads = [payload_of(t) for t in texts]
            sizes = [len((t or "").encode()) for t in texts]
            for part in _parts(payloads):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(sizes[part], pa.int64()), pa.array(encode(payloads[part]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


CLIP_FIELDS = ("clip", "first_frame", "last_frame", "start_s", "end_s", "difference")
CLIP = "struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,difference:int>"


def _read(media: list[bytes]) -> Iterator[tuple[bytes, int, list[tuple]]]:
    """Payload, number of frames and clips (in the order of CLIP_FIELDS) of each AVI file."""
    split = [frames_of(m) for m in media]
    samples = decode_frames([f for s in split for f in s[0]])
    at = 0
    for frames, _, _, fps in split:
        n = len(frames)
        own = samples[at : at + n]
        at += n
        diff = differences(own)
        starts = [0, *cuts(diff).tolist()]
        clips = [(k, a, b - 1, a / fps, b / fps, int(diff[a - 1]) if a else 0) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
        yield own.tobytes(), n, clips


def read_media(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (all samples read back), n_frames and clips of every AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip_type = pa.list_(pa.struct(list(zip(CLIP_FIELDS, [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.int32()], strict=True))))
        for batch in batches:
            media = batch.column("media").to_pylist()
            for part in _parts(media):
                payloads, counts, clips = zip(*_read(media[part]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[part] for c in ("doc_id", "n_bytes", "media")), pa.array(payloads, pa.binary()), pa.array(counts, pa.int32()), pa.array([[dict(zip(CLIP_FIELDS, c, strict=True)) for c in own] for own in clips], clip_type)],
                    names=["doc_id", "n_bytes", "media", "payload", "n_frames", "clips"],
                )

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, n_frames int, clips array<{CLIP}>")


def clip_rows(rows: DataFrame) -> DataFrame:
    """One row for each clip of read_media()'s rows."""
    return rows.select("doc_id", F.inline("clips"))


def _digest(n_bytes: int, media: bytes, payload: bytes, frames: int, clips: list[tuple]) -> tuple:
    shots = ",".join(f"{c[1]}:{c[5]}" for c in clips)
    told = f"{WIDTH}x{HEIGHT}@{FPS};frames={frames};shots={len(clips)};{shots}"
    return n_bytes, len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(media), sha256(media).hexdigest(), told


def features(docs: DataFrame) -> DataFrame:
    """The digests of op10 for every text: its AVI file is made, parsed and decoded again, and only digests leave the task."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column("text")
            for a in range(0, len(texts), 256):
                own = texts[a : a + 256].to_pylist()
                payloads = list(map(payload_of, own))
                sizes = [len((t or "").encode()) for t in own]
                for part in _parts(payloads):
                    media = encode(payloads[part])
                    out += [_digest(n, m, *read) for n, m, read in zip(sizes[part], media, _read(media), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
