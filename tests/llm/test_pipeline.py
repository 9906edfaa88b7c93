"""The pipeline's stages on a small table, each held against what it says."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    plain = ["river", "stone", "light", "garden", "over", "small", "under", "bright", "paper", "wind"]
    rows, labels = [], []
    for i in range(300):
        lines = [" ".join(rng.choice(plain) + rng.choice(["", "s", "er"]) for _ in range(12)) for _ in range(3)]
        bad = i % 6 == 0
        if bad:
            lines[1] += " vilename slurword vilename"
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(bad)))
    rows.append((1000, rows[1][1], "en", "s1", 0))  # an exact copy
    words = rows[2][1].replace("\n", " ").split()
    rows.append((1001, " ".join(["start", *words]), "en", "s1", 0))  # a near copy on one line
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < 4:
            assert sorted(docs.columns) == sorted(columns)
        if k == 0:
            assert ids == {r[0] for r in rows} - {i for i in range(300) if i % 6 == 0}
        if k == 1:
            assert 1000 not in ids and 1 in ids and 1001 in ids
        if k == 2:
            assert 2 in ids and 1001 not in ids and len(ids) == 250
        if k == 3:
            mixed = docs.collect()
        else:
            before = before_mix if k == 4 else docs.collect()
        before_mix = before
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)
    assert Counter(r.doc_id for r in mixed) == _taken(before)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == sorted(_encoded(r) for r in mixed)


def _taken(rows):
    """How often the mix takes each row: a plain version, every source in order of its keys."""
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order, sizes = sorted(by), {s: sum(words[r.doc_id] for r in own) for s, own in by.items()}
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    out: Counter = Counter()
    for s, own in by.items():
        epochs, rest = divmod(target[s], sizes[s])

        def key(r):
            u = int(hashlib.md5(f"mix-1:{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
            symbols = sum(c in "#$%&*@<>{}[]|=_~^\\+" for c in r.text)
            return -math.log((u + 0.5) / 2**52) / max(0.05, 1 - 4.0 * symbols / len(r.text))

        for r in sorted(own, key=key):
            take = epochs + (rest >= words[r.doc_id] / 2)
            rest -= words[r.doc_id]
            if take:
                out[r.doc_id] += int(take)
    return out


def _encoded(r):
    import base64

    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ids = _encoding(tiktoken, p.PATTERN, ranks).encode_ordinary(r.text)
    return r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()


_MADE: list = []


def _encoding(tiktoken, pattern, ranks):
    if not _MADE:
        _MADE.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    return _MADE[0]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    text = "a plain line of several words here"
    rows = [(None, text, "s", "x"), (1, None, "s", "x"), (2, "", None, "x"), (3, "w " * 30_000, "s", "x"), (4, text + " and more", "t", "x"), (4, text + " and more", "t", "x"), (5, "ok", "s", "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), n) for i, t, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        path = str(tmp_path / name)
        frame.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, path)
            now.write.parquet(f"{path}/{k}")
            now = spark.read.parquet(f"{path}/{k}")
            assert k == 4 or set(now.columns) == set(docs.columns)
        ids = {r.doc_id for r in now.collect()}
        assert ids == set() if name == "none" else {3} <= ids <= {None, 1, 2, 3, 4, 5}
