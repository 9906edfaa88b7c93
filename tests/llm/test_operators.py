"""The operators against brute force, exact round trips and defined edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, components, html_text, jaccard, licenses, line_dedup, media, mixing, topk, toxicity, warc
from quillstream.llm._spread import with_totals

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string"


def docs_of(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [(None, "alpha beta gamma", None), (1, None, "a"), (2, "", "a"), (3, "w " * 5000, "b"), (4, "same text here", "b"), (4, "same text here", "b"), (5, "same text here", None)])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# op1
def test_mixing_targets_follow_the_rule(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(800)] + [(900, "w w", "tiny")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, capped, total = {}, set(), sum(sizes.values())
    while True:  # the excess is reshared until none is above
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        want = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        above = {s for s in free if want[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    taken: dict = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_edges(spark, odd):
    assert mixing.mix(empty(spark)).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == 7 and all(r.taken in range(0, 3 * r["size"] + 1) for r in rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)


# op2
def test_licenses(spark, odd):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, filler + " " + licenses.TEMPLATES["MIT"] + " " + filler, "a"), (2, "x. Licensed under CC BY-NC 4.0.\nMore.", "a"), (3, filler, "a"), (4, licenses.TEMPLATES["ISC"].replace("copyright notice", "notice"), "a")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got[1, "MIT"].containment == 1.0 and got[1, "MIT"].first_shingle == 300
    assert (2, "CC-BY-NC-4.0") in got and not any(i == 3 for i, _ in got)
    assert got[4, "ISC"].containment >= 0.8
    assert licenses.scan(odd).count() == licenses.scan(empty(spark)).count() == 0


def test_licenses_of_few_words(spark):
    texts = ["x y. All rights\nRESERVED.", "all rights were reserved", "All rights all rights reserved!", "overall rights reserved", "All rights", "", None, "All-rights_reserved " + licenses.TEMPLATES["MIT-line"]]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {(r.doc_id, r.license): (r.containment, r.first_shingle) for r in licenses.scan(docs).collect()}
    assert got == {(0, "all-rights-reserved-line"): (1.0, 2), (2, "all-rights-reserved-line"): (1.0, 2), (7, "all-rights-reserved-line"): (1.0, 0), (7, "MIT-line"): (1.0, 3)}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs, {"two": "Rights reserved"}).collect()} == {(0, "two"), (2, "two"), (3, "two"), (7, "two")}


# op3
def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def _changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcé")
        elif kind == 1:
            s.insert(i, rng.choice("abcé"))
        elif len(s) > 22:
            del s[i]
    return "".join(s)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(24, 60))) for _ in range(40)]
    rows = [(d, "\n".join(_changed(rng, rng.choice(base), rng.randint(0, 3)) if rng.random() < 0.8 else "short" for _ in range(rng.randint(0, 6))), "a") for d in range(100)]
    first = {}
    for d, t, _ in rows:
        for i, line in enumerate(t.split("\n")):
            if len(line) >= line_dedup.LEAST:
                first.setdefault(line, (d, i))
    near = {b for a in first for b in first if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and _edits(a, b) <= 2}
    want = {}
    for d, t, _ in rows:
        want[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if len(x) < line_dedup.LEAST or (x not in near and first[x] == (d, i)))
    got = {r.doc_id: r.text for r in line_dedup.lines_of(docs_of(spark, rows)).collect()}
    assert got == want and near


def test_line_dedup_filters_lose_nothing(spark):
    rng = random.Random(5)
    pairs = [(a := "".join(rng.choice("abcdé ") for _ in range(rng.randint(24, 200))), _changed(rng, a, rng.randint(0, 4))) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    counts = line_dedup.counts_agree(line_dedup.letter_counts(a), line_dedup.letter_counts(b))
    for r in df.select(line_dedup.within(a, b).alias("w"), line_dedup.pieces_agree(a, b).alias("p"), counts.alias("c"), (F.levenshtein("a", "b") <= 2).alias("near")).collect():
        assert r.w == r.near and (not r.near or (r.p and r.c))


def test_line_dedup_short_lines(spark):
    rng = random.Random(9)
    rows = [(d, "\n".join("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(12)), "a") for d in range(60)]
    rows += [(100, "Les Rech.\nLes Rech.\n Les Rech.\t\nok\n\n\nok", "a")]
    first, at, want = {}, {}, {}
    for d, t, _ in rows:
        for i, line in enumerate(x.strip("\t ") for x in t.split("\n")):
            first.setdefault(line, (d, i))
    for d, t, _ in rows:
        left = []
        for i, x in enumerate(t.split("\n")):
            line = x.strip("\t ")
            if line not in at:
                at[line] = len(line) >= 5 and any(len(b) >= 5 and first[b] < first[line] and abs(len(b) - len(line)) <= 2 and _edits(line, b) <= 2 for b in first)
            if not line or (first[line] == (d, i) and not at[line]):
                left.append(x)
        want[d] = "\n".join(left)
    got = {r.doc_id: r.text for r in line_dedup.lines_of(docs_of(spark, rows)).collect()}
    assert got == want and got[100].count("Les Rech.") == 1 and got[100].count("ok") == 1 and any(at.values())


def test_line_dedup_edges(spark, odd):
    got = {(r.doc_id, r.text) for r in line_dedup.lines_of(odd).collect()}
    assert (1, None) in got and (2, "") in got and len(got) == 6
    assert line_dedup.deduplicated(odd).columns == odd.columns
    assert line_dedup.lines_of(empty(spark)).count() == 0


# op4
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(400)]
    vectors += [(401, None), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (500, [1.0, 2.0]), (501, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


# op5
@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>hi &amp; you&nbsp; all", "hi & you all"),
        ("<body><nav><a>Home</a></nav><article><h1>T</h1><p><b>One,<br>two.<p>Three.</article><footer>f</footer>", "T\nOne, two.\nThree."),
        ("<article><h1>A</h1><div class='ad'>buy</div><p>one</p><div id='comments'><p>" + "nice, " * 80 + "</p></div></article>", "A\none"),
        ("<div class='content'><p>" + "word, " * 30 + "end</p><p>Short.</p></div><div class='sidebar'><p>" + "x " * 200 + "</p></div>", ("word, " * 30 + "end") + "\nShort."),
        ("<script>var t='</p>';</script><p>x<!-- no --></p><form><p>sign up</p></form>", "x"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html) == text


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (1, "u", None)], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_text.main_text(pages).collect()) == [("", 0), ("é", 1)]


# op6
def test_decoder_restores_words():
    counts = toxicity._count(["the idiot and the loser were stupid, moron and trash; disgusting worthless clown " * 50])
    own = toxicity.Decoder(counts)
    for word in ("l0ser", "$tupid", "looooser", "s.t.u.p.i.d", "w0rthle$$", "d1sgust1ng", "tr@sh", "m0r0n"):
        assert {"loser", "stupid", "worthless", "disgusting", "trash", "moron"} & toxicity.features_of(word, own), word
    assert "idiot" in toxicity.tokens_of("an i d i o t here")


def test_toxicity_held_out(spark, odd):
    rng = random.Random(2)
    words = ["the", "and", "river", "stone", "light", "garden", "over", "small"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) + str(rng.choice(["", "s", "ed"])) for _ in range(40)]
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(["vilename", "slurword"]))
        rows.append((i, " ".join(text), "a"))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows), lab).collect()}
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == int(i % 5 == 0) and 0 <= got[i].score <= 1
    none = lab.limit(0)
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}
    assert toxicity.score(empty(spark), none).count() == 0
    assert toxicity.kept_documents(odd, none).columns == odd.columns


# op7
def test_warc(spark):
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "u", big), (2, "u\r\nv", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    got = {r.page_id: r for r in warc.read_archive(spark, archive).collect()}
    assert got[2].record_type == "response" and got[1].record_type == got[None].record_type == "revisit" and got[1].refers_to == 2
    assert got[3].record_type == got[4].record_type == "response" and got[5].payload_bytes == 0
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert spark.read.parquet(archive.payloads).count() == 3
    whole = {r.page_id: bytes(r.record) for r in warc.records(spark, archive).collect()}
    head, _, rest = whole[2].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert rest[:length] == big.encode() and rest[length:] == b"\r\n\r\n"
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


# op8
def test_bpe_equals_tiktoken(spark, odd):
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    rng = random.Random(1)
    texts = ["", " ", "it's I'LL", "a" * 3000, "é日本😀" * 90, " " * 900, "<|endoftext|>", *("".join(rng.choice("abcdehtonis ") for _ in range(rng.randint(1, 400))) for _ in range(200))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == want.encode_ordinary(text) and own.decode(ids) == text.encode()
    rows = bpe.digests(odd, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect()
    assert len(rows) == 7 and sum(r.n_tokens == 0 for r in rows) == 2
    back = bpe.decoded(bpe.encoded(odd, p.path("byte_bpe_50k.tiktoken"), p.PATTERN), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())


# op9
def _shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words), "a"))
    rows += [(200, None, "a"), (201, "", "a"), (202, "one two", "a"), (203, "one  two", "a")]
    sets, links, parent = [_shingles(t) for _, t, _ in rows], [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {(rows[i][0], rows[root(i)][0], links[i]) for i in range(len(rows))}
    df = docs_of(spark, rows)
    assert {(r.doc_id, r.class_id, r.links) for r in jaccard.classes(df).collect()} == want
    kept = jaccard.one_of_each(df)
    assert kept.columns[0] == "doc_id" and sorted(kept.columns) == sorted(df.columns)
    assert kept.count() == len({c for _, c, _ in want})
    assert jaccard.classes(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (42, 41)]
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(40, 40), (41, 40), (42, 40)}


def test_components_of_a_node_with_many_links(spark):
    n = 3000
    edges = [(5000, i) for i in range(1, n)] + [(i, i + 10_000) for i in range(1, n, 3)] + [(20_000, 20_001)] * 3
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges[:-3] for x in e}
    assert got == {(x, 1) for x in nodes} | {(20_000, 20_000), (20_001, 20_000)}


def test_totals_of_a_large_group(spark):
    rows = spark.range(5000).selectExpr("IF(id < 4000, 0L, IF(id < 4900, id, null)) AS g", "id")
    dealt = with_totals(rows, "g", "id", F.count("*").alias("n"), F.min("id").alias("least"))
    got = dealt.groupBy("n", "least").count().where("n > 1").collect()
    assert [tuple(r) for r in got] == [(4000, 0, 4000)]
    assert dealt.count() == 4900 and dealt.columns == ["g", "id", "n", "least"]
    assert with_totals(rows.where("false"), "g", "id", F.count("*").alias("n")).count() == 0


# op10
def test_media_round_trip():
    rng = np.random.default_rng(0)
    payloads = [media.payload_of(""), media.payload_of(None), rng.integers(0, 256, 192 * 50, dtype=np.uint8).tobytes(), b"\xff" * 384, b"\x00\xff" * 192, media.payload_of("é日本" * 1000)]
    for payload, avi in zip(payloads, media.encode(payloads), strict=True):
        frames, width, height, fps = media.frames_of(avi)
        assert (width, height, fps) == (16, 12, 25.0) and media.decode_frames(frames).tobytes() == payload


def test_media_rows(spark, odd):
    for r in media.features(odd).collect():
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes)
    text = "a" * 192 * 30 + "9" * 192 * 30
    row = docs_of(spark, [(1, text, "a")])
    r = media.features(row).first()
    assert r.payload_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.tail_crc32 == zlib.crc32(b"9" * 16) and ";shots=2;" in r.feature
    clips = media.clip_rows(media.read_media(media.encode_media(row))).collect()
    assert [(c.first_frame, c.last_frame, c.start_s) for c in clips] == [(0, 29, 0.0), (30, 59, 1.2)]
    assert media.features(empty(spark)).count() == 0


def _median(x):
    x = sorted(x)
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def test_media_cuts():
    cuts = lambda *d: media.cuts(np.array(d, dtype=np.int64)).tolist()
    full, calm = 192, [3] * 20
    assert cuts() == [] and cuts(full) == [1] and cuts(full - 150) == []
    assert cuts(full, full) == [1, 2] and cuts(3, full, 3, 3, 3) == [2]  # short files
    assert cuts(*calm, full) == [21] and cuts(full, *calm) == [1]  # the edges
    assert cuts(*calm, full, 3, 3, full, *calm) == [21, 24]  # close cuts
    assert cuts(*[100, 110, 105, 95] * 10) == []  # steady motion
    rng = random.Random(8)
    for _ in range(300):
        d = [rng.choice([rng.randrange(40), rng.randrange(40), rng.randrange(193)]) for _ in range(rng.randrange(1, 40))]
        want = []
        for i, x in enumerate(d):
            others = d[max(0, i - 8) : i] + d[i + 1 : i + 9]
            if x >= 48 and (len(others) < 5 or x - (m := _median(others)) > 3 * 1.4826 * _median([abs(o - m) for o in others])):
                want.append(i + 1)
        assert cuts(*d) == want


def test_media_short_text_has_shots(spark):
    row = docs_of(spark, [(1, "a" * 192 * 2 + "9" * 192 * 2 + "Q" * 192, "a")])
    assert ";shots=3;" in media.features(row).first().feature
