"""Relational operators and their streaming forms."""

import hashlib
import hmac
import time

from pyspark.sql import functions as F

import __spark_entry__
from quillstream.functions import labels, prompts, urls
from quillstream.functions import languages as lg
from quillstream.functions import text as tx
from quillstream.operators import layout, markdown, votes
from quillstream.plans import admission, limits, progress, registry
from quillstream.sources import files
from quillstream.streaming import live


def test_guards(spark):
    arabic = "هذا نص عربي طويل بما يكفي للحكم على اللغة المستخدمة فيه هنا"
    english = "this is an english text that is long enough to be judged by its script here"
    rows = [(english, english), (english, arabic), (arabic, english), (english, "this is"), (english, english * 2), (english, " "), ("um uh", "x")]
    got = spark.createDataFrame(rows, "s string, o string").select(tx.rejection(F.col("s"), F.col("o"), F.lit("ar"))).collect()
    assert [r[0] for r in got] == [None, "translated", "translated", "too_short", "too_long", "failed", None]


def test_languages(spark):
    rows = spark.createDataFrame([("ar-SA",), ("Polish",), ("auto",), (None,), ("zz",), ("zzz",)], "v string")
    assert [r[0] for r in rows.select(lg.normalized(F.col("v"))).collect()] == ["ar", "pl", None, None, "zz", None]


def test_votes(spark):
    long, ar = "mot " * 40, "كلمة " * 40
    parts = [("a", 1, long, "fr", 300.0), ("a", 2, long, "fr", None), ("a", 3, ar, "ar", 10.0), ("a", 4, "hm", "en", 10.0), ("b", 1, long, None, 1.0)]
    df = spark.createDataFrame(parts, "lecture string, part_no long, text string, reported string, duration double")
    cast = votes.votes(df)
    chosen = {r.lecture: r.language for r in votes.majority(cast).collect()}
    assert chosen == {"a": "fr", "b": None}
    assert [r.part_no for r in votes.to_redo(cast, votes.majority(cast)).collect()] == [3]
    assert [r.offset for r in votes.offsets(df).where("lecture = 'a'").orderBy("part_no").collect()] == [0.0, 300.0, 600.0, 610.0]


def test_limits_and_sessions(spark):
    log = spark.createDataFrame([(i, 1, t * 1_000_000) for i, t in enumerate([0, 10, 20, 30, 3600, 3601])], "id long, client long, at long")
    got = {r.id: (r.admitted, r.retry_after) for r in limits.admitted(log, 3).collect()}
    assert [got[i] for i in range(6)] == [(True, None), (True, None), (True, None), (False, 3570), (True, None), (False, 9)]
    times = spark.createDataFrame([(t * 1_000_000,) for t in (0, 899, 1799, 86_400, 87_299, 88_200)], "at long")
    assert sorted((r.begin // 1_000_000, r.n) for r in limits.sessions(times).collect()) == [(0, 2), (1799, 1), (86_400, 2), (88_200, 1)]


def test_progress(spark):
    events = spark.createDataFrame([("j", 1, "running", 10), ("j", 2, "failed", 5), ("j", 3, "completed", 99)], "job_id string, seq int, status string, progress int")
    assert [tuple(r) for r in progress.last_states(events).collect()] == [("j", "failed", 10)]
    outcomes = [("d", i, o) for i, o in enumerate(["ok", "failed", "failed", "failed", "ok"])]
    df = spark.createDataFrame(outcomes, "doc_id string, chunk_no int, outcome string")
    assert progress.chunk_stop(df).first().stop_at == 3
    r = progress.chunk_stats(df).first()
    assert (r.chunks, r.rewritten, r.fallback, r.rejections) == (5, 1, 4, {"failed": 3})


def test_registry(spark):
    assert spark.range(1).select(registry.signature(F.lit("key"), F.lit("1.job.done"))).first()[0] == hmac.new(b"key", b"1.job.done", hashlib.sha256).hexdigest()
    jobs = spark.createDataFrame([(str(i), "running" if i == 0 else "completed", float(i), float(i), False) for i in range(6)], "job_id string, status string, submitted_at double, finished_at double, notices boolean")
    assert sorted(r.job_id for r in registry.trimmed(jobs, 3).collect()) == ["0", "3", "4", "5"]
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y")], "k string, created_at int, updated_at int, value string")
    new = spark.createDataFrame([("a", 5, 5, "z")], "k string, created_at int, updated_at int, value string")
    assert sorted(map(tuple, registry.upserted(old, new, "k").collect())) == [("a", 1, 5, "z"), ("b", 1, 1, "y")]


def test_names(spark):
    one = spark.range(1)
    assert one.select(urls.file_name(F.lit(" a<b>:c . "))).first()[0] == "a_b_c"
    assert one.select(urls.within_bytes(F.lit("é" * 100), 11)).first()[0] == "é" * 5


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"ok \xff end")
    assert files.read_transcripts(spark, str(tmp_path / "t.txt")).first().text == "ok � end"
    (tmp_path / "jobs.json").write_text('{"a": {"status": "running"}, "b": 3, "c": {"status": "completed"}}')
    assert sorted((r.job_id, r.status) for r in files.read_jobs(spark, str(tmp_path / "jobs.json")).collect()) == [("a", "failed"), ("c", "completed")]
    (tmp_path / "app.env").write_text("# c\nA='x=1'\nA=2\n\nB=3\n")
    assert sorted(map(tuple, files.read_settings(spark, str(tmp_path / "app.env")).collect())) == [("A", "x=1"), ("B", "3")]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_adjacent_repeats(spark):
    cases = {
        "Same old line here.\n\nsame old LINE here\nNo.\nNo.\nWe go on. We go on. Ok.": "Same old line here.\n\nNo.\nNo.\nWe go on. Ok.",
        "Para one is here.\n\nPara two is here.": "Para one is here.\n\nPara two is here.",
        "a b c.\n\n\n\nd": "a b c.\n\nd", "one two three\n\t\r\none two three": "one two three", "one two three\nshort\none two three": "one two three\nshort\none two three",
        "": "", " \n ": "", None: "", "x 1 2\r\nX, 1 2!\rend": "x 1 2\nend",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", markdown.without_repeats(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases


def test_markdown_layout(spark):
    cases = {
        "Text ## Head\nmore\n* item\n---\n##### Deep": "Text\n\n## Head\n\nmore\n- item\n\n### Deep",
        "Items: - arrays - trees": "Items:\n- arrays\n- trees", "so - it goes": "so - it goes", "Sum: - 1 - 2": "Sum: - 1 - 2",
        "One: - only": "One: - only", "One: - only\n- next": "One:\n- only\n- next", "a  b\r\n\r\n\r\nc": "a b\n\nc", "It\u00e2\u20ac\u2122s": "It's", "": "", None: "",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", markdown.tidy("t").alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases


def test_unwrapped_answers(spark):
    spoken = "Here is the second version of the algorithm: sort"
    rows = [("```md\nText\n```", None, "Text"), ("Here is the cleaned transcript:\nBody", None, "Body"), (spoken, spoken, spoken), (spoken, "other words", "sort"), ("Edited text\nfoo", "", "foo"), (None, None, ""), ("plain", None, "plain")]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, s string").select(markdown.unwrap("a", "s")).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_blocks_hold_their_text(spark):
    docs = spark.createDataFrame([(1, "# T\n\npara **one**\ngoes on\n- a\n- b\n\n1. x"), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.block_no, r.kind, r.n_lines, r.text) for r in markdown.blocks(docs).orderBy("doc_id", "block_no").collect()]
    assert got == [(1, 1, "heading", 1, "T"), (1, 2, "paragraph", 2, "para **one**\ngoes on"), (1, 3, "bullet", 2, "a\nb"), (1, 4, "numbered", 1, "x")]
    assert [tuple(x) for x in one(spark, markdown.bold(F.lit("a **b** c")))] == [("a ", False), ("b", True), (" c", False)]


def test_signature_of_any_key(spark):
    for key in ("k", "x" * 64, "long key " * 9, "é" * 40, ""):
        assert one(spark, registry.signature(F.lit(key), F.lit("1.job.done"))) == hmac.new(key.encode(), b"1.job.done", hashlib.sha256).hexdigest()


def test_queue_rank_keeps_jobs_without_a_time(spark):
    rows = [("a", "queued", None), ("b", "queued", 5.0), ("c", "queued", 7200.5), ("d", "queued", 7200.5), ("e", "running", 1.0), ("f", "queued", 9000.0)]
    got = {r.job_id: r.ahead for r in registry.queue_rank(spark.createDataFrame(rows, "job_id string, status string, submitted_at double")).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 3, "f": 5}


def test_guard_on_a_missing_answer(spark):
    assert one(spark, tx.rejection(F.lit("short one"), F.lit(None).cast("string"), F.lit("en"))) == "failed"
    assert one(spark, urls.video_id(F.lit("https://youtube.com/watch?v=%20&v=dQw4w9WgXcQ"))) == "dQw4w9WgXcQ"
    assert one(spark, F.octet_length(urls.file_name(F.lit("é" * 140)))) == 120


def test_cache_and_files(spark):
    entry = "video_id string, language string, mode string, format_version string, raw_path string, cleaned_path string, title string"
    v = "dQw4w9WgXcQ"
    cache = spark.createDataFrame([(v, "en", "fast", "v1", "r", "c", "t"), (v, "ar", "fast", None, "r", "c", "t"), (v, "fr", "fast", "v1", "r", None, "t"), (v, "de", "fast", "v1", "gone", "c", "t")], entry)
    files = spark.createDataFrame([("r",), ("c",), (f"x/{v}_fr_raw.txt",), (f"x/{v}_fr_fast_v1.md",), (f"x/{v}_es_raw.txt",)], "path string")
    assert [r.language for r in registry.cached(cache, "v1", files).collect()] == ["en"]
    assert sorted(r.language for r in registry.stale(cache, "v1", files).collect()) == ["ar", "de", "fr"]
    sidecars = spark.createDataFrame([(v, "fr", "side", "fr", "x")], "video_id string, language string, title string, detected_language string, cleaner_provider string")
    asked = spark.createDataFrame([(v, x, "fast", "u") for x in ("en", "fr", "de", "es")], "video_id string, language string, mode string, canonical_url string")
    got = {r.language: r.result for r in registry.found_results(asked, cache, files, sidecars, "v1").collect()}
    assert got["en"].title == "t" and got["fr"].title == "side" and got["fr"].cleaner_provider == "formatter" and got["fr"].used_cached_cleaned_transcript
    assert got["de"] is None and got["es"] is None
    assert {(r.language, r.raw_path) for r in registry.raw_files(files).collect()} == {("fr", f"x/{v}_fr_raw.txt"), ("es", f"x/{v}_es_raw.txt")}
    jobs = spark.createDataFrame([("1", "completed", 1.0, "r", None), ("2", "completed", 2.0, "r", "lost"), ("3", "completed", 0.5, "r", "c")], "job_id string, status string, finished_at double, raw_path string, cleaned_path string")
    jobs = jobs.withColumns({"video_id": F.lit(v), "language": F.lit("en"), "mode": F.lit("fast"), "format_version": F.lit("v1")})
    assert registry.newest_reusable(jobs, "v1", files).first().job_id == "1"
    assert registry.newest_reusable(jobs.withColumn("mode", F.lit("formatted")), "v1", files).first().job_id == "3"


def _cascade(rows, limits_):
    """A plain version: every request against all that came before."""
    out, queued, used = [], [], []
    span = limits_.window * 1_000_000
    for s, i, at, client, limit, key, valid, reusable, ends in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        asked = [q for q in queued if q[0] == s and q[1] > at - span]
        uses = [u for u in used if u[0] == s and u[1] > at - span]
        running = [q for q in queued if q[0] == s and q[4] > at]
        same = [q for q in running if q[3] == key]
        wait = lambda log: max(1, -(-(min(x[1] for x in log) + span - at) // 1_000_000))
        if not valid:
            out.append((i, "invalid", None, None))
        elif same:
            out.append((i, "duplicate", None, same[0][5]))
        elif reusable and len(uses) < min(limits_.reuse_overall, limits_.history // 2) and sum(u[2] == client for u in uses) < limits_.reuse_client:
            used.append((s, at, client))
            out.append((i, "reused", None, None))
        elif len(running) >= limits_.active:
            out.append((i, "full", limits_.full_retry, None))
        elif len(asked) >= limits_.overall:
            out.append((i, "limited", wait(asked), None))
        elif sum(q[2] == client for q in asked) >= limit:
            out.append((i, "limited", wait([q for q in asked if q[2] == client]), None))
        else:
            queued.append((s, at, client, key, ends, i))
            out.append((i, "queued", None, None))
    return sorted(out)


def test_submissions_equal_the_plain_version(spark):
    import random

    rng = random.Random(4)
    some = admission.Limits(overall=6, active=3, reuse_client=2, reuse_overall=4, history=7)
    at, rows = 0, []
    for i in range(1500):
        at += rng.choice([0, 1, 30, 200, 900, 3600, 9000] if i % 40 else [20_000]) * 1_000_000
        rows.append((rng.choice("ab"), i, at, rng.choice([1, 2, 3]), rng.choice([2, 3]), rng.randrange(6), rng.random() > 0.1, rng.random() > 0.7, at + rng.choice([0, 60, 4000]) * 1_000_000))
    schema = "service string, id long, at long, client long, limit int, key int, valid boolean, reusable boolean, ends long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted((r.id, r.outcome, r.retry_after, r.same_as) for r in admission.submitted(df, some).collect())
    assert got == _cascade(rows, some) and {r[1] for r in got} == {"invalid", "duplicate", "reused", "full", "limited", "queued"}
    assert admission.submitted(df.limit(0), some).count() == 0


def test_window_edges(spark):
    log = spark.createDataFrame([(i, 1, t * 1_000_000) for i, t in enumerate([0, 1, 2, 3599, 3600])], "id long, client long, at long")
    assert {r.id: r.admitted for r in limits.admitted(log, 3).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_job_views(spark):
    jobs = spark.createDataFrame([("j", "running")], "job_id string, status string")
    whole = registry.with_contract(jobs)
    assert dict(whole.dtypes)["video_duration_seconds"] == "double" and whole.first().title is None
    assert one(spark, registry.transcript_code(F.lit("raw"), F.lit("completed"), F.lit("p"), F.lit(True))) == 200
    assert one(spark, registry.transcript_code(F.lit(None).cast("string"), F.lit("completed"), F.lit("p"), F.lit(True))) == 400
    assert one(spark, registry.accepted_callback(F.lit(" http://h/x "), F.lit("k"))) is None and one(spark, registry.accepted_callback(F.lit(" HTTPS://h/x "), F.lit("k"))) == "HTTPS://h/x"
    assert one(spark, registry.key_set(F.lit(" a, b,,a "))) == ["a", "b"]
    assert [one(spark, labels.duration(F.lit(x).cast("double"))) for x in (None, -3, 59.5, 60, 125)] == ["0s", "0s", "1m", "1m", "2m 5s"]
    assert one(spark, urls.lecture_url(F.lit("https://youtu.be/dQw4w9WgXcQ?x=1"))) == "https://www.youtube.com/watch?v=dQw4w9WgXcQ"
    assert one(spark, urls.lecture_url(F.lit("ftp://a/b"))) is None and one(spark, urls.lecture_url(F.lit("https://Host.org?q"))) == "https://host.org/"
    assert one(spark, urls.legacy_title(F.lit("a/b/dQw4w9WgXcQ_Graph_theory_english_transcript_cleanedv2.txt"))) == "Graph theory"
    assert one(spark, prompts.system(F.lit("ar"))).endswith(prompts.ARABIC_RULE) and "English" in one(spark, prompts.system(F.lit("en")))


def test_rewriting_with_a_callable(spark):
    def generate(text, language):
        if text == "lost":
            raise LookupError
        return None if text == "bad" else text.upper() + language

    chunks = spark.createDataFrame([("d", i, t, "x") for i, t in enumerate(["a", "bad", "lost"])], "doc_id string, chunk_no int, text string, language string")
    got = {r.text: (r.output, r.outcome) for r in layout.rewritten(chunks, generate).collect()}
    assert got == {"a": ("Ax", "ok"), "bad": (None, "failed"), "lost": (None, "lost")}
    assert {r.output for r in layout.rewritten(chunks).collect()} == {"a", "bad", "lost"}
    layout.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM split_text('one two three four', 9)").collect()] == [(0, "one two"), (1, "three"), (2, "four")]
    timed = "array(named_struct('start', 0D, 'end', 1D, 'text', 'one two'), named_struct('start', 9D, 'end', 9D, 'text', 'three'))"
    assert spark.sql(f"SELECT paragraph_timed('one two three', {timed}), format_timed('one two three', {timed}, 'en')").first()[0].split() == ["one", "two", "three"]


def test_deliveries_and_attempts(spark):
    rows = [("a", "u", 1, 500), ("a", "u", 2, 200), ("a", "u", 3, 200), ("b", "u", 1, 404), ("b", "u", 2, 200), ("c", "u", 1, 429), ("c", "u", 2, 500)]
    got = {r.job_id: (r.tries, r.ok) for r in progress.delivered(spark.createDataFrame(rows, "job_id string, url string, attempt int, code int")).collect()}
    assert got == {"a": (2, 1), "b": (1, 0), "c": (2, 0)}
    tries = [("d", 1, 1, "too_short", True), ("d", 1, 2, "ok", True), ("d", 2, 1, "failed", False), ("d", 2, 2, "ok", True), ("d", 3, 1, "failed", True)]
    got = {r.chunk_no: (r.tries, r.outcome) for r in progress.attempts(spark.createDataFrame(tries, "doc_id string, chunk_no int, attempt int, outcome string, retryable boolean")).collect()}
    assert got == {1: (2, "ok"), 2: (1, "failed"), 3: (1, "failed")}


def test_written_files(spark, tmp_path):
    jobs = spark.createDataFrame([("a", 1.5, b"x", None), ("b", None, None, "t")], "job_id string, at double, raw binary, title string")
    files.write_keyed(jobs, str(tmp_path / "jobs"), "job_id")
    got = files.read_written(spark, str(tmp_path / "jobs"), "job_id string, at double, raw string, title string")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1.5, "x", None), ("b", None, None, "t")]
    files.write_sidecars(spark.createDataFrame([("v", "en", "T")], "video_id string, language string, title string"), str(tmp_path / "side"))
    side = spark.read.parquet(str(tmp_path / "side")).first()
    assert side.language == "en" and one(spark, files.read_sidecar(F.lit(side.sidecar))).title == "T"
    (tmp_path / "cache.json").write_text('{"videos": {"k": {"video_id": "v", "mode": "fast"}, "odd": 3}}')
    assert [(r.cache_key, r.video_id) for r in files.read_cache(spark, str(tmp_path / "cache.json")).collect()] == [("k", "v")]
    (tmp_path / ".env").write_text("A=1\n")
    assert files.read_settings(spark, str(tmp_path / ".env")).first().value == "1"
    assert [r.name for r in files.names(files.listing(spark, str(tmp_path / "side"))).collect() if r.name.endswith(".parquet")]
    files.write_transcripts(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "one two"
    spark.createDataFrame([("j", 1)], "job_id string, n int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, n int").parquet(str(tmp_path / "in"))
    files.persisted(stream, str(tmp_path / "sink"), str(tmp_path / "ck"), forced=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1


def test_streaming_limits(spark, tmp_path):
    rows = [(i, 1, float(t)) for i, t in enumerate([0, 10, 20, 30, 3700])]
    spark.createDataFrame(rows, "id long, client long, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, client long, at double").parquet(str(tmp_path / "in"))
    q = live.admitted(stream).writeStream.format("memory").queryName("lim").outputMode("append").start()
    for _ in range(300):  # states with a timeout keep such a query alive
        if spark.table("lim").count() == 5:
            break
        time.sleep(0.2)
    q.stop()
    assert {r.id: (r.admitted, r.retry_after) for r in spark.table("lim").collect()} == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, 3570.0), 4: (True, None)}
    times = stream.select(F.timestamp_seconds("at").alias("ts"), "client", "id")
    for name, frame in (("ses", live.sessions(times, "client", late="10 minutes")), ("off", live.offered(times)), ("one", live.first_of_each(times, ["client"]))):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("one").count() == 1
    assert [(r.client, r.n) for r in spark.table("ses").collect()] == [(1, 4)]


def test_streaming_states(spark, tmp_path):
    spark.createDataFrame([("j", 1, "downloading"), ("j", 2, "transcribing"), ("j", 3, "downloading"), ("j", 4, "failed"), ("j", 5, "completed")], "job_id string, seq int, stage string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, seq int, stage string").parquet(str(tmp_path / "in"))
    q = live.job_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("states").collect()] == [("j", "failed", 35)]


def test_sql_functions_and_entry(spark):
    layout.register(spark)
    assert spark.sql("SELECT collapse_loops('go go go go')").first()[0] == "go go"
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cache_queries_read_every_event(spark, tmp_path):
    from datetime import datetime, timedelta

    from quillstream import queries

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=7 * i), (i * i + i // 5) % 9, float(i % 13)) for i in range(60)] + [(60, start, 20, None), (61, None, 21, 2.0), (62, start + timedelta(hours=7 * 59), 23, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    day = max(r[1] for r in rows if r[1]).replace(hour=0)
    old, new = {}, {}
    for _, ts, user, value in rows:
        (new if ts and ts >= day else old).setdefault(user, []).append((ts, value))
    want = {}
    for user in old.keys() | new.keys():
        both, late = old.get(user, new.get(user)), new.get(user, old.get(user))
        times = [int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for ts, _ in both if ts], [int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for ts, _ in late if ts]
        want[user] = (min(times[0], default=None), max(times[1], default=None), max((v for _, v in late if v is not None), default=None))
    got = {r.user_id: (r.created_at, r.updated_at, r.value) for r in queries.QUERIES["cache_upsert"](spark, str(tmp_path)).collect()}
    assert got == want and set(got) == {r[2] for r in rows}
    stale = {r.user_id for r in queries.QUERIES["cache_stale"](spark, str(tmp_path)).collect()}
    assert stale == old.keys() - new.keys() and {20, 21} <= stale and any(u % 2 for u in new)


def test_vote_queries_judge_text_without_loops(spark, tmp_path):
    import random
    import re
    from collections import Counter

    from quillstream import queries
    from quillstream.operators import kernels as k

    rng = random.Random(12)
    latin, arabic = [[c * 2 + x for c in "bdfglmnprst" for x in ends] for ends in (("ando", "eri", "ulin"), ("\u0627\u0628", "\u062a\u0631"))]
    arabic = [re.sub("[a-z]", "\u0633", w) + "\u0639" * (i % 3) for i, w in enumerate(arabic)]
    said = lambda words: " ".join(rng.choice(words) for _ in range(rng.randrange(2, 40)))
    rows = [("a", 1, "Thank you. " * 300, "fr"), ("a", 2, " ".join(latin), "en"), ("b", 3, None, "en"), ("b", 4, "", None)]
    for i in range(5, 90):
        text = said(rng.choice([latin, latin, arabic])) + rng.choice(["", " Thank you." * 80, "\n\n[Music] Thanks for watching."])
        rows.append((f"l{i % 9}", i, text, rng.choice(["fr", "en", "ar"])))
    spark.createDataFrame([(d, t, s, c, len(t or "")) for s, d, t, c in rows], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    cast = {}
    for lecture, part, text, code in rows:
        probe = k.without_stock_phrases(k.collapsed(text))
        a, n = len(re.findall("[\u0621-\u064a]", probe)), len(re.findall("[\u0621-\u064aA-Za-z]", probe))
        if n >= 20:
            script = "arabic" if a / n >= 0.3 else "latin"
            known = "ar" if script == "arabic" else code if code != "ar" else None
            cast.setdefault(lecture, {})[part] = (script, known if n >= 100 else None, n)
    chosen = {}
    for lecture, parts in cast.items():
        weight = Counter()
        for s, _, n in parts.values():
            weight[s] += n
        script = max(weight, key=lambda s: (weight[s], s == "arabic"))
        codes = Counter()
        for _, (s, c, n) in sorted(parts.items()):
            if s == script and c:
                codes[c] += n
        chosen[lecture] = (script, max(codes, key=codes.get) if codes else "ar" if script == "arabic" else None)
    redo = {(x, p, chosen[x][1]) for x, parts in cast.items() for p, (s, c, _) in parts.items() if chosen[x][1] and (s != chosen[x][0] or (c and c != chosen[x][1]))}
    got = {r.lecture: (r.script, r.language) for r in queries.QUERIES["lecture_vote"](spark, str(tmp_path)).collect()}
    assert got == chosen and got["a"] == ("latin", "en")
    assert {tuple(r) for r in queries.QUERIES["parts_to_redo"](spark, str(tmp_path)).collect()} == redo and redo
