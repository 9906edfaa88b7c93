"""The catalogue of queries over jobs, their cache and their labels, with DuckDB SQL for each that SQL can express.

Readings of `events`: a row is a job or request (job: event_id, video and client: user_id, kind: event_type,
seconds: value, number k of props: progress, part or attempt).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.functions import labels, prompts, urls
from quillstream.functions import languages as lg
from quillstream.functions import text as tx
from quillstream.functions.columns import first_case
from quillstream.operators import votes
from quillstream.plans import admission, limits, progress, registry
from quillstream.queries import _TOKENS, _docs, _events, _micros, _query, _table

_E = "e AS (SELECT *, (props::JSON ->> '$.k')::INTEGER AS k, epoch_us(ts) AS t, lpad(user_id::VARCHAR, 11, '0') AS video FROM events)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """job_id, video_id, kind, k, at (microseconds), seconds of every event."""
    rows = _events(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.select(F.col("event_id").alias("job_id"), F.lpad(F.col("user_id").cast("string"), 11, "0").alias("video_id"), F.col("event_type").alias("kind"), k.alias("k"), _micros("ts").alias("at"), F.col("value").alias("seconds"), "user_id", "ts")


_SPAN, _RULES = 86_400, admission.Limits(window=86_400, overall=20, active=4, reuse_client=2, reuse_overall=10, history=500)
_NONE_RUN, _NONE_LOG = "[]::STRUCT(k INTEGER, e BIGINT, id BIGINT)[]", "[]::STRUCT(t BIGINT, c BIGINT)[]"
_NONE_OUT = "[]::STRUCT(id BIGINT, o VARCHAR, w BIGINT, s BIGINT)[]"
_WAIT = lambda first: f"greatest(1, ceil((({first}) + {_SPAN}000000 - p.at) / 1000000.0))::BIGINT"
_MINE = "list_filter(p.asked, lambda y: y.c = p.c)"
_USED = "list_filter(p.used, lambda y: y.c = p.c)"


@_query(f"""
WITH {_E}, l AS (SELECT event_type, list(struct_pack(id := event_id, at := t, c := user_id, k := k, valid := value IS NOT NULL, reusable := k = 7, ends := t + (value * 60000000)::BIGINT, run := {_NONE_RUN}, asked := {_NONE_LOG}, used := {_NONE_LOG}, one := {_NONE_OUT}, out := {_NONE_OUT}) ORDER BY ts, event_id) AS l FROM e GROUP BY event_type),
r AS (SELECT list_reduce(list_concat([struct_pack(id := 0::BIGINT, at := 0::BIGINT, c := 0::BIGINT, k := 0, valid := false, reusable := false, ends := 0::BIGINT, run := {_NONE_RUN}, asked := {_NONE_LOG}, used := {_NONE_LOG}, one := {_NONE_OUT}, out := {_NONE_OUT})], l), lambda a, x:
  list_transform(list_transform([struct_pack(id := x.id, at := x.at, c := x.c, k := x.k, valid := x.valid, reusable := x.reusable, ends := x.ends,
    run := list_filter(a.run, lambda y: y.e > x.at), asked := list_filter(a.asked, lambda y: y.t > x.at - {_SPAN}000000), used := list_filter(a.used, lambda y: y.t > x.at - {_SPAN}000000), out := a.out)],
  lambda p: struct_pack(p := p, o := CASE WHEN NOT p.valid THEN 'invalid' WHEN len(list_filter(p.run, lambda y: y.k = p.k)) > 0 THEN 'duplicate'
    WHEN p.reusable AND len(p.used) < 10 AND len({_USED}) < 2 THEN 'reused' WHEN len(p.run) >= 4 THEN 'full' WHEN len(p.asked) >= 20 OR len({_MINE}) >= 3 THEN 'limited' ELSE 'queued' END)),
  lambda q: list_transform([q.p], lambda p: struct_pack(id := p.id, at := p.at, c := p.c, k := p.k, valid := p.valid, reusable := p.reusable, ends := p.ends,
    run := CASE WHEN q.o = 'queued' AND p.ends > p.at THEN list_append(p.run, struct_pack(k := p.k, e := p.ends, id := p.id)) ELSE p.run END,
    asked := CASE WHEN q.o = 'queued' THEN list_append(p.asked, struct_pack(t := p.at, c := p.c)) ELSE p.asked END,
    used := CASE WHEN q.o = 'reused' THEN list_append(p.used, struct_pack(t := p.at, c := p.c)) ELSE p.used END, one := {_NONE_OUT},
    out := list_append(p.out, struct_pack(id := p.id, o := q.o, w := CASE q.o WHEN 'full' THEN 60 WHEN 'limited' THEN CASE WHEN len(p.asked) >= 20 THEN {_WAIT('p.asked[1].t')} ELSE {_WAIT(_MINE + '[1].t')} END END,
      s := CASE WHEN q.o = 'duplicate' THEN (list_filter(p.run, lambda y: y.k = p.k))[1].id END))))[1])[1]) AS z FROM l), u AS (SELECT unnest(z.out) AS o FROM r)
SELECT o.id AS id, o.o AS outcome, CASE o.o WHEN 'invalid' THEN 400 WHEN 'full' THEN 429 WHEN 'limited' THEN 429 ELSE 202 END::INTEGER AS code, o.w AS retry_after, o.s AS same_as FROM u
""")
def submit_cascade(spark, d):
    rows = _jobs(spark, d)
    ends = F.col("at") + (F.col("seconds") * 60_000_000).cast("long")
    rows = rows.select(F.col("kind").alias("service"), F.col("job_id").alias("id"), "at", F.col("user_id").alias("client"), F.lit(3).alias("limit"), F.col("k").alias("key"), F.col("seconds").isNotNull().alias("valid"), (F.col("k") == 7).alias("reusable"), ends.alias("ends"))
    return admission.submitted(rows, _RULES)


@_query(f"""
WITH {_E} SELECT event_id AS job_id, CASE WHEN k > 3 THEN event_type ELSE video END AS title, CASE WHEN k > 5 THEN 'ar' ELSE 'en' END AS language, CASE WHEN k > 2 THEN 'v' || k::VARCHAR END AS format_version,
  coalesce(nullif(value, 0), 60.0) AS video_duration_seconds FROM e
""")
def job_facts(spark, d):
    k = F.col("k")
    result = F.struct(F.when(k > 3, F.col("kind")).otherwise(F.lit("")).alias("title"), F.lit(None).cast("string").alias("video_id"), F.lit("en").alias("language"), F.lit("fast").alias("mode"), F.lit(None).cast("string").alias("detected_language"), F.when(k > 2, F.concat(F.lit("v"), k.cast("string"))).alias("format_version"), F.col("seconds").alias("video_duration_seconds"), F.lit("x").alias("llama_folder_filenames"))
    rows = _jobs(spark, d).select("job_id", F.col("video_id").alias("title"), F.when(k > 5, "ar").alias("language"), F.lit(60.0).alias("video_duration_seconds"), result.alias("result"))
    rows = registry.result_facts(registry.without_legacy(registry.with_contract(rows)))
    return rows.select("job_id", "title", "language", "format_version", "video_duration_seconds")


@_query(f"WITH {_E} SELECT event_id::VARCHAR AS job_id, '/jobs/' || event_id || '/transcript' AS transcript_url, '/jobs/' || event_id AS status_url, event_type AS status, t AS submitted_at FROM e")
def job_answers(spark, d):
    rows = _jobs(spark, d)
    return rows.select(registry.answer(F.col("job_id").cast("string"), F.col("kind"), F.col("at")).alias("a")).select("a.*")


@_query(f"WITH {_E} SELECT event_id AS job_id FROM e WHERE coalesce(NOT k > 4, true)")
def visible_jobs(spark, d):
    return registry.visible(_jobs(spark, d).withColumn("via_gateway", F.col("k") > 4), trusted=False).select("job_id")


@_query(f"""
WITH {_E} SELECT event_id AS job_id, CASE WHEN k = 1 THEN 400 WHEN event_type = 'error' THEN 404 WHEN event_type <> 'purchase' THEN 409 WHEN k IN (2, 3) THEN 404 ELSE 200 END::INTEGER AS code FROM e
""")
def transcript_codes(spark, d):
    k, kind = F.col("k"), F.col("kind")
    status = F.when(kind == "purchase", "completed").when(kind != "error", "running")
    code = registry.transcript_code(F.when(k == 1, "other").otherwise("raw"), status, F.when(k == 2, "").otherwise("p.txt"), k != 3)
    return _jobs(spark, d).select("job_id", code.cast("int").alias("code"))


def _listed(spark, d):
    """Requests, cache, files and sidecars read from events: viewers have raw files, clickers cleaned ones, buyers cache entries."""
    rows = _jobs(spark, d)
    of = lambda kind: rows.where(F.col("kind") == kind).select("video_id").distinct()
    raw = registry.raw_name(F.col("video_id"), F.lit("en"))
    cleaned = registry.cleaned_name(F.col("video_id"), F.lit("en"), F.lit("fast"), F.lit("v1"))
    files = of("view").select(raw.alias("path")).union(of("click").select(cleaned.alias("path")))
    key = {"language": F.lit("en"), "mode": F.lit("fast")}
    cache = rows.where("kind = 'purchase'").groupBy("video_id").agg(F.max("k").alias("k")).withColumns(key | {"raw_path": raw, "cleaned_path": cleaned, "format_version": F.when(F.col("k") > 8, "v1").otherwise("v0"), "title": F.lit("from cache")})
    sidecars = of("view").select("video_id", F.lit("en").alias("language"), F.lit("from file").alias("title"), F.lit("en").alias("detected_language"), F.lit("x").alias("cleaner_provider"))
    requests = rows.select("video_id").distinct().withColumns(key | {"canonical_url": urls.canonical(F.col("video_id"))})
    return requests, cache, files, sidecars


_FILES = f"""{_E}, v AS (SELECT DISTINCT video FROM e), rawf AS (SELECT DISTINCT video FROM e WHERE event_type = 'view'), clean AS (SELECT DISTINCT video FROM e WHERE event_type = 'click'),
c AS (SELECT video, max(k) AS k FROM e WHERE event_type = 'purchase' GROUP BY video), both_ AS (SELECT video FROM rawf JOIN clean USING (video)), good AS (SELECT video FROM c JOIN both_ USING (video) WHERE k > 8)"""


@_query(f"""
WITH {_FILES} SELECT v.video AS video_id, CASE WHEN g.video IS NOT NULL THEN 'from cache' WHEN b.video IS NOT NULL THEN 'from file' END AS title, b.video IS NOT NULL AS used,
  CASE WHEN b.video IS NOT NULL THEN v.video || '_en_raw.txt' END AS raw_path, CASE WHEN b.video IS NOT NULL THEN v.video || ':en:fast:v1' END AS cache_key
FROM v LEFT JOIN both_ b USING (video) LEFT JOIN good g USING (video)
""")
def found_results(spark, d):
    rows = registry.found_results(*_listed(spark, d), "v1")
    return rows.select("video_id", "result.title", F.coalesce(F.col("result.used_cached_cleaned_transcript"), F.lit(False)).alias("used"), F.col("result.raw_transcript_path").alias("raw_path"), "result.cache_key")


@_query(f"WITH {_FILES} SELECT video AS video_id FROM c WHERE video NOT IN (SELECT video FROM good)")
def stale_entries(spark, d):
    _, cache, files, _ = _listed(spark, d)
    return registry.stale(cache, "v1", files).select("video_id")


@_query(f"WITH {_FILES} SELECT rawf.video AS video_id, CASE WHEN clean.video IS NOT NULL THEN 'fast' END AS mode FROM rawf LEFT JOIN clean USING (video)")
def raw_with_cleaned(spark, d):
    _, _, files, _ = _listed(spark, d)
    return registry.raw_with_cleaned(files, "v1").select("video_id", "mode")


@_query(f"""
WITH {_E}, s AS (SELECT video, arg_max(event_id, (ts, -event_id)) AS src FROM e WHERE event_type = 'purchase' GROUP BY video)
SELECT e.event_id AS job_id, s.src AS source_job_id, e.t AS finished_at, e.k > 4 AS via_gateway, true AS used_cached_raw, false AS used_cached_cleaned FROM e JOIN s USING (video) WHERE e.event_type = 'view'
""")
def reused_jobs(spark, d):
    rows = _jobs(spark, d).withColumns({"language": F.lit("en"), "mode": F.lit("fast"), "format_version": F.lit("v"), "status": F.when(F.col("kind") == "purchase", "completed"), "finished_at": F.col("ts"), "raw_path": F.lit("r"), "cleaned_path": F.lit("")})
    sources = registry.newest_reusable(rows, "v", spark.createDataFrame([("r",)], "path string")).select("job_id", *registry.KEYS, "raw_path", "cleaned_path")
    asked = rows.where("kind = 'view'").select(F.col("job_id").alias("id"), "video_id", "at", (F.col("k") > 4).alias("via_gateway"))
    asked = asked.join(sources.select("video_id", F.col("job_id").alias("source_job_id")), "video_id").select("source_job_id", F.col("id").alias("job_id"), "at", "via_gateway")
    return registry.reused(sources, asked).select("job_id", "source_job_id", "finished_at", "via_gateway", "used_cached_raw", "used_cached_cleaned")


@_query(f"WITH {_E} SELECT user_id AS job_id, CASE WHEN EXISTS (SELECT 1 FROM events p WHERE p.event_id = x.user_id) THEN 200 ELSE 404 END::INTEGER AS code FROM (SELECT DISTINCT user_id FROM e) x")
def looked_up_jobs(spark, d):
    rows = _jobs(spark, d)
    return registry.looked_up(rows.select(F.col("user_id").alias("job_id")).distinct(), rows.select("job_id", "kind")).select("job_id", F.col("code").cast("int").alias("code"))


@_query(f"WITH {_E} SELECT event_id AS job_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM e WHERE event_type = 'view'")
def resume_order(spark, d):
    rows = _jobs(spark, d).select("job_id", F.col("ts").alias("submitted_at"), F.when(F.col("kind") == "view", "queued").otherwise("completed").alias("status"))
    ordered = registry.resume_order(rows)
    return ordered.select("job_id", F.row_number().over(Window.orderBy(F.col("submitted_at").asc_nulls_first(), "job_id")).cast("long").alias("place"))


@_query(f"WITH {_E} SELECT video AS video_id, arg_max(video || '_' || event_id || '.mp3', (ts, video || '_' || event_id || '.mp3')) AS path FROM e GROUP BY video")
def newest_files(spark, d):
    rows = _jobs(spark, d)
    return registry.newest_file(rows.select(F.concat("video_id", F.lit("_"), F.col("job_id").cast("string"), F.lit(".mp3")).alias("path"), F.col("ts").alias("modified")))


@_query(f"""
WITH {_E}, h AS (SELECT CASE WHEN k > 4 THEN 'formatted' ELSE 'fast' END AS mode, value, row_number() OVER (PARTITION BY k > 4 ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type = 'purchase' AND value IS NOT NULL),
m AS (SELECT mode, sum(value ORDER BY r) / count(*) AS x FROM h WHERE r <= 8 GROUP BY mode),
q AS (SELECT *, CASE WHEN k > 4 THEN 'formatted' ELSE 'fast' END AS mode, CASE event_type WHEN 'click' THEN 'transcribing' WHEN 'view' THEN 'formatting' WHEN 'purchase' THEN 'downloading' ELSE 'saving' END AS stage FROM e)
SELECT event_id AS job_id, CASE WHEN k = 9 THEN 9 WHEN stage = 'transcribing' AND k = 3 THEN greatest(30, round_even(value / 3, 0)::BIGINT)
  WHEN stage = 'transcribing' THEN greatest(90, floor(x * CASE q.mode WHEN 'formatted' THEN 0.65::DOUBLE ELSE 0.8::DOUBLE END)) WHEN stage = 'formatting' THEN greatest(60, floor(x * 0.3::DOUBLE)) WHEN stage = 'downloading' THEN greatest(20, floor(x * 0.1::DOUBLE)) ELSE 15 END::BIGINT AS seconds
FROM q JOIN m USING (mode)
""")
def stage_estimates(spark, d):
    k = F.col("k")
    rows = _jobs(spark, d).withColumn("mode", F.when(k > 4, "formatted").otherwise("fast"))
    history = rows.where("kind = 'purchase'").select("job_id", "mode", "seconds", F.lit("completed").alias("status"), F.col("ts").alias("submitted_at"))
    stage = first_case([(F.col("kind") == a, F.lit(b)) for a, b in (("click", "transcribing"), ("view", "formatting"), ("purchase", "downloading"))], F.lit("saving"))
    events = rows.select("job_id", "mode", stage.alias("stage"), F.when(k == 9, 9).alias("explicit"), F.when(k == 3, F.col("seconds")).alias("duration"))
    return registry.stage_estimates(events, history).select("job_id", "seconds")


_HAS = "k > 4"


@_query(f"""
WITH {_E} SELECT event_id AS job_id, CASE WHEN round(value) < 60 THEN round(value)::BIGINT || 's' WHEN round(value)::BIGINT % 60 = 0 THEN round(value)::BIGINT // 60 || 'm' ELSE round(value)::BIGINT // 60 || 'm ' || round(value)::BIGINT % 60 || 's' END AS duration,
  CASE WHEN k > 6 THEN 'Arabic' WHEN k > 4 THEN 'French (detected)' ELSE '\u2014' END AS language, CASE WHEN k > 6 THEN 'Arabic' WHEN k > 4 THEN 'FR (detected)' ELSE 'language auto' END AS short_language,
  CASE WHEN k > 2 THEN event_type ELSE 'example.org/' || event_id END AS source, CASE WHEN k > 5 THEN 'fast output' ELSE 'better formatting' END AS mode, CASE WHEN k = 2 THEN 'archive hit' ELSE 'archive miss' END AS cache,
  CASE event_type WHEN 'purchase' THEN 'Open transcript' WHEN 'view' THEN 'Follow' ELSE 'Open details' END AS action, strftime(ts, '%Y-%m-%d %H:%M') AS day FROM e
""")
def history_labels(spark, d):
    k = F.col("k")
    asked, heard = F.when(k > 6, "ar"), F.when(k > 4, "fr")
    status = F.when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "view", "queued").otherwise("failed")
    return _jobs(spark, d).select(
        "job_id", labels.duration(F.col("seconds")).alias("duration"), labels.language(asked, heard).alias("language"), labels.short_language(asked, heard).alias("short_language"),
        labels.source(F.when(k > 2, F.col("kind")), F.concat(F.lit("https://www.example.org/"), F.col("job_id").cast("string")), F.col("job_id").cast("string")).alias("source"),
        labels.mode(F.when(k > 5, False)).alias("mode"), labels.cache(F.lit(None).cast("boolean"), k == 2).alias("cache"), labels.action(status).alias("action"), labels.day(F.col("at") / 1_000_000).alias("day"),
    )


_STOP = ", ".join(f"('{s}', '{n}', {i})" for i, (s, n) in enumerate(labels.STOPS))


@_query(f"""
WITH {_E}, s(stop, ahead, i) AS (VALUES {_STOP}), j AS (SELECT event_id, k, event_type, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, least(k, 6) AS cur FROM e),
x AS (SELECT j.*, s.*, CASE WHEN cur > 5 THEN -1 ELSE cur END AS c FROM j CROSS JOIN s)
SELECT event_id AS job_id, stop, CASE WHEN stop IN ('downloading', 'transcribing') AND event_type = 'signup' THEN 'dropped' WHEN stop = 'formatting' AND status = 'completed' AND k = 4 THEN 'failed' WHEN stop = 'formatting' AND status = 'completed' AND k = 5 THEN 'dropped'
  WHEN status = 'failed' AND c = i THEN 'failed' WHEN status = 'completed' THEN 'done' WHEN c = -1 THEN 'ahead' WHEN i < c THEN 'done' WHEN i = c THEN 'current' ELSE 'ahead' END AS state FROM x
""")
def rail_states(spark, d):
    k, kind = F.col("k"), F.col("kind")
    stage = F.get(F.array(*(F.lit(s) for s, _ in labels.STOPS)), F.least(k, F.lit(6)))
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("running")
    none = F.lit(None).cast("string")
    job = F.struct(F.coalesce(stage, F.lit("elsewhere")).alias("stage"), status.alias("status"), (kind == "signup").alias("cache_hit"), F.lit(False).alias("used_cached"), F.lit(True).alias("clean"), F.when(k == 4, "fast").otherwise("formatted").alias("result_mode"), none.alias("provider"), F.lit(False).alias("partial"), F.when(k != 5, "c.md").alias("cleaned_path"), none.alias("cleaner_error"))
    return _jobs(spark, d).select("job_id", F.inline(labels.rail(job))).select("job_id", "stop", "state")


_CLEANER = ", ".join(f"({i}, '{w[0]}', '{r}')" for i, (w, r) in enumerate(labels.CLEANER_RULES))


@_query(f"WITH {_E}, r(i, w, t) AS (VALUES {_CLEANER}) SELECT event_id AS job_id, CASE WHEN k > 6 THEN '' ELSE coalesce(r.t, 'Formatting was not to be had.') || ' Raw.' END AS said, CASE WHEN k > 6 THEN false ELSE true END AS fell_back, k = 2 AS part_way FROM e LEFT JOIN r ON r.i = e.k")
def cleaner_failures(spark, d):
    k = F.col("k")
    error = first_case([(k == i, F.lit(f"Error: {w[0].upper()}!")) for i, (w, _) in enumerate(labels.CLEANER_RULES)] + [(k > 6, F.lit(""))], F.lit("strange"))
    return _jobs(spark, d).select("job_id", labels.cleaner_failure(error, "Raw.").alias("said"), labels.fell_back(F.lit(None).cast("boolean"), F.when(k > 6, "formatted").otherwise("fast"), F.lit(None).cast("string")).alias("fell_back"), labels.stopped_part_way(k == 2, F.lit("model")).alias("part_way"))


@_query("""
SELECT page_id, regexp_extract(url, '^(https?://[^?#]*)', 1) AS link, page_id || ' of host' AS title,
  replace(replace(replace(replace(replace(substr(html, 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages
""")
def page_links(spark, d):
    path = F.concat(F.lit("C:/out/dQw4w9WgXcQ_"), F.col("page_id").cast("string"), F.lit("_of_host_english_transcript_cleanedv2.txt"))
    return _table(spark, d, "pages").select("page_id", urls.lecture_url(F.col("url")).alias("link"), urls.legacy_title(path).alias("title"), urls.escaped(F.substring("html", 1, 200)).alias("escaped"))


@_query(f"WITH {_E} SELECT event_id AS job_id, len(list_distinct([event_type, k::VARCHAR]))::INTEGER AS n FROM e")
def key_sets(spark, d):
    setting = F.concat(F.lit(" , "), F.col("kind"), F.lit(", "), F.col("k").cast("string"), F.lit(","), F.col("kind"))
    return _jobs(spark, d).select("job_id", F.size(registry.key_set(setting)).alias("n"))


@_query(f"WITH {_E} SELECT event_id AS job_id, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'transient' WHEN 2 THEN 'fatal' WHEN 3 THEN 'rejected' WHEN 4 THEN 'transient' ELSE 'ok' END AS class, CASE WHEN k > 5 THEN least(30, k * 5)::DOUBLE ELSE least(30, 2 ** k)::DOUBLE END AS wait FROM e")
def provider_answers(spark, d):
    k = F.col("k")
    code = first_case([(k == i, F.lit(c)) for i, c in enumerate((200, 429, 403, 422, 503))], F.lit(204))
    return _jobs(spark, d).select("job_id", progress.http_class(code).alias("class"), progress.backoff(k + 1, F.when(k > 5, (k * 5).cast("string"))).alias("wait"))


_OUTCOME = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'lost' WHEN event_type = 'click' THEN 'rejected' ELSE 'ok' END"


@_query(f"""
WITH {_E}, a AS (SELECT user_id AS doc_id, k AS chunk_no, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS attempt, {_OUTCOME} AS outcome FROM e),
f AS (SELECT * FROM a WHERE attempt <= 2), m AS (SELECT doc_id, chunk_no, min(attempt) FILTER (WHERE outcome IN ('ok', 'lost')) AS done, max(attempt) AS last FROM f GROUP BY ALL)
SELECT m.doc_id, m.chunk_no, coalesce(m.done, m.last)::INTEGER AS tries, f.outcome FROM m JOIN f ON f.doc_id = m.doc_id AND f.chunk_no = m.chunk_no AND f.attempt = coalesce(m.done, m.last)
""")
def chunk_attempts(spark, d):
    return progress.attempts(_attempts(spark, d)).select("doc_id", "chunk_no", F.col("tries").cast("int").alias("tries"), "outcome")


def _attempts(spark, d):
    outcome = first_case([(F.col("kind") == a, F.lit(b)) for a, b in (("error", "failed"), ("signup", "lost"), ("click", "rejected"))], F.lit("ok"))
    w = Window.partitionBy("user_id", "k").orderBy("ts", "job_id")
    return _jobs(spark, d).select(F.col("user_id").alias("doc_id"), F.col("k").alias("chunk_no"), F.row_number().over(w).alias("attempt"), outcome.alias("outcome"), (outcome != "lost").alias("retryable"))


@_query(f"""
WITH {_E}, o AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_OUTCOME} AS outcome FROM e),
g AS (SELECT *, sum(CASE WHEN outcome <> 'failed' THEN 1 ELSE 0 END) OVER w AS other, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER w AS oks FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT *, sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, other ORDER BY n) AS run FROM g),
s AS (SELECT doc_id, min(n) AS stop FROM r WHERE run >= 3 OR (outcome = 'lost' AND oks > 0) GROUP BY doc_id)
SELECT o.doc_id, count(*)::BIGINT AS chunks, count(*) FILTER (WHERE outcome = 'ok' AND coalesce(n <= stop, true))::BIGINT AS rewritten, count(*) FILTER (WHERE NOT (outcome = 'ok' AND coalesce(n <= stop, true)))::BIGINT AS fallback FROM o LEFT JOIN s USING (doc_id) GROUP BY o.doc_id
""")
def cleaner_stats(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "job_id")
    outcome = first_case([(F.col("kind") == a, F.lit(b)) for a, b in (("error", "failed"), ("signup", "lost"), ("click", "rejected"))], F.lit("ok"))
    rows = _jobs(spark, d).select(F.col("user_id").alias("doc_id"), F.row_number().over(w).alias("chunk_no"), outcome.alias("outcome"))
    return progress.chunk_stats(rows).select("doc_id", "chunks", "rewritten", "fallback")


@_query(f"""
WITH {_E}, o AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, k FROM e), t AS (SELECT job_id, min(n) AS stop FROM o WHERE event_type IN ('purchase', 'error') GROUP BY job_id)
SELECT o.job_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END, n) AS status, max(k)::INTEGER AS progress FROM o LEFT JOIN t USING (job_id) WHERE coalesce(n <= stop, true) GROUP BY o.job_id
""")
def last_states(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "job_id")
    status = F.when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "error", "failed").otherwise("running")
    return progress.last_states(_jobs(spark, d).select(F.col("user_id").alias("job_id"), F.row_number().over(w).alias("seq"), status.alias("status"), F.col("k").alias("progress")))


@_query(f"""
WITH {_E}, b AS (SELECT *, lag(event_type) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM event_type AND before IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b),
a AS (SELECT *, CASE WHEN k = 9 OR row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) = 1 THEN t END AS anchor FROM g)
SELECT event_id AS job_id, last_value(anchor IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started_at FROM a
""")
def stage_starts(spark, d):
    rows = _jobs(spark, d).withColumn("own", F.when(F.col("k") == 9, 1.0))
    return progress.started(rows, "user_id", ["ts", "job_id"], "kind", "at", "own").select("job_id", "started_at")


@_query(f"""
WITH {_E}, a AS (SELECT user_id AS job_id, 'u' AS url, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE k WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 500 END AS code FROM e),
f AS (SELECT * FROM a WHERE attempt <= 5), d AS (SELECT job_id, min(attempt) AS done FROM f WHERE code IN (200, 404) GROUP BY job_id)
SELECT f.job_id, max(attempt)::INTEGER AS tries, max(CASE WHEN code = 200 THEN 1 ELSE 0 END)::INTEGER AS ok FROM f LEFT JOIN d USING (job_id) WHERE coalesce(attempt <= done, true) GROUP BY f.job_id
""")
def deliveries(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "job_id")
    code = first_case([(F.col("k") == i, F.lit(c)) for i, c in enumerate((200, 404, 429))], F.lit(500))
    rows = _jobs(spark, d).select(F.col("user_id").alias("job_id"), F.lit("u").alias("url"), F.row_number().over(w).alias("attempt"), code.alias("code"))
    return progress.delivered(rows).select("job_id", "tries", "ok")


@_query(f"""
WITH {_E}, c AS (SELECT user_id AS job_id, 'https://host/' || k AS url, event_type AS fp, min(event_id) AS seq FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq, url) AS r FROM c),
j AS (SELECT DISTINCT user_id AS job_id FROM e WHERE event_type = 'purchase') SELECT r.job_id, r.url, sha256(r.fp) AS digest FROM r JOIN j USING (job_id) WHERE r.r <= 20
""")
def job_callbacks(spark, d):
    rows = _jobs(spark, d)
    url = registry.accepted_callback(F.concat(F.lit(" https://host/"), F.col("k").cast("string")), F.lit("key"))
    callbacks = rows.select(F.col("user_id").alias("job_id"), url.alias("url"), F.sha2(F.col("kind").cast("binary"), 256).alias("fingerprint"), F.col("job_id").alias("seq"))
    jobs = rows.where("kind = 'purchase'").select(F.col("user_id").alias("job_id"), F.lit("completed").alias("status")).distinct()
    keyed = registry.key_with_fingerprint(rows.select(F.col("kind").alias("key")).distinct(), registry.callbacks_of(jobs, callbacks))
    return keyed.select("job_id", "url", F.col("fingerprint").alias("digest"))


@_query(f"""
WITH {_E} SELECT event_id AS job_id, CASE WHEN k > 4 THEN 'user:' || user_id WHEN k > 2 THEN 'gateway:1.2.3.4' ELSE 'ip:1.2.3.4' END AS client, CASE WHEN k > 2 THEN 6 ELSE 3 END::INTEGER AS "limit",
  k > 6 OR k = 0 OR value < 900 AS needed, CASE WHEN value - k > 5 THEN value - k END AS left_s, video || ':en:' || CASE WHEN k > 4 THEN 'formatted' ELSE 'fast' END || ':v1' AS cache_key FROM e
""")
def caller_keys(spark, d):
    k = F.col("k")
    client = limits.client_key(k > 2, F.when(k > 4, F.col("user_id").cast("string")).otherwise(F.lit("not a name!")), F.lit("1.2.3.4"))
    return _jobs(spark, d).select(
        "job_id", client["client"].alias("client"), client["limit"].cast("int").alias("limit"), limits.needed(F.col("seconds"), (k > 6).cast("int"), (k == 0).cast("int"), F.lit(0.0)).alias("needed"),
        progress.remaining(F.col("seconds"), F.lit(0.0), k.cast("double")).alias("left_s"), registry.cache_key(F.col("video_id"), F.lit("en"), registry.mode_of(k > 4), F.lit("v1")).alias("cache_key"),
    )


@_query("""
WITH o AS (SELECT doc_id, text, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS o FROM documents)
SELECT doc_id AS part_no, floor(o / 300)::INTEGER AS part, n_chars > 300 AS split, round(o + 1.5, 2) AS first_start, length(CASE WHEN n_chars > 300 THEN text || '!' ELSE text END)::INTEGER AS n, CASE WHEN n_chars > 300 THEN 2 ELSE 1 END::INTEGER AS uses FROM o
""")
def part_answers(spark, d):
    rows = votes.offsets(_docs(spark, d).select(F.col("source").alias("lecture"), F.col("doc_id").alias("part_no"), "text", F.col("n_chars").alias("duration")))
    segments = F.array(F.struct(F.lit(1.5).alias("start"), F.lit(2.0).alias("end"), F.lit(" said ").alias("text")), F.struct(F.lit(0.0).alias("start"), F.lit(9.0).alias("end"), F.lit(" ").alias("text")))
    long = F.col("duration") > 300
    answer = lambda t, u: F.struct(t.alias("text"), votes.shifted(segments, F.col("offset")).alias("segments"), F.lit("en").alias("reported"), u.alias("usage"))
    one, none = F.array(F.lit("u")), F.array().cast("array<string>")
    rows = rows.withColumn("m", votes.merged(answer(F.col("text"), one), answer(F.when(long, F.concat("text", F.lit("!"))).otherwise(F.lit(" ")), F.when(long, one).otherwise(none))))
    return rows.select("part_no", votes.part_of(F.col("offset")).alias("part"), votes.needs_split(F.col("duration"), F.lit(0)).alias("split"), F.col("m.segments")[0]["start"].alias("first_start"), F.length("m.text").alias("n"), F.size("m.usage").alias("uses"))


@_query(rf"""
SELECT doc_id, length('The source has ' || len({_TOKENS}) || ' words:' || chr(10) || chr(10) || coalesce(text, ''))::INTEGER AS n_user, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name,
  regexp_matches(coalesce(text, ''), '[\x{{600}}-\x{{6ff}}]') AS arabic FROM documents
""")
def prompt_sizes(spark, d):
    t = F.col("text")
    named = F.regexp_extract(prompts.system(F.col("lang")), r"The lecture is in (\w+)\.", 1)
    again = F.length(prompts.again(t, F.lit("too_short"))) - F.lit(len(prompts.AGAIN["too_short"]) + 1)
    return _docs(spark, d).select("doc_id", again.cast("int").alias("n_user"), named.alias("name"), lg.has_arabic_script(t).alias("arabic"))


_BAD = [(a, b) for a, b in tx.MOJIBAKE]
_REPAIRED = "text"
for _a, _b in _BAD:
    _REPAIRED = f"replace({_REPAIRED}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@_query(rf"SELECT doc_id, length(regexp_replace(regexp_replace({_REPAIRED}, '\x{{c2}}([\x{{a1}}-\x{{bf}}])', '\1', 'g'), '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2069}}\x{{feff}}]', '', 'g'))::INTEGER AS n FROM documents")
def mended_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.length(tx.visible(tx.repaired(F.col("text")))).alias("n"))


@_query("SELECT count(*) FILTER (WHERE event_type IN ('view', 'click')) > 0 AS active, count(*) FILTER (WHERE event_type IN ('view', 'click'))::BIGINT AS n_active FROM events")
def active_jobs(spark, d):
    status = F.when(F.col("kind") == "view", "queued").when(F.col("kind") == "click", "running").otherwise("completed")
    return registry.is_active(_jobs(spark, d).select(status.alias("status")))
