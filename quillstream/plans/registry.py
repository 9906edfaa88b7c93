"""Jobs and their cache: keyed reuse, duplicates, queue order, history, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.functions import languages
from quillstream.functions.columns import filled, first_case, let

ACTIVE = ("queued", "running")
FINISHED = ("completed", "failed")
REQUEST_FIELDS = ("youtube_url", "clean", "skip_audio_cache", "use_cached_outputs", "language")
CONTRACT_FIELDS = ("title", "video_id", "language", "mode", "detected_language", "format_version", "video_duration_seconds")
KEYS = ("video_id", "language", "mode")
HISTORY = 500
MOST_CALLBACKS = 20
#: Ordered rules: words of an error, what to tell (own wording; the words are fixed values).
ERROR_RULES = (
    (("read-only file system",), "The download session could not be written; check the temporary directory."),
    (("http error 403", "unable to download video data", "unable to extract", "nsig extraction failed"), "The video host refused the download; update the downloader."),
    (("sign in to confirm", "confirm you're not a bot"), "The video host asks for a sign-in; pass cookies or change the network."),
    (("private video", "video unavailable", "removed by the uploader", "not available in your country"), "The video cannot be reached from here."),
    (("members-only", "join this channel"), "The video is for members only."),
    (("age-restricted", "age restricted", "inappropriate for some users"), "The video is age-restricted."),
    (("ffmpeg", "ffprobe"), "The audio converter is missing."),
    (("cuda", "cudnn", "out of memory"), "The accelerator refused; free its memory or use the CPU."),
)


def mode_of(clean: Column) -> Column:
    return F.when(F.coalesce(clean, F.lit(True)), "formatted").otherwise("fast")


def cache_key(video: Column, language: Column, mode: Column, version: Column) -> Column:
    return F.concat_ws(":", video, language, mode, version)


def pipeline_request(request: DataFrame) -> DataFrame:
    """The fields that a pipeline run may see."""
    return request.select(*(c for c in REQUEST_FIELDS if c in request.columns))


#: Fields of a job that every answer holds, and their types.
SNAPSHOT = {"title": "string", "video_id": "string", "language": "string", "mode": "string", "detected_language": "string", "format_version": "string", "video_duration_seconds": "double"}


def with_contract(jobs: DataFrame) -> DataFrame:
    """jobs with every contract field, a null of its type where it was missing."""
    return jobs.withColumns({c: F.lit(None).cast(kind) for c, kind in SNAPSHOT.items() if c not in jobs.columns})


def without_legacy(jobs: DataFrame, fields: tuple[str, ...] = ("llama_folder_filenames",)) -> DataFrame:
    """jobs whose result (a struct) has no obsolete fields."""
    return jobs.withColumn("result", F.col("result").dropFields(*fields)) if "result" in jobs.columns else jobs


def result_facts(jobs: DataFrame) -> DataFrame:
    """jobs with the lecture facts of a completed run: the result's value, else the job's; the language prefers the job, the version is never the job's."""
    pick = {c: filled(F.col(f"result.{c}"), F.col(c)) for c in ("title", "video_id", "mode", "detected_language")}
    pick["language"] = filled(F.col("language"), F.col("result.language"))
    pick["format_version"] = F.col("result.format_version")
    pick["video_duration_seconds"] = F.coalesce(F.nullif(F.col("result.video_duration_seconds"), F.lit(0.0)), F.nullif(F.col("video_duration_seconds"), F.lit(0.0)))
    return jobs.withColumns(pick)


def answer(job_id: Column, status: Column, submitted_at: Column) -> Column:
    """What a submission is told: its id, state and where to ask."""
    base = F.concat(F.lit("/jobs/"), job_id)
    return F.struct(job_id.alias("job_id"), status.alias("status"), base.alias("status_url"), F.concat(base, F.lit("/transcript")).alias("transcript_url"), submitted_at.alias("submitted_at"))


def visible(jobs: DataFrame, trusted: bool) -> DataFrame:
    """Jobs that a caller may list: all with a key, else those not submitted with one."""
    return jobs if trusted else jobs.where(~F.coalesce("via_gateway", F.lit(False)))


def looked_up(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """wanted (job_id) with the job's columns and a code, 200 or 404."""
    found = jobs.withColumn("_there", F.lit(True))
    return wanted.join(found, "job_id", "left").withColumn("code", F.when(F.col("_there"), 200).otherwise(404)).drop("_there")


def transcript_code(kind: Column, status: Column, path: Column, there: Column) -> Column:
    """Code of a request for a transcript; status is null for unknown jobs, there says whether the file is."""
    return first_case([(~F.coalesce(kind.isin("cleaned", "raw"), F.lit(False)), 400), (status.isNull(), 404), (status != "completed", 409), (filled(path).isNull() | ~F.coalesce(there, F.lit(False)), 404)], F.lit(200))


def reused(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Completed jobs made from saved ones: requests (source_job_id, job_id, at, via_gateway) meet sources (job_id, contract fields, paths)."""
    own = sources.withColumnRenamed("job_id", "source_job_id").drop("submitted_at", "started_at", "finished_at", "via_gateway", "status", "error")
    rows = requests.join(own, "source_job_id").withColumns({"submitted_at": F.col("at"), "started_at": F.col("at"), "finished_at": F.col("at")}).drop("at")
    hit = {"used_cached_cleaned": filled(F.col("cleaned_path")).isNotNull(), "used_cached_raw": filled(F.col("raw_path")).isNotNull()}
    return rows.withColumns(hit | {"status": F.lit("completed"), "cached": F.lit(True), "error": F.lit(None).cast("string"), "audio_path": F.lit(None).cast("string")})


def resume_order(jobs: DataFrame) -> DataFrame:
    """Queued jobs in the order in which they run after a restart."""
    return jobs.where("status = 'queued'").orderBy(F.col("submitted_at").asc_nulls_first(), "job_id")


def newest_file(files: DataFrame) -> DataFrame:
    """video_id, path: the file of each id (path, modified) that changed last."""
    id = F.regexp_extract(F.col("path"), r"([A-Za-z0-9_-]{11})_[^/]*\.mp3$", 1)
    return files.withColumn("video_id", id).where("video_id <> ''").groupBy("video_id").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def key_set(setting: Column) -> Column:
    """Distinct trimmed entries of a comma-separated setting."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def is_active(jobs: DataFrame) -> DataFrame:
    """One row: active (whether any job is), n_active."""
    here = F.col("status").isin(*ACTIVE)
    return jobs.agg(F.coalesce(F.bool_or(here), F.lit(False)).alias("active"), F.count_if(here).alias("n_active"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def first_active(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests whose key a queued or running job has already, with the earliest such job."""
    own = jobs.where(F.col("status").isin(*ACTIVE)).groupBy(*KEYS).agg(F.min(F.struct("submitted_at", "job_id"))["job_id"].alias("active_job"))
    return requests.join(own, list(KEYS))


def _with_files(rows: DataFrame, files: DataFrame, *paths: str) -> DataFrame:
    """rows with a column _<path> for each path, true where the file is there."""
    for path in paths:
        there = files.select(F.col("path").alias(path)).distinct().withColumn(f"_{path}", F.lit(True))
        rows = rows.join(there, path, "left").withColumn(f"_{path}", F.coalesce(f"_{path}", F.lit(False)))
    return rows


def newest_reusable(jobs: DataFrame, version: str, files: DataFrame | None = None) -> DataFrame:
    """Newest completed job of each key in this version, whose files (if given, by path) are all there.

    With files, a job must name one at least, and a formatted one a cleaned transcript; the mode of its result
    (result_mode, if the column is there) must be its own.
    """
    rows = jobs.where((F.col("status") == "completed") & (F.col("format_version") == version))
    if "result_mode" in jobs.columns:
        rows = rows.where(F.coalesce(F.col("result_mode") == F.col("mode"), F.lit(True)))
    if files is not None:
        raw, cleaned = filled(F.col("raw_path")), filled(F.col("cleaned_path"))
        rows = _with_files(rows, files, "raw_path", "cleaned_path")
        rows = rows.where((raw.isNull() | F.col("_raw_path")) & (cleaned.isNull() | F.col("_cleaned_path")) & F.coalesce(raw, cleaned).isNotNull())
        rows = rows.where((F.col("mode") != "formatted") | cleaned.isNotNull()).drop("_raw_path", "_cleaned_path")
    w = Window.partitionBy(*KEYS).orderBy(F.col("finished_at").desc(), "job_id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def queue_rank(jobs: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """job_id, ahead: running jobs and queued ones submitted strictly earlier; a job without a time counts as submitted at 0.

    Times are summed by slice first, so one task orders the slices (some thousands a year), and each slice its own times.
    """
    running = jobs.where("status = 'running'").agg(F.count("*").alias("running"))
    at = F.coalesce(F.col("submitted_at").cast("timestamp").cast("double"), F.lit(0.0))
    queued = jobs.where("status = 'queued'").select("job_id", at.alias("at"))
    times = queued.groupBy("at").agg(F.count("*").alias("n")).withColumn("slice", F.floor(F.col("at") / slice_seconds))
    slices = times.groupBy("slice").agg(F.sum("n").alias("n"))
    slices = slices.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(slices, "slice")
    times = times.select("at", (F.col("base") + F.col("own")).alias("earlier"))
    return queued.join(times, "at").join(F.broadcast(running)).select("job_id", (F.col("running") + F.col("earlier")).alias("ahead"))


def trimmed(jobs: DataFrame, most: int = HISTORY) -> DataFrame:
    """jobs without the oldest finished ones beyond so many; active ones and those with notices on their way stay."""
    age = F.coalesce("finished_at", "submitted_at")
    gone = jobs.where(F.col("status").isin(*FINISHED) & ~F.coalesce("notices", F.lit(False)))
    old = gone.select("job_id", age.alias("age")).orderBy(F.col("age").desc(), F.col("job_id").desc()).limit(most)
    return jobs.join(gone.select("job_id").join(old, "job_id", "left_anti"), "job_id", "left_anti")


def search(jobs: DataFrame, words: str, status: str = "all") -> DataFrame:
    """Jobs whose id, title or URL holds the words and that have the status, newest first."""
    text = F.lower(F.concat_ws(" ", "job_id", "title", "url"))
    hit = F.contains(text, F.lit(words.lower()))
    if status != "all":
        hit &= F.col("status") == status
    return jobs.where(hit).orderBy(F.coalesce("submitted_at", F.lit(0)).desc(), "job_id")


def described(error: Column) -> Column:
    """An error with the first hint that fits it."""
    out = error
    for words, hint in reversed(ERROR_RULES):
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(F.lower(error), F.lit(w))
        out = F.when(hit, F.concat(F.lit(hint + " ("), error, F.lit(")"))).otherwise(out)
    return out


def duration_estimate(seconds: Column) -> Column:
    return F.when(seconds > 0, F.greatest(F.lit(30.0), F.bround(seconds / 3, 0))).cast("long")


def recent_mean(jobs: DataFrame, last: int = 8) -> DataFrame:
    """mode, mean seconds of the last so many completed jobs of each mode by submission, and the estimates made from it."""
    w = Window.partitionBy("mode").orderBy(F.col("submitted_at").desc(), F.col("job_id").desc())
    rows = jobs.where("status = 'completed' AND seconds IS NOT NULL").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    mean = rows.groupBy("mode").agg((F.sum("seconds") / F.count("*")).alias("mean_seconds"))
    share = lambda x, least: F.greatest(F.lit(least), F.floor(F.col("mean_seconds") * x)).cast("long")
    transcribe = F.when(F.col("mode") == "formatted", share(0.65, 90)).otherwise(share(0.8, 90))
    return mean.select("mode", "mean_seconds", transcribe.alias("transcribing"), share(0.3, 60).alias("formatting"), share(0.1, 20).alias("downloading"))


def stage_estimates(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """events (stage, mode, explicit, duration) with seconds: the event's own estimate, else a third of the duration while transcribing, else from
    the mean of the last jobs of the mode, else the stage's default."""
    from .progress import estimate

    recent = recent_mean(jobs).select("mode", *(F.col(c).alias(f"_{c}") for c in ("transcribing", "formatting", "downloading")))
    own = first_case([(F.col("stage") == c, F.col(f"_{c}")) for c in ("transcribing", "formatting", "downloading")])
    explicit = F.when(F.col("explicit") != 0, F.greatest(F.lit(0), F.col("explicit").cast("long")))
    by_duration = F.when((F.col("stage") == "transcribing") & (F.col("duration") != 0), F.greatest(F.lit(30), F.bround(F.col("duration") / 3, 0).cast("long")))
    seconds = F.coalesce(explicit, by_duration, own, estimate(F.col("stage")).cast("long"))
    return events.join(F.broadcast(recent), "mode", "left").withColumn("seconds", seconds).drop("_transcribing", "_formatting", "_downloading")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cache entries of both, the new one where there is one, under the time that the key was first written."""
    a = old.select(key, F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"), F.col("value").alias("_value"))
    both = a.join(new, key, "full")
    return both.select(key, F.coalesce("_created", "created_at").alias("created_at"), F.coalesce("updated_at", "_updated").alias("updated_at"), F.coalesce("value", "_value").alias("value"))


def _judged(cache: DataFrame, version: str, files: DataFrame) -> DataFrame:
    """cache with _valid: of this version, with both files named and there."""
    rows = _with_files(cache, files, "raw_path", "cleaned_path")
    valid = F.coalesce(F.col("format_version") == version, F.lit(False)) & F.col("_raw_path") & F.col("_cleaned_path")
    return rows.withColumn("_valid", valid).drop("_raw_path", "_cleaned_path")


def cached(cache: DataFrame, version: str, files: DataFrame) -> DataFrame:
    """Entries that may be served."""
    return _judged(cache, version, files).where("_valid").select(*cache.columns)


def stale(cache: DataFrame, version: str, files: DataFrame) -> DataFrame:
    """Entries of another version or of none, or without one of their two files: those to be removed."""
    return _judged(cache, version, files).where("NOT _valid").select(*cache.columns)


def raw_name(video: Column, language: Column) -> Column:
    return F.concat(video, F.lit("_"), languages.label(language), F.lit("_raw.txt"))


def metadata_name(video: Column, language: Column) -> Column:
    return F.concat(video, F.lit("_"), languages.label(language), F.lit("_raw.json"))


def cleaned_name(video: Column, language: Column, mode: Column, version: Column) -> Column:
    return F.concat(video, F.lit("_"), languages.label(language), F.lit("_"), mode, F.lit("_"), version, F.lit(".md"))


def raw_files(files: DataFrame) -> DataFrame:
    """video_id, language, raw_path of files (path) named as raw transcripts."""
    name = r"([A-Za-z0-9_-]{11})_([a-z]{2}|auto)_raw\.txt$"
    pick = lambda k: F.regexp_extract("path", name, k)
    return files.where(F.col("path").rlike(name)).select(pick(1).alias("video_id"), pick(2).alias("language"), F.col("path").alias("raw_path"))


def cleaned_files(files: DataFrame, version: str) -> DataFrame:
    """video_id, language, mode, cleaned_path of files named as cleaned transcripts of this version."""
    name = rf"([A-Za-z0-9_-]{{11}})_([a-z]{{2}}|auto)_(formatted|fast)_{version}\.md$"
    pick = lambda k: F.regexp_extract("path", name, k)
    return files.where(F.col("path").rlike(name)).select(pick(1).alias("video_id"), pick(2).alias("language"), pick(3).alias("mode"), F.col("path").alias("cleaned_path"))


def raw_with_cleaned(files: DataFrame, version: str) -> DataFrame:
    """Raw transcripts with the cleaned ones of the same video, null where there is none."""
    return raw_files(files).join(cleaned_files(files, version).select("video_id", "mode", "cleaned_path"), "video_id", "left")


def rebuilt(files: DataFrame, sidecars: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Entries that the cache has lost: both files are there by name; facts come from sidecars (video_id, language, title, detected_language, cleaner_provider)."""
    both = cleaned_files(files, version).join(raw_files(files), ["video_id", "language"])
    lost = both.join(cache.select(*KEYS), list(KEYS), "left_anti")
    rows = lost.join(sidecars, ["video_id", "language"], "left")
    provider = F.when(F.col("mode") == "formatted", F.col("cleaner_provider")).otherwise(F.lit("formatter"))
    return rows.withColumns({"cleaner_provider": provider, "format_version": F.lit(version)})


def empty_result(video: Column, url: Column, language: Column, mode: Column, version: str) -> Column:
    """The result of a run that has done nothing yet."""
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    false = lambda *names: [F.lit(False).alias(n) for n in names]
    return F.struct(
        cache_key(video, languages.label(language), mode, F.lit(version)).alias("cache_key"),
        url.alias("canonical_url"), video.alias("video_id"), languages.label(language).alias("language"), mode.alias("mode"), mode.alias("requested_mode"), F.lit(version).alias("format_version"),
        *nothing("string", "title", "detected_language", "audio_path", "raw_transcript_path", "cleaned_transcript_path", "transcription_info", "transcription_provider", "cleaner_provider", "cleaner_error", "cleaner_stats", "audio_delete_error"),
        *nothing("double", "video_duration_seconds", "whisper_estimate_seconds"),
        *false("used_cached_raw_transcript", "used_cached_cleaned_transcript", "cleaner_partial", "audio_deleted"),
    )


def found_results(requests: DataFrame, cache: DataFrame, files: DataFrame, sidecars: DataFrame, version: str) -> DataFrame:
    """requests (video_id, language, mode, canonical_url) with result: from the cache, else rebuilt from files, else null."""
    facts = ["title", "detected_language", "cleaner_provider", "raw_path", "cleaned_path"]
    known = lambda rows, p: rows.select(*KEYS, F.struct(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in facts)).alias(p))
    rows = requests.join(known(cached(cache, version, files), "_hit"), list(KEYS), "left").join(known(rebuilt(files, sidecars, cached(cache, version, files), version), "_file"), list(KEYS), "left")
    entry = F.coalesce("_hit", "_file")
    result = empty_result(F.col("video_id"), F.col("canonical_url"), F.col("language"), F.col("mode"), version)
    names = {"title": "title", "detected_language": "detected_language", "cleaner_provider": "cleaner_provider", "raw_path": "raw_transcript_path", "cleaned_path": "cleaned_transcript_path"}
    for own, name in names.items():
        result = result.withField(name, entry[own])
    result = result.withField("used_cached_cleaned_transcript", F.lit(True))
    return rows.withColumn("result", F.when(entry.isNotNull(), result)).drop("_hit", "_file")


def callbacks_of(jobs: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Registered callbacks of finished jobs, at most twenty different ones a job, the first registered."""
    first = callbacks.groupBy("job_id", "url", "fingerprint").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("job_id").orderBy("seq", "url")
    few = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MOST_CALLBACKS).drop("_r")
    return jobs.where(F.col("status").isin(*FINISHED)).select("job_id", "status").join(few, "job_id")


def accepted_callback(url: Column, key: Column, plain_http: bool = False) -> Column:
    """The trimmed URL if a notice may be sent there."""
    url = F.trim(url)
    sound = url.rlike(r"(?i)^https?://[^/?#\s]+" if plain_http else r"(?i)^https://[^/?#\s]+")
    return F.when((F.length(key) > 0) & (F.length(url) <= 2048) & sound, url)


def key_with_fingerprint(keys: DataFrame, callbacks: DataFrame) -> DataFrame:
    """callbacks with the key whose SHA-256 they name."""
    return callbacks.join(keys.select("key", F.sha2(F.col("key").cast("binary"), 256).alias("fingerprint")), "fingerprint")


def signature(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 of a message, in hex, from two rounds of SHA-256; a key over 64 bytes is digested first, as the standard has it."""
    own = key.cast("binary")
    own = F.when(F.octet_length(own) > 64, F.unhex(F.sha2(own, 256))).otherwise(own)
    places = F.sequence(F.lit(0), F.lit(63))

    def padded(raw: Column, byte: int) -> Column:
        at = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))
        return F.unhex(F.array_join(F.transform(places, lambda i: F.lpad(F.hex(at(i)), 2, "0")), ""))

    def signed(raw: Column) -> Column:
        inner = F.unhex(F.sha2(F.concat(padded(raw, 0x36), message.cast("binary")), 256))
        return F.sha2(F.concat(padded(raw, 0x5C), inner), 256)

    return let(F.rpad(F.hex(own), 128, "0"), signed)
