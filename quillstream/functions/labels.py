"""Columns that say in words how a job stands (own wording where no value is fixed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import languages
from .columns import filled, first_case
from .urls import legacy_title

#: Stops of a job's way: key, note while ahead.
STOPS = (("queued", "waiting"), ("checking_cache", "archive"), ("downloading", "audio"), ("transcribing", "speech"), ("formatting", "layout"), ("saving", "files"))
SKIPPED_ON_HIT = ("downloading", "transcribing")
#: Ordered: words of a cleaner's error, what it means.
CLEANER_RULES = (
    (("401", "unauthorized", "expired"), "Formatting is switched off for now."),
    (("429", "rate limit", "quota"), "Formatting is busy."),
    (("timeout", "timed out"), "Formatting ran out of time."),
    (("connection", "refused", "ollama"), "Formatting did not answer."),
)


def duration(seconds: Column) -> Column:
    """45s, 3m, 3m 20s; rounded half up, never below nothing."""
    n = F.greatest(F.lit(0), F.floor(F.coalesce(F.nanvl(seconds.cast("double"), F.lit(0.0)), F.lit(0.0)) + 0.5)).cast("long")
    minutes, rest = F.floor(n / 60).cast("string"), n % 60
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(rest == 0, F.concat(minutes, F.lit("m"))).otherwise(F.concat(minutes, F.lit("m "), rest.cast("string"), F.lit("s")))


def _asked(requested: Column, detected: Column, name, unknown: Column) -> Column:
    automatic = F.coalesce(requested, F.lit("")).isin("", "auto")
    return F.when(~automatic, name(requested)).when(filled(detected).isNotNull(), F.concat(name(detected), F.lit(" (detected)"))).otherwise(unknown)


def language(requested: Column, detected: Column) -> Column:
    """The requested language by name, or what was detected in its place."""
    name = lambda c: F.coalesce(languages.name_of(c), F.upper(c))
    return _asked(requested, detected, name, F.when(requested == "auto", "Detecting").otherwise(F.lit("\u2014")))


def short_language(requested: Column, detected: Column) -> Column:
    """The same for a list of jobs, where only two names are spelt out."""
    name = lambda c: F.when(c == "ar", "Arabic").when(c == "en", "English").otherwise(F.upper(c))
    return _asked(requested, detected, name, F.lit("language auto"))


def title(title: Column, raw_path: Column, cleaned_path: Column) -> Column:
    """A job's title, else one from its old file name, else a general one."""
    return F.coalesce(filled(title), legacy_title(filled(raw_path, cleaned_path)), F.lit("Lecture transcript"))


def source(title: Column, url: Column, job_id: Column) -> Column:
    """Title, else URL without scheme and www., else id."""
    return F.coalesce(filled(title), F.regexp_replace(filled(url), r"^https?://(www\.)?", ""), job_id)


def mode(clean: Column) -> Column:
    return F.when(F.coalesce(clean, F.lit(True)), "better formatting").otherwise("fast output")


def cache(cleaned_hit: Column, raw_hit: Column) -> Column:
    return F.when(F.coalesce(cleaned_hit, F.lit(False)) | F.coalesce(raw_hit, F.lit(False)), "archive hit").otherwise("archive miss")


def action(status: Column) -> Column:
    return F.when(status == "completed", "Open transcript").when(status.isin("running", "queued"), "Follow").otherwise("Open details")


def day(submitted_at: Column) -> Column:
    """Date and time of a job's submission in the session's time zone; a dash if unknown."""
    return F.coalesce(F.date_format(F.timestamp_seconds(submitted_at), "yyyy-MM-dd HH:mm"), F.lit("\u2014"))


def cleaner_failure(error: Column, outcome: str = "The transcript is shown as it was heard.") -> Column:
    """Why formatting failed, and what is shown instead; empty without an error."""
    text = F.lower(error)
    rules = []
    for words, reason in CLEANER_RULES:
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(text, F.lit(w))
        rules.append((hit, F.lit(f"{reason} {outcome}")))
    return F.when(F.coalesce(error, F.lit("")) == "", "").otherwise(first_case(rules, F.lit(f"Formatting was not to be had. {outcome}")))


def fell_back(clean: Column, result_mode: Column, provider: Column) -> Column:
    """Whether formatting was asked for and the plain layout came."""
    return F.coalesce(clean, F.lit(True)) & (F.coalesce(result_mode == "fast", F.lit(False)) | F.coalesce(provider == "formatter", F.lit(False)))


def stopped_part_way(partial: Column, provider: Column) -> Column:
    return F.coalesce(partial, F.lit(False)) & ~F.coalesce(provider == "formatter", F.lit(False))


def rail(job: Column) -> Column:
    """Array of (stop, state, note) of a job, a struct of stage, status, cache_hit, used_cached, clean, result_mode, provider, partial, cleaned_path, cleaner_error."""
    keys = [k for k, _ in STOPS]
    stage = F.when(job["stage"] == "cache_hit", "checking_cache").otherwise(job["stage"])
    current = F.coalesce(F.array_position(F.array(*map(F.lit, keys)), stage), F.lit(0)) - 1  # -1: at none of them
    completed = F.coalesce(job["status"] == "completed", F.lit(False))
    state = lambda s, note: F.struct(F.lit(s).alias("state"), (F.lit(note) if isinstance(note, str) else note).alias("note"))
    out = []
    for i, (key, note) in enumerate(STOPS):
        rules = []
        if key in SKIPPED_ON_HIT:
            rules.append((F.coalesce(job["cache_hit"], F.lit(False)), state("dropped", "not needed")))
        if key == "formatting":
            part = stopped_part_way(job["partial"], job["provider"])
            rules += [
                (completed & F.coalesce(job["used_cached"], F.lit(False)), state("dropped", "not needed")),
                (completed & fell_back(job["clean"], job["result_mode"], job["provider"]), state("failed", F.when(part, "partly done").otherwise("unavailable"))),
                (completed & filled(job["cleaned_path"]).isNull() & filled(job["cleaner_error"]).isNotNull(), state("failed", "unavailable")),
                (completed & filled(job["cleaned_path"]).isNull(), state("dropped", "not applied")),
            ]
        rules += [
            (F.coalesce(job["status"] == "failed", F.lit(False)) & (current == i), state("failed", "stopped here")),
            (completed, state("done", "done")),
            (current == -1, state("ahead", note)),
            (current > i, state("done", "done")),
            (current == i, state("current", "now")),
        ]
        own = first_case(rules, state("ahead", note))
        out.append(F.struct(F.lit(key).alias("stop"), own["state"].alias("state"), own["note"].alias("note")))
    return F.array(*out)
