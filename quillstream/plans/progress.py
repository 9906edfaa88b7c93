"""Progress of jobs from their events: percent, steps, stage runs, states, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stage: percent, step, seconds (fixed values).
STAGES = {"queued": (0, 0, 30), "checking_cache": (5, 1, 10), "cache_hit": (95, 4, 5), "downloading": (15, 2, 60), "transcribing": (35, 3, 360), "formatting": (72, 4, 240), "saving": (95, 5, 15), "completed": (100, 5, 0), "failed": (100, 0, 0)}


def _by_stage(stage: Column, k: int) -> Column:
    out = None
    for name, values in STAGES.items():
        out = F.when(stage == name, values[k]) if out is None else out.when(stage == name, values[k])
    return out.otherwise(STAGES["queued"][k])


def percent(stage: Column, index: Column, total: Column) -> Column:
    """Whole percent of a stage, within it by its chunks."""
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / total))
    some = F.coalesce(total, F.lit(0)) > 0
    begun = F.coalesce(F.nullif(index, F.lit(0)), F.lit(1)) - 1
    return (
        F.when((stage == "transcribing") & some, 35 + F.floor(share(begun) * 35))
        .when((stage == "formatting") & some, 72 + F.floor(share(F.coalesce(index, F.lit(0))) * 22))
        .otherwise(_by_stage(stage, 0))
        .cast("int")
    )


def step(stage: Column, clean: Column) -> Column:
    total = F.when(clean, 5).otherwise(4)
    return F.when(~clean & stage.isin("saving", "completed"), total).otherwise(F.least(_by_stage(stage, 1), total))


def estimate(stage: Column) -> Column:
    return _by_stage(stage, 2)


def monotone(events: DataFrame, job: str, order: list[str], value: str) -> DataFrame:
    """events with the largest value so far in their job."""
    return events.withColumn("progress", F.max(value).over(Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def stage_runs(events: DataFrame, job: str, order: list[str], stage: str) -> DataFrame:
    """events with the number of their run of one stage."""
    w = Window.partitionBy(job).orderBy(*order)
    new = (~F.col(stage).eqNullSafe(F.lag(stage).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return events.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def started(events: DataFrame, job: str, order: list[str], stage: str, at: str, explicit: str) -> DataFrame:
    """events with the time their stage's countdown starts: the run's first, or that of the last event with its own estimate."""
    runs = stage_runs(events, job, order, stage)
    w = Window.partitionBy(job, "run").orderBy(*order)
    anchor = F.when(F.col(explicit).isNotNull() | (F.row_number().over(w) == 1), F.col(at))
    return runs.withColumn("_anchor", anchor).withColumn("started_at", F.last("_anchor", ignorenulls=True).over(w)).drop("_anchor")


def last_states(events: DataFrame) -> DataFrame:
    """job_id, status, progress: the state after all events (job_id, seq, status, progress); the first terminal one is final."""
    w = Window.partitionBy("job_id").orderBy("seq")
    ended = F.coalesce(F.max(F.col("status").isin("completed", "failed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("_ended", ended).where("_ended = 0")
    return rows.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("progress").alias("progress"))


def chunk_stop(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, stop_at: the chunk where so many failures in a row, or a lost provider after a success, stop the rewriting.

    outcomes (doc_id, chunk_no, outcome): ok, failed, rejected or lost.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    rows = outcomes.withColumn("_other", F.sum((F.col("outcome") != "failed").cast("int")).over(w))
    run = Window.partitionBy("doc_id", "_other").orderBy("chunk_no")
    rows = rows.withColumn("_row", F.sum((F.col("outcome") == "failed").cast("int")).over(run))
    rows = rows.withColumn("_ok", F.sum((F.col("outcome") == "ok").cast("int")).over(w))
    stop = (F.col("_row") >= most) | ((F.col("outcome") == "lost") & (F.col("_ok") > 0))
    return rows.where(stop).groupBy("doc_id").agg(F.min("chunk_no").alias("stop_at"))


def chunk_stats(outcomes: DataFrame) -> DataFrame:
    """doc_id, chunks, rewritten, fallback, rejections by reason."""
    stops = chunk_stop(outcomes)
    rows = outcomes.join(stops, "doc_id", "left").withColumn("used", F.coalesce(F.col("chunk_no") <= F.col("stop_at"), F.lit(True)) & (F.col("outcome") == "ok"))
    wrong = rows.where(F.col("outcome") != "ok").groupBy("doc_id", "outcome").agg(F.count("*").alias("n"))
    wrong = wrong.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("rejections"))
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("used").alias("rewritten"), F.count_if(~F.col("used")).alias("fallback"))
    return sums.join(wrong, "doc_id", "left")


def delivered(attempts: DataFrame, most: int = 5) -> DataFrame:
    """job_id, url, tries, ok: of attempts (job_id, url, attempt, code); a code below 300 succeeds, other 4xx but 408, 425 and 429 are final."""
    done = (F.col("code") < 300) | ((F.col("code") >= 400) & (F.col("code") < 500) & ~F.col("code").isin(408, 425, 429))
    w = Window.partitionBy("job_id", "url").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.where(F.col("attempt") <= most).withColumn("_done", done.cast("int"))
    rows = rows.withColumn("_ended", F.coalesce(F.max("_done").over(w), F.lit(0))).where("_ended = 0")
    return rows.groupBy("job_id", "url").agg(F.max("attempt").alias("tries"), F.max((F.col("code") < 300).cast("int")).alias("ok"))


def remaining(estimate_s: Column, started_at: Column, now: Column) -> Column:
    """Seconds left, shown only above five."""
    left = F.greatest(F.lit(0.0), estimate_s - (now - started_at))
    return F.when(left > 5, left)


#: HTTP codes of a provider (fixed values): those that end its use, those worth another attempt.
FATAL_CODES, TRANSIENT_CODES = (401, 402, 403, 404), (408, 409, 425, 429, 500, 502, 503, 504)


def attempts(outcomes: DataFrame, most: int = 2) -> DataFrame:
    """doc_id, chunk_no, tries, outcome: of attempts (doc_id, chunk_no, attempt, outcome, retryable) the first that is ok or must not be tried again, else the last allowed."""
    rows = outcomes.where(F.col("attempt") <= most)
    final = (F.col("outcome") == "ok") | ~F.coalesce("retryable", F.lit(True))
    ends = F.min(F.when(final, F.struct("attempt", "outcome")))
    best = rows.groupBy("doc_id", "chunk_no").agg(F.coalesce(ends, F.max(F.struct("attempt", "outcome"))).alias("m"))
    return best.select("doc_id", "chunk_no", F.col("m.attempt").alias("tries"), F.col("m.outcome").alias("outcome"))


def http_class(code: Column) -> Column:
    """What a provider's answer means: ok, transient (also no answer), fatal (the provider is lost), rejected (this text only)."""
    return F.when((code >= 200) & (code < 300), "ok").when(code.isNull() | code.isin(*TRANSIENT_CODES), "transient").when(code.isin(*FATAL_CODES), "fatal").otherwise("rejected")


def backoff(attempt: Column, retry_after: Column, most: int = 30) -> Column:
    """Seconds before the next attempt (from 1): what the provider asks for, else doubling; never more than `most`."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(retry_after.try_cast("double"), F.pow(F.lit(2.0), attempt - 1))))


#: Words for a stage (own wording).
LABELS = {"queued": "Waiting its turn", "checking_cache": "Looking in the archive", "cache_hit": "Found in the archive", "downloading": "Fetching the audio", "transcribing": "Writing down the speech", "formatting": "Laying out the text", "saving": "Saving", "completed": "Done", "failed": "Stopped"}


def label(stage: Column, index: Column, total: Column) -> Column:
    """Words for a stage, with the part it is at."""
    words = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), stage), F.lit(LABELS["queued"]))
    part = F.concat(words, F.lit(" ("), index.cast("string"), F.lit(" of "), total.cast("string"), F.lit(")"))
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.coalesce(part, words)).otherwise(words)
