"""Streaming forms: admission, job states, offered counts and idle sessions over arriving events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstream.plans.limits import PER_ADDRESS, WINDOW
from quillstream.plans.progress import STAGES


def sessions(times: DataFrame, by: str = "service", gap: str = "900 seconds", late: str = "1 hour") -> DataFrame:
    """Busy sessions of each service's finish times (ts); final once the watermark has passed them. Spark has no session windows without a key."""
    rows = times.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return rows.select(by, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("until"), "n")


def offered(log: DataFrame, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests of each client in sliding windows."""
    rows = log.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "client").agg(F.count("*").alias("n"))
    return rows.select("client", F.col("window.end").alias("until"), "n")


def admitted(log: DataFrame, limit: int = PER_ADDRESS, seconds: int = WINDOW) -> DataFrame:
    """Exact admission of log (id, client, at in seconds): a client's state is the times admitted in its window, at most `limit`."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for rows in frames:
            out = []
            for i, at in rows.sort_values(["at", "id"])[["id", "at"]].itertuples(index=False):
                times = [t for t in times if t > at - seconds]
                ok = len(times) < limit
                out.append((i, key[0], ok, None if ok else float(max(1, math.ceil(times[0] + seconds - at)))))
                if ok:
                    times.append(float(at))
            yield pd.DataFrame(out, columns=["id", "client", "admitted", "retry_after"])
        state.update((times,))
        if times:
            state.setTimeoutDuration(seconds * 1000)

    def live(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from run(key, frames, state)

    return log.groupBy("client").applyInPandasWithState(live, "id long, client long, admitted boolean, retry_after double", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """Status and percent of each job (job_id, seq, stage): the percent never falls, the first end is final."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, percent = tuple(state.get) if state.exists else ("queued", 0)
        for rows in frames:
            for stage in rows.sort_values("seq")["stage"]:
                if status in ("completed", "failed"):
                    break
                if stage != "failed":  # a failure keeps what was reached
                    percent = max(percent, STAGES.get(stage, STAGES["queued"])[0])
                status = stage if stage in ("completed", "failed", "queued") else "running"
        state.update((status, percent))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "percent": [percent]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id string, status string, percent int", "status string, percent int", "update", GroupStateTimeout.NoTimeout)


def first_of_each(requests: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Requests without repeats of their key within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
