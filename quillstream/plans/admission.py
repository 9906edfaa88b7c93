"""Admission of requests: what is answered from a running job, from saved files, queued, or turned away.

Each decision depends on earlier ones (only what is admitted counts), so a service's requests are one ordered
stream. It is cut where nothing came for a whole window and no job can still be running: there every count is
zero again, so the pieces are independent. Within a piece rows stream through in batches and the state is
bounded by the limits: the times admitted in the window and the jobs that run.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MICRO = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Requests an hour, jobs at a time, answers from saved files an hour (fixed values)."""

    window: int = 3600
    overall: int = 60
    active: int = 10
    reuse_client: int = 20
    reuse_overall: int = 200
    history: int = 500
    full_retry: int = 60


LIMITS = Limits()
OUT = "id long, outcome string, code int, retry_after long, same_as long"


class Log:
    """Times of one kind in the window (now - span, now], overall and by client."""

    def __init__(self, span: int):
        self.span, self.all, self.by = span, deque(), {}

    def prune(self, now: int) -> None:
        while self.all and self.all[0][0] <= now - self.span:
            _, client = self.all.popleft()
            own = self.by[client]
            own.popleft()
            if not own:
                del self.by[client]

    def add(self, now: int, client) -> None:
        self.all.append((now, client))
        self.by.setdefault(client, deque()).append(now)

    def wait(self, now: int, client, overall: int, own: int) -> int | None:
        """Seconds until the next may come, if either log is full; the overall one is looked at first."""
        mine = self.by.get(client, ())
        oldest = self.all[0][0] if len(self.all) >= overall else mine[0] if len(mine) >= own else None
        return None if oldest is None else max(1, math.ceil((oldest + self.span - now) / MICRO))


class Service:
    """State of one service between requests."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.asked, self.reuses = Log(limits.window * MICRO), Log(limits.window * MICRO)
        self.running: dict[object, tuple[int, int]] = {}  # key: end, id

    def decide(self, id: int, at: int, client, limit: int, key, valid: bool, reusable: bool, ends: int | None) -> tuple[str, int, int | None, int | None]:
        """Outcome, code, seconds to wait, id of the job that answers."""
        if not valid:
            return "invalid", 400, None, None
        self.running = {k: v for k, v in self.running.items() if v[0] > at}
        if key in self.running:
            return "duplicate", 202, None, self.running[key][1]
        if reusable:
            self.reuses.prune(at)
            most = min(self.limits.reuse_overall, max(1, self.limits.history // 2))
            if len(self.reuses.all) < most and len(self.reuses.by.get(client, ())) < self.limits.reuse_client:
                self.reuses.add(at, client)
                return "reused", 202, None, None
        if len(self.running) >= self.limits.active:
            return "full", 429, self.limits.full_retry, None
        self.asked.prune(at)
        wait = self.asked.wait(at, client, self.limits.overall, limit)
        if wait is not None:
            return "limited", 429, wait, None
        self.asked.add(at, client)
        if ends is not None and ends > at:
            self.running[key] = (ends, id)
        return "queued", 202, None, None


def _pieces(requests: DataFrame, limits: Limits) -> DataFrame:
    """requests with piece: a new one begins where no request came for a window and no job offered before can still run."""
    before = Window.partitionBy("service").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.greatest(F.col("at") + limits.window * MICRO, F.coalesce("ends", "at"))
    quiet = F.coalesce(F.col("at") >= F.max(until).over(before), F.lit(True))
    rows = requests.withColumn("_new", quiet.cast("long"))
    return rows.withColumn("piece", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def submitted(requests: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """id, outcome, code, retry_after, same_as of requests.

    requests: service, id, at (whole microseconds), client, limit (of the client), key, valid, reusable, ends (when its job
    ends if it is queued; null or not later: at once). Outcomes: invalid, duplicate, reused, full, limited, queued.
    A null client is a client of its own; null valid or reusable count as false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, Service(limits)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "at", "client", "limit", "key", "valid", "reusable", "ends")]
            out = []
            for place, row in zip(zip(batch.column("service").to_pylist(), batch.column("piece").to_pylist(), strict=True), zip(*columns, strict=True), strict=True):
                if place != last:
                    last, own = place, Service(limits)
                out.append((row[0], *own.decide(*row)))
            names = ["id", "outcome", "code", "retry_after", "same_as"]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    rows = _pieces(requests, limits).repartition("service", "piece").sortWithinPartitions("service", "piece", "at", "id")
    return rows.select("service", "piece", "id", "at", "client", "limit", "key", "valid", "reusable", "ends").mapInArrow(run, OUT)


def admitted(log: DataFrame, limit: int, seconds: int) -> DataFrame:
    """log (id, client, at) with admitted and, if not, retry_after seconds. Only what is admitted counts, so each client's log is one ordered stream."""
    span = seconds * MICRO

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = None, deque()
        for batch in batches:
            n = batch.num_rows
            ok, wait = np.zeros(n, dtype=bool), [None] * n
            for i, (client, at) in enumerate(zip(batch.column("client").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                if client != last:
                    last, times = client, deque()
                while times and times[0] <= at - span:
                    times.popleft()
                if len(times) < limit:
                    ok[i] = True
                    times.append(at)
                else:
                    wait[i] = max(1, math.ceil((times[0] + span - at) / MICRO))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "client", "at")), pa.array(ok), pa.array(wait, pa.int64())], names=["id", "client", "at", "admitted", "retry_after"])

    rows = log.select("id", "client", "at").repartition("client").sortWithinPartitions("client", "at", "id")
    kind = log.schema["client"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, client {kind}, at long, admitted boolean, retry_after long")
