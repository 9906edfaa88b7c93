"""Sliding-window limits: what is offered, what is admitted, and when to come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import admission

WINDOW, PER_ADDRESS, PER_USER = admission.LIMITS.window, 3, 6


def client_key(trusted: Column, user: Column, address: Column) -> Column:
    """Bucket and hourly limit of a caller."""
    named = trusted & user.rlike("^[A-Za-z0-9._@-]{1,128}$")
    bucket = F.when(named, F.concat(F.lit("user:"), user)).when(trusted, F.concat(F.lit("gateway:"), address)).otherwise(F.concat(F.lit("ip:"), address))
    return F.struct(bucket.alias("client"), F.when(trusted, PER_USER).otherwise(PER_ADDRESS).alias("limit"))


def offered(log: DataFrame, seconds: int = WINDOW) -> DataFrame:
    """log (client, at in whole microseconds) with the number of requests in (at - window, at]."""
    w = Window.partitionBy("client").orderBy("at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return log.withColumn("offered", F.count("*").over(w))


def admitted(log: DataFrame, limit: int = PER_ADDRESS, seconds: int = WINDOW) -> DataFrame:
    """log (id, client, at) with admitted and, if not, retry_after seconds."""
    return admission.admitted(log, limit, seconds)


def sessions(times: DataFrame, gap_seconds: int = 900) -> DataFrame:
    """Sessions of times (at, whole microseconds): begin, finish, n; a new one begins a gap or more after the last time.

    Times are ordered by day first, so that only one row a day meets in one task to find the gaps between days.
    """
    day = F.floor(F.col("at") / 86_400_000_000)
    rows = times.groupBy("at").agg(F.count("*").alias("n")).withColumn("day", day)
    w = Window.partitionBy("day").orderBy("at")
    edges = rows.groupBy("day").agg(F.max("at").alias("last"))
    edges = edges.select("day", F.lag("last").over(Window.orderBy("day")).alias("_last"))
    rows = rows.withColumn("_lag", F.lag("at").over(w)).join(edges, "day")
    new = F.col("at") - F.coalesce("_lag", "_last") >= gap_seconds * 1_000_000
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    per_day = rows.groupBy("day").agg(F.sum("_new").alias("_k"))
    per_day = per_day.select("day", F.coalesce(F.sum("_k").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(per_day, "day").withColumn("session", F.col("_base") + F.sum("_new").over(w))
    return rows.groupBy("session").agg(F.min("at").alias("begin"), F.max("at").alias("finish"), F.sum("n").alias("n"))


def needed(now: Column, active: Column, pending: Column, finished: Column, grace: int = 900) -> Column:
    """Whether the service is to be kept awake."""
    return (active > 0) | (pending > 0) | F.coalesce(now - finished < grace, F.lit(False))
