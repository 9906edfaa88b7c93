"""Tables kept in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where local sessions (tests) keep tables if spark.checkpoint.dir is unset.
LOCAL_DIR = "/tmp/checkpoints"
#: Spark's own switch: a query's shuffle files go when the query ends.
ENDS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that kept() wrote and whose frames are still held.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a local master may go without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DIR
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillstream/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end. What they wrote is in the shared folder by then."""
    before = spark.conf.get(ENDS_SHUFFLES, None)
    spark.conf.set(ENDS_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ENDS_SHUFFLES)
        else:
            spark.conf.set(ENDS_SHUFFLES, before)


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs one read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_end(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote and that nothing reads any more; other frames are left alone."""
    for df in tables:
        if (path := _paths.pop(df, None)) is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
