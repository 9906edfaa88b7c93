"""Readers and writers of transcripts, job registries, caches and sidecars, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators import layout

SEGMENT = "struct<start:double,end:double,text:string>"
SIDECAR = f"video_id string, language string, detected_language string, title string, cleaner_provider string, segments array<{SEGMENT}>"
ENTRY = "video_id string, language string, mode string, format_version string, raw_path string, cleaned_path string, created_at double, updated_at double, value string"
JOB = "job_id string, status string, stage string, progress_percent double, submitted_at double, started_at double, finished_at double, error string, title string, video_id string, language string, mode string, detected_language string, format_version string, video_duration_seconds double, via_gateway boolean, url string, notices boolean"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of UTF-8 files; bytes that are not valid become U+FFFD."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("text"))


def write_transcripts(docs: DataFrame, path: str) -> None:
    """Writes doc_id and text in paragraphs, by the timed segments where docs has them."""
    text = layout.paragraph_timed("text", "segments") if "segments" in docs.columns else layout.paragraph_text("text")
    docs.withColumn("text", text).write.mode("overwrite").parquet(path)


def _keyed(spark: SparkSession, path: str, schema: str, key: str, inside: str = "jobs") -> DataFrame:
    """Rows of a JSON object of objects, or of the one below a name; an entry of another shape is left out."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", "map<string,string>")
    named = F.from_json(F.try_element_at(whole, F.lit(inside)), "map<string,string>")
    entries = text.select(F.explode(F.coalesce(named, whole, F.create_map().cast("map<string,string>"))).alias(key, "_value"))
    rows = entries.select(key, F.from_json("_value", schema).alias("_row")).where(F.col("_row").isNotNull() & F.col("_value").startswith("{"))
    return rows.select(key, *(F.col(f"_row.{c}").alias(c) for c in (f.split(" ")[0] for f in schema.split(", ")) if c != key))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a cache {"videos": {key: entry}}, or of the object of entries itself; entries of another shape are left out."""
    return _keyed(spark, path, ENTRY, "cache_key", inside="videos")


def write_keyed(rows: DataFrame, path: str, key: str) -> None:
    """Writes rows as JSON objects, one a line under its key; what JSON can't hold (binary, maps with other keys) is written as text."""
    odd = lambda t: not isinstance(t, (T.StringType, T.NumericType, T.BooleanType, T.StructType, T.ArrayType, T.MapType))
    said = [F.col(f"`{f.name}`").cast("string").alias(f.name) if odd(f.dataType) else F.col(f"`{f.name}`") for f in rows.schema.fields]
    line = F.to_json(F.struct(*said), {"ignoreNullFields": "false"})
    rows.select(F.col(key).cast("string").alias("key"), line.alias("value")).write.mode("overwrite").json(path)


def read_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that write_keyed() wrote."""
    return spark.read.schema("key string, value string").json(path).select(F.from_json("value", schema).alias("_row")).select("_row.*")


def write_sidecars(rows: DataFrame, path: str) -> None:
    """Writes video_id, language and the sidecar's JSON, replacing only the partitions of languages that rows hold."""
    facts = F.to_json(F.struct(*(c for c in rows.columns if c not in ("video_id", "language"))))
    write_partitioned(rows.select("video_id", facts.alias("sidecar"), "language"), path, ["language"])


def persisted(updates: DataFrame, path: str, checkpoint: str, forced: bool = False, seconds: int = 2):
    """Starts writing a stream of job rows, at most once in so many seconds, or, forced, all that is there at once."""
    writer = updates.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if forced else writer.trigger(processingTime=f"{seconds} seconds")).start()


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a registry; those that ran when it was written have failed."""
    jobs = _keyed(spark, path, JOB, "job_id")
    lost = F.col("status") == "running"
    return jobs.withColumns({"status": F.when(lost, "failed").otherwise(F.col("status")), "stage": F.when(lost, "failed").otherwise(F.col("stage")), "finished_at": F.when(lost, F.coalesce("finished_at", F.unix_timestamp().cast("double"))).otherwise(F.col("finished_at")), "error": F.when(lost, "The service restarted before this job ended.").otherwise(F.col("error"))})


def read_sidecar(text: Column) -> Column:
    """Struct of a sidecar's JSON; what cannot be read has null fields."""
    return F.from_json(text, SIDECAR)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """name, value of KEY=VALUE lines; blanks and comments pass, quotes go, the first line of a name counts.

    A file whose name begins with a dot is read too: it is looked up by the name itself, since Spark's readers pass over such files in listings.
    """
    folder, _, name = path.rpartition("/")
    if name.startswith("."):
        hadoop = spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(path)
        own = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        stream = own.open(place)
        try:  # a settings file is a few lines
            raw = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        rows = spark.createDataFrame([(raw,)], "value string")
    else:
        rows = spark.read.text(path, wholetext=True)
    rows = rows.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    rows = rows.select("n", F.trim(F.substring_index("line", "=", 1)).alias("name"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))
    rows = rows.withColumn("value", F.regexp_replace("value", "^(['\"])(.*)\\1$", "$2"))
    return rows.where("name <> ''").groupBy("name").agg(F.min_by("value", "n").alias("value"))


def positive(value: Column, default: int) -> Column:
    """A setting as a positive whole number, else the default."""
    n = value.try_cast("int")
    return F.when(n > 0, n).otherwise(default)


def not_negative(value: Column, default: int) -> Column:
    """A setting as a whole number of nought or more, else the default."""
    n = value.try_cast("int")
    return F.when(n >= 0, n).otherwise(default)


def flag(value: Column, default: bool = False) -> Column:
    """A setting as yes or no."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False).otherwise(default)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, modified of the files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"))


def names(files: DataFrame) -> DataFrame:
    """Names of files in order."""
    return files.select("name").orderBy("name")


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that rows hold; readers see old or new files, never half."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
