"""Kernels over columns: Arrow-batched functions, registered for SQL callers by register()."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as k

SEGMENTS = "array<struct<start:double,end:double,text:string>>"


@F.pandas_udf(T.StringType())
def format_text(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([k.formatted(t, None, x) for t, x in zip(text, language, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def format_timed(text: pd.Series, segments: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([k.formatted(t, s, x) for t, s, x in zip(text, segments, language, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def paragraph_text(text: pd.Series) -> pd.Series:
    return pd.Series([k.paragraphed(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def collapse_loops(text: pd.Series) -> pd.Series:
    return pd.Series([k.collapsed(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def strip_stock_phrases(text: pd.Series) -> pd.Series:
    return pd.Series([k.without_stock_phrases(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def spoken(text: pd.Series) -> pd.Series:
    """Text without loops, then without stock phrases, in one pass."""
    return pd.Series([k.without_stock_phrases(k.collapsed(t)) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def paragraph_timed(text: pd.Series, segments: pd.Series) -> pd.Series:
    return pd.Series([k.paragraphed(t, s) for t, s in zip(text, segments, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_words(text: pd.Series) -> pd.Series:
    return pd.Series([[f for f in map(k.folded, (t or "").split()) if f] for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def sentence_spans(text: pd.Series) -> pd.Series:
    return pd.Series([[{"first": a, "last": b} for a, b in k.sentences((t or "").split())] for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_sentences(text: pd.Series) -> pd.Series:
    return pd.Series([k.split_sentences(t) for t in text], dtype=object)


def chunk_rows(docs: DataFrame, most: int = k.LIMITS.chunk) -> DataFrame:
    """doc_id, chunk_no, text of every document's chunks."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(text: pd.Series) -> pd.Series:
        return pd.Series([k.chunks(t, most) for t in text], dtype=object)

    return docs.select("doc_id", F.posexplode(split("text")).alias("chunk_no", "text"))


def rewritten(chunks: DataFrame, generate: Callable[[str, str | None], str | None] | None = None) -> DataFrame:
    """chunks (doc_id, chunk_no, text, language) with output and outcome (ok, failed, lost).

    generate takes a chunk and its language and returns the rewritten text; it runs in Arrow batches where the
    chunks are. Without one the text comes back as it is. LookupError means that the provider is lost, any other
    error that this chunk failed.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("output", T.StringType()), T.StructField("outcome", T.StringType())])

    def one(text: str | None, language: str | None) -> tuple[str | None, str]:
        if generate is None:
            return text, "ok"
        try:
            out = generate(text or "", language)
        except LookupError:
            return None, "lost"
        except Exception:
            return None, "failed"
        return (out, "ok") if isinstance(out, str) else (None, "failed")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [one(t, x) for t, x in zip(frame["text"], frame["language"], strict=True)]
            yield frame.assign(output=[o for o, _ in done], outcome=[o for _, o in done])

    return chunks.mapInPandas(run, schema)


@F.udtf(returnType="chunk_no: int, chunk: string")
class SplitText:
    """split_text(text, most): a row for each chunk of a text."""

    def eval(self, text: str, most: int):
        yield from enumerate(k.chunks(text, most))


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    functions = (format_text, format_timed, paragraph_text, paragraph_timed, collapse_loops, strip_stock_phrases, spoken, fold_words, sentence_spans, split_sentences)
    for f in functions:
        spark.udf.register(f.__name__, f)
    spark.udtf.register("split_text", SplitText)
