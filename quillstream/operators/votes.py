"""Language votes of a lecture's parts, offsets of parts, and what is to be done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.functions import languages as lg
from quillstream.functions.columns import let
from quillstream.operators import layout

PART_SECONDS, MOST_BYTES, SPEECH_LETTERS = 300, 25 * 1024 * 1024, 100


def offsets(parts: DataFrame, part_seconds: float = PART_SECONDS) -> DataFrame:
    """parts (lecture, part_no, duration) with the seconds before each."""
    before = Window.partitionBy("lecture").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    length = F.coalesce(F.nanvl(F.col("duration").cast("double"), F.lit(None)), F.lit(float(part_seconds)))
    return parts.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0.0)))


def shifted(segments: Column, offset: Column) -> Column:
    """Segments with text, moved to lecture time, in hundredths of a second."""
    said = F.filter(segments, lambda s: s.isNotNull() & (F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    return F.transform(said, lambda s: F.struct(F.bround(s["start"] + offset, 2).alias("start"), F.bround(s["end"] + offset, 2).alias("end"), F.trim(s["text"]).alias("text")))


def needs_split(duration: Column, n_bytes: Column, part_seconds: float = PART_SECONDS) -> Column:
    return duration.isNull() | (duration > part_seconds) | (n_bytes > MOST_BYTES)


def probed(parts: DataFrame) -> DataFrame:
    """parts with a column probe: the text without loops, then without stock phrases, so that silence casts no vote."""
    return parts.withColumn("probe", layout.spoken(F.col("text")))


def votes(parts: DataFrame, probe: str = "text") -> DataFrame:
    """lecture, part_no, script, code, n_letters of parts (lecture, part_no, text, reported); nulls where too little is said."""
    code = lg.normalized(F.col("reported"))

    def cast(c: Column) -> Column:
        script, n = lg.verdict(c), c["arabic"] + c["latin"]
        candidate = lg.resolved_codes(script, lg.share(c), code, F.lit(None).cast("string"))
        sure = candidate.isin(*lg.ARABIC_SCRIPT) | (candidate == F.col("reported"))
        known = F.when((n >= SPEECH_LETTERS) & sure, candidate)
        arabic = F.coalesce(known.isin(*lg.ARABIC_SCRIPT), script == "ar")
        return F.when(script.isNotNull(), F.struct(F.when(arabic, "arabic").otherwise("latin").alias("script"), known.alias("code"), n.alias("n_letters")))

    # The letters are bound by let(), so that they are counted once however often the verdict looks at them.
    return parts.select("lecture", "part_no", let(lg.counted(F.col(probe)), cast).alias("_v")).select("lecture", "part_no", "_v.script", "_v.code", "_v.n_letters")


def majority(cast: DataFrame) -> DataFrame:
    """lecture, script, language: the script with most letters (ties: arabic), in it the code with most (ties: the first part's).

    One aggregation by lecture, script and code, so a long lecture is summed before it is shuffled; what meets for a lecture are its codes.
    """
    # Parts without a vote have no letters and go after the sum: a filter before it would have the text judged twice.
    sums = cast.groupBy("lecture", "script", "code").agg(F.sum("n_letters").alias("n"), (-F.min("part_no")).alias("early")).where(F.col("n").isNotNull())
    rows = sums.groupBy("lecture").agg(F.collect_list(F.struct("n", "early", "code", "script")).alias("own"))
    weight = lambda s: F.aggregate(F.filter("own", lambda x: x["script"] == s), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = rows.withColumns({"_a": weight("arabic"), "_l": weight("latin")}).where("_a + _l > 0")
    rows = rows.withColumn("script", F.when(F.col("_a") >= F.col("_l"), "arabic").otherwise("latin"))
    best = F.array_max(F.filter("own", lambda x: x["code"].isNotNull() & (x["script"] == F.col("script"))))
    return rows.select("lecture", "script", F.coalesce(best["code"], F.when(F.col("script") == "arabic", "ar")).alias("language"))


def to_redo(cast: DataFrame, chosen: DataFrame) -> DataFrame:
    """Parts whose script, or known language, is another than the lecture's."""
    target = chosen.where(F.col("language").isNotNull()).select("lecture", F.col("language").alias("target"))
    rows = cast.where(F.col("script").isNotNull()).join(target, "lecture")
    group = F.when(F.col("target").isin(*lg.ARABIC_SCRIPT), "arabic").otherwise("latin")
    return rows.where((F.col("script") != group) | (F.col("code").isNotNull() & (F.col("code") != F.col("target")))).select("lecture", "part_no", "target")


ANSWER = "struct<text:string,segments:array<struct<start:double,end:double,text:string>>,reported:string,usage:array<string>>"


def merged(first: Column, again: Column) -> Column:
    """Two answers (structs of text, segments, reported, usage): the second stands in for the first unless its text is empty; usage holds both."""
    given = F.coalesce(F.trim(again["text"]), F.lit("")) != ""
    pick = lambda name: F.when(given, again[name]).otherwise(first[name]).alias(name)
    none = F.array().cast("array<string>")
    usage = F.concat(F.coalesce(first["usage"], none), F.coalesce(again["usage"], none))
    return F.struct(pick("text"), pick("segments"), pick("reported"), usage.alias("usage"))


def part_of(start: Column, part_seconds: float = PART_SECONDS) -> Column:
    """Number of the fixed-length part in which a second lies."""
    return F.floor(start / part_seconds).cast("int")


def reported_mode(parts: DataFrame) -> DataFrame:
    """lecture, reported, n: the code most parts with text report; ties by code."""
    rows = parts.where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("reported").isNotNull())
    counts = rows.groupBy("lecture", "reported").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lecture").orderBy(F.col("n").desc(), "reported")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("lecture", "reported", "n")


def concatenated(parts: DataFrame) -> DataFrame:
    """lecture, text: the parts' texts in order, by single spaces."""
    rows = parts.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.groupBy("lecture").agg(F.sort_array(F.collect_list(F.struct("part_no", "text"))).alias("p")).select("lecture", F.array_join(F.col("p.text"), " ").alias("text"))
