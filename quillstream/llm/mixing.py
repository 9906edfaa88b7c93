"""Mixing sources to target weights (op1), with DataFrame functions only.

Every document gets an Efraimidis-Spirakis key -ln(u) / w, where u is a hash of its id and text and w
its quality weight: taking the smallest keys first is a weighted sample without replacement.
A source with target t and size s is taken floor(t / s) times in whole epochs; the rest of the
target goes to the documents with the smallest keys, up to the word budget.

The order within a source is never sorted as a whole, for one source may hold a third of all
rows. Keys fall into logarithmic buckets (at most 0.8 % of any exponential sample each), whose
sums are prefix-summed; only the bucket in which the budget ends is split again, and only the
sub-bucket in which it ends (about a millionth of the source) is sorted. The result per source
is one cut-off key, so the documents themselves are never shuffled.

Defined results: a null text has size 0; null sources form one source, ordered last; rows that
agree in doc_id and text share a key, and where the budget ends among them as many are taken as come nearest to it; an empty table
gives no rows; other columns, whatever their names, are ignored by mix() and passed on by
mixed_documents().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import kept

#: A word with the white space before it, taken whole.
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Symbols whose share lowers a document's quality weight.
SYMBOLS = "#$%&*@<>{}[]|=_~^\\+"
#: Up to this many sources their table is broadcast (under 1 MB); beyond, Spark joins by shuffle and splits skewed sources.
BROADCAST_SOURCES = 10_000
PER_OCTAVE, SUB_BUCKETS, SALTS = 64, 4096, 4096


def n_words(text: Column) -> Column:
    """Number of words: one mark for each, then the marks are counted (an array of words would take many times the text's memory)."""
    marks = F.rtrim(F.regexp_replace(text, WORD, "x"), F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.05 where a quarter of the characters are symbols."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), 1 - 4.0 * symbols / n)), F.lit(0.05))


def _keyed(docs: DataFrame) -> list[Column]:
    """Size, hash and key of a row of docs."""
    size = n_words(F.col("text"))
    # Rows that share an id but not their text have keys of their own.
    name = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")
    key = -F.log((u + 0.5) / float(2**52)) / quality_weight(F.col("text"))
    return [size.alias("_size"), u.alias("_u"), key.alias("_key")]


def _bucket(key: Column) -> tuple[Column, Column]:
    fine = F.log2(key) * PER_OCTAVE
    first = F.floor(fine)
    return first, F.least(F.floor((fine - first) * SUB_BUCKETS), F.lit(SUB_BUCKETS - 1))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) to the same with target, epochs and rest.

    Targets share the total size by weight and stop at max_repeat times the source's size. The
    excess is reshared, which ends at one level per unit of weight: sources whose ratio of cap to weight
    is below it stop at their cap. One row a source, so windows over all sources are small.
    """
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = reduce(lambda c, i: c.when(rank == i, weights[i]), range(1, len(weights)), F.when(rank == 0, weights[0]))
    t = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_repeat)
    t = t.withColumn("_r", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("_total", F.sum("source_size").over(everything))
    t = t.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward))
    t = t.withColumn("_level", F.min(F.when(F.col("_r") >= F.col("_level"), F.struct("_r", "_level"))).over(everything)["_level"])
    t = t.withColumn("target", F.least(F.col("_w") * F.col("_level"), F.col("_cap").cast("double")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("epochs", epochs.cast("long"))
    return t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("source", "source_size", "target", "epochs", "rest")


def _ends_in(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Of buckets with sums (by, bucket, s, _before, rest): that in which rest ends, with the sum before it."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_s").over(w), F.lit(0))
    rows = rows.withColumn("_before", before)
    return rows.where((F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("_s")))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def plan(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame, int]:
    """The sized rows (doc_id, source, _size, _u, _key), the plan of each source with its cut-off (_cut_key, _cut_u), and the number of sources."""
    sized = kept(docs.select("doc_id", F.col("source").cast("string").alias("source"), *_keyed(docs)), "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    sources = kept(targets(sizes, weights, max_repeat), "mix-sources")
    n = sources.count()
    first, second = _bucket(F.col("_key"))
    rows = sized.where(F.col("_size") > 0).withColumns({"_b1": first, "_b2": second})

    def join(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_r_{c}" for c in ("source", *more)})
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in ("source", *more)))
        return left.join(_small(right, n), on).drop(*(f"_r_{c}" for c in ("source", *more)))

    sums = rows.groupBy("source", "_b1").agg(F.sum("_size").alias("_s"))
    at = _ends_in(join(sums, sources.select("source", "rest", F.lit(0).cast("long").alias("_before"))), ["source"], "_b1")
    at = kept(at.select("source", "_b1", "_before", "rest"), "mix-first")
    sums = join(rows, at, "_b1").groupBy("source", "_b1", "_b2", "_before", "rest").agg(F.sum("_size").alias("_s"))
    at = _ends_in(sums, ["source", "_b1"], "_b2").select("source", "_b1", "_b2", "_before", "rest")
    at = kept(at, "mix-second")
    last = join(rows, at, "_b1", "_b2").groupBy("source", "_key", "_u", "_before", "rest").agg(F.sum("_size").alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy("source").orderBy("_key", "_u").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of one key repeat each other, so so many of them are taken as come nearest to the budget.
    left = F.col("rest") - F.col("_before") - F.coalesce(F.sum("_s").over(w), F.lit(0))
    fit = F.floor(left * F.col("_n") / F.col("_s") + 0.5)
    cut = last.withColumn("_fit", F.greatest(F.lit(0), F.least(fit, F.col("_n"))))
    at_key, whole = F.struct("_key", "_u"), F.col("_fit") == F.col("_n")
    # Where nothing of the last sub-bucket fits whole, its first key, exclusive, is the cut-off.
    cut = cut.groupBy("source").agg(
        F.max(F.when(whole, at_key)).alias("_in"), F.min(at_key).alias("_out"), F.max(F.when(~whole & (F.col("_fit") > 0), F.struct("_key", "_u", "_fit"))).alias("_part")
    )
    cut = cut.select(
        F.col("source").alias("_c_source"),
        F.lit(True).alias("_ends"),
        F.coalesce(F.col("_in"), F.struct(F.col("_out._key").alias("_key"), (F.col("_out._u") - 1).alias("_u"))).alias("_cut"),
        "_part",
    )
    sources = sources.join(cut, F.col("source").eqNullSafe(F.col("_c_source")), "left").drop("_c_source")
    return sized, kept(sources, "mix-plan"), n


def _with_copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (joined with their source's plan) with _copies: whole epochs, and once more up to the cut-off.

    Of rows that repeat each other at the cut-off only some are taken. They are counted by salts, so that
    no task holds them all; which of them are taken makes no difference.
    """
    out = rows.withColumn("_copies", _copies())
    if sources.where(F.col("_part").isNotNull()).isEmpty():
        return out
    here = F.coalesce(F.struct("_key", "_u") == F.struct("_part._key", "_part._u"), F.lit(False))
    edge = kept(out.where(here).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mix-edge")
    before = Window.partitionBy("_e").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = edge.groupBy(F.col("_p_source").alias("_e"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_k"))
    base = base.select("_e", "_s", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"))
    own = edge.join(base, F.col("_p_source").eqNullSafe(F.col("_e")) & (F.col("_salt") == F.col("_s")))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("_e", "_s").orderBy(F.lit(0)))
    picked = own.withColumn("_place", place).withColumn("_copies", F.col("_copies") + (F.col("_place") <= F.col("_part._fit")).cast("long"))
    return out.where(~here).unionByName(picked.select(*out.columns))


def _copies() -> Column:
    """How often a row is taken: whole epochs, and once more up to its source's cut-off. Without a cut-off the rest is nothing, or all."""
    within = F.when(F.col("_ends"), F.struct("_key", "_u") <= F.col("_cut")).otherwise(F.col("rest") >= F.col("source_size"))
    return (F.col("epochs") + within.cast("long")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every row of docs (doc_id, text, source)."""
    sized, sources, n = plan(docs, weights, max_repeat)
    sources = sources.withColumnRenamed("source", "_p_source")
    out = _with_copies(sized.join(_small(sources, n), F.col("source").eqNullSafe(F.col("_p_source"))), sources)
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. Texts are read twice and not shuffled, but for rows that repeat each other at a cut-off."""
    _, sources, n = plan(docs, weights, max_repeat)
    sources = sources.withColumnRenamed("source", "_p_source")
    own = docs.select(F.struct("*").alias("_doc"), F.col("source").cast("string").alias("_source"), *_keyed(docs))
    own = _with_copies(own.join(_small(sources, n), F.col("_source").eqNullSafe(F.col("_p_source"))), sources).where(F.col("_copies") > 0)
    return own.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_doc.*")
