"""Line de-duplication by a segment-partition edit join (op3), with DataFrame functions only.

A line, trimmed and not empty, is dropped if an earlier line (by doc_id, then line number) is the same, or
if both have LEAST characters or more and are within TAU edits. Of fewer than LEAST = 2 * TAU + 1
characters, TAU edits may change half or more, so such lines go as exact repeats only. Equal lines of any
length are grouped first, so the join sees each distinct line once:

- a line of length n is split into TAU + 1 even segments; two lines within TAU edits share one;
- a line probes the segments of lines of its length and up to TAU less, with the substrings at the
  few places where such a segment can stand (the multi-match-aware selection: 12 for TAU = 2);
- lines also carry counts of a few common letters; two edits change these by four in all, which
  settles most pairs of lines that share a long segment but differ in words;
- of five pieces of a line, three must stand in the other within TAU places;
- pairs that are left are verified by a banded bit-parallel edit distance: one pass over the line,
  with a band of 2 * TAU + 1 bits in a whole number.

Defined results: a null text stays null and has no lines; an empty text has one empty line; rows
that repeat both doc_id and text count as one document, and all keep its lines; a null doc_id sorts
first; a document all of whose lines go has an empty text (deduplicated() then leaves it out); an empty
table gives no rows; further columns are passed on by deduplicated().
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import drop, kept

TAU = 2
#: Characters from which lines are compared by edits, not for equality only.
LEAST = 2 * TAU + 1
BAND = 2 * TAU + 1
#: Up to this many names of lines are broadcast (32 bytes each).
BROADCAST_IDS = 100_000


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, _h (of the text), line_no, line of all lines that are not empty."""
    # Trimming of more than spaces walks the whole line, so only texts that hold other white space pay for it.
    odd = reduce(lambda a, b: a | b, (F.contains("text", F.lit(c)) for c in "\t\r\f\x0b"))
    # What is said of a whole text is said below the generator, once a text and not once a line.
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), odd.alias("odd"), F.split("text", "\n", -1).alias("own"))
    rows = rows.select("doc_id", "_h", "odd", F.posexplode("own").alias("line_no", "line"))
    rows = rows.withColumn("line", F.when(F.col("odd"), F.btrim("line", F.lit(" \t\r\f\x0b"))).otherwise(F.trim("line")))
    return rows.where(F.col("line") != "").drop("odd")


def _names(line: Column) -> dict[str, Column]:
    """Two hashes that name a line; the first also names it in pairs, which are verified."""
    return {"x": F.xxhash64(line), "z": F.xxhash64(F.lit(1), line)}


def _place(kind: T.DataType) -> Column:
    """Where a line stands (doc_id, _h, line_no), as one value in that order; null ids come first.

    Of whole-number ids it is a decimal of the id, 31 bits of the text's hash and the line number, which
    has a fixed width, so that Spark aggregates it by hashing and need not sort the lines.
    """
    if not isinstance(kind, T.IntegralType):
        return F.struct("doc_id", "_h", "line_no")
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    low = F.shiftleft(F.shiftrightunsigned("_h", 33), 31) + F.col("line_no")
    return (doc * F.lit(2**62) + low).cast("decimal(38,0)")


def _wide(line: Column) -> Column:
    """A line in four bytes a character, of which a substring is found without walking the line."""
    return F.encode(line, "UTF-32")


def _probes() -> list[tuple[int, int, int]]:
    """(less, i, shift): segment i of a line shorter by less may stand shift places from where it would."""
    return [(less, i, shift) for less in range(TAU + 1) for i in range(TAU + 1) for shift in range(max(-i, less - (TAU - i)), min(i, less + (TAU - i)) + 1)]


def _keyed(lines: DataFrame, probes: list[tuple[int, int, int]]) -> DataFrame:
    """lines (with a column wide) once for each probe, with the key of its substring and whether it is one of a line as long.

    The places come from a table of constants in each row, so the code that Spark compiles has one substring, not one a probe.
    """
    places = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in probes))
    rows = lines.select("*", F.inline(places)).withColumn("n", F.shiftright(F.octet_length("wide"), 2) - F.col("less"))
    # Segment i (from 0) of a line of length n: the last n mod (TAU + 1) are longer by one.
    rows = rows.withColumns({"base": F.call_function("div", F.col("n"), F.lit(TAU + 1)).cast("int"), "longer": TAU + 1 - F.col("n") % (TAU + 1)})
    start = F.col("base") * F.col("i") + F.greatest(F.lit(0), F.col("i") - F.col("longer")) + F.col("shift")
    length = F.col("base") + (F.col("i") >= F.col("longer")).cast("int")
    key = F.xxhash64("n", "i", F.substring("wide", F.shiftleft(start, 2) + 1, F.shiftleft(length, 2)))
    return rows.withColumns({"key": key, "even": F.col("less") == 0}).select(*(c for c in lines.columns if c != "wide"), "key", "even")


#: Letters that are counted, each modulo 128.
COUNTED = ("e", "n", "t", "a", "o", "s", "r", "i", "h")
BITS = 7


def letter_counts(line: Column) -> Column:
    """Counts of the letters, seven bits each."""
    out = None
    for i, c in enumerate(COUNTED):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        bits = F.shiftleft(n.bitwiseAND(F.lit((1 << BITS) - 1)).cast("long"), BITS * i)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def counts_agree(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether two lines' counts allow tau edits: an edit changes two counts by one at most, and what wraps round only seems nearer."""
    total = None
    for i in range(len(COUNTED)):
        d = (F.shiftright(a, BITS * i) - F.shiftright(b, BITS * i)).bitwiseAND(F.lit((1 << BITS) - 1))
        d = F.least(d, (1 << BITS) - d)
        total = d if total is None else total + d
    return total <= 2 * tau


def pieces_agree(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether so many of five pieces of a stand in b, each within tau places of where they stood, as tau edits leave."""
    n, found = F.floor(F.length(a) / 5).cast("int"), None
    for i in range(5):
        start = n * i + 1
        low = F.greatest(F.lit(1), start - tau)
        own = F.contains(F.substring(b, low, start + n + tau - low), F.substring(a, start, n)).cast("int")
        found = own if found is None else found + own
    return found >= 5 - tau


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether two strings of at least 2 * tau characters are within tau edits.

    The band of a column of the edit matrix lies in vp and vn, the rows where the distance rises
    and falls by one; the top bit is the lowest diagonal. d0, hp and hn follow from these and
    from the places of b's character in the band by a few whole-number operations.
    """
    both = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    # Bound to a name, lest the characters be split again for each step.
    return _let(both, lambda v: (F.abs(F.size(v["x"]) - F.size(v["y"])) <= tau) & (_banded(v["x"], v["y"], tau) <= tau))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _banded(x: Column, y: Column, tau: int) -> Column:
    """Edit distance of two arrays of characters, right up to tau."""
    band = 2 * tau + 1
    mask, top = _long((1 << band) - 1), band - 1
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    n = F.size(x)
    start = F.struct(_long(((1 << band) - 1) & ~((1 << tau) - 1)).alias("vp"), _long(0).alias("vn"), _long(tau).alias("d"))

    def step(s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        same = None
        for k in range(band):  # bit k is row j + k - tau
            own = F.when(F.get(x, j + (k - tau)) == F.get(y, j), _long(1 << k)).otherwise(_long(0))
            same = own if same is None else same + own

        def with_same(same: Column) -> Column:
            d0 = ((same.bitwiseAND(vp) + vp).bitwiseAND(mask)).bitwiseXOR(vp).bitwiseOR(same).bitwiseOR(vn)
            return _let(d0, with_d0)

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask)
            return _let(hp, lambda hp: finish(d0, hp))

        def finish(d0: Column, hp: Column) -> Column:
            down, hn = F.shiftright(d0, 1), d0.bitwiseAND(vp)
            at = (F.lit(top - 1) - (j - (n - tau))).cast("int")
            along = F.when(j < n - tau, 1 - bit(d0, top)).otherwise(F.when(at >= 0, _bit(hp, at) - _bit(hn, at)).otherwise(_long(0)))
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s["d"] + along).cast("long").alias("d"),
            )

        return _let(same, with_same)

    return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step)["d"]


def _bit(v: Column, k: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), k)).cast("long").bitwiseAND(F.lit(1))


def _by_size(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_lines(lines: DataFrame) -> DataFrame:
    """Names (x, z) of the distinct lines (x, z, first, line, c) of LEAST characters or more that are within TAU edits of an earlier other one."""
    lines = lines.where(F.length("line") >= LEAST)
    wide = lines.select("x", "c", _wide(F.col("line")).alias("wide"))
    own = _keyed(wide, [(0, i, 0) for i in range(TAU + 1)]).drop("even")
    probe = _keyed(wide.withColumnsRenamed({"x": "y", "c": "d"}), _probes())
    apart = (F.col("x") != F.col("y")) & (~F.col("even") | (F.col("x") < F.col("y")))
    met = probe.join(own, "key").where(apart & counts_agree(F.col("c"), F.col("d")))
    pairs = kept(met.select("x", "y").distinct(), "lines-pairs")
    ids = kept(pairs.select("x").distinct().union(pairs.select("y").distinct()).distinct(), "lines-ids")
    texts = kept(lines.join(_by_size(ids), "x").select("x", "z", "first", "line"), "lines-texts")
    a = texts.select("x", F.col("z").alias("z_a"), F.col("first").alias("first_a"), F.col("line").alias("a"))
    b = texts.select(F.col("x").alias("y"), F.col("z").alias("z_b"), F.col("first").alias("first_b"), F.col("line").alias("b"))
    found = pairs.join(a, "x").join(b, "y").where(F.when(pieces_agree(F.col("a"), F.col("b")), within(F.col("a"), F.col("b"))))
    later = F.col("first_a") < F.col("first_b")
    found = found.select(F.when(later, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(later, F.col("z_b")).otherwise(F.col("z_a")).alias("z"))
    out = kept(found.distinct(), "lines-near")
    drop(pairs, ids, texts)
    return out


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _h and the numbers of the lines that go, of the documents that lose some."""
    place = _place(docs.schema["doc_id"].dataType)
    lines = _lines(docs).select("line", place.alias("at")).groupBy("line").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    lines = kept(lines.select("line", "first", "n", letter_counts(F.col("line")).alias("c"), *(v.alias(k) for k, v in _names(F.col("line")).items())), "lines-distinct", compression="zstd")
    near = near_lines(lines)
    # Only lines that repeat, or go, say anything about where they stand; of those that go no place stays.
    told = lines.where(F.col("n") > 1).select("x", "z", "first")
    told = kept(told.union(near.select("x", "z", F.lit(None).cast(lines.schema["first"].dataType))), "lines-told")
    drop(lines, near)
    rows = _lines(docs).select("doc_id", "_h", "line_no", *(v.alias(k) for k, v in _names(F.col("line")).items()))
    found = rows.join(_by_size(told), ["x", "z"]).where(F.col("first").isNull() | (place != F.col("first")))
    return found.groupBy("doc_id", "_h").agg(F.collect_set("line_no").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """What is left of a text without some lines, in time linear in their number."""
    lines = F.split(text, "\n", -1)
    left = _let(lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone), lambda i: F.get(own, i)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def _joined(docs: DataFrame) -> DataFrame:
    """_doc (all columns), _text and _gone of every row."""
    gone = dropped_lines(docs).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_x"), F.col("gone").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_hash"))
    return rows.join(gone, (F.col("_hash") == F.col("_x")) & F.col("_doc_id").eqNullSafe(F.col("_d")), "left")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what is left) of every row."""
    rows = _joined(docs)
    text = F.col("_doc.text")
    n = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    n = F.when(text.isNull(), 0).otherwise(n)
    return rows.select(F.col("_doc_id").alias("doc_id"), n.cast("int").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("int").alias("n_dropped"), _without(text, F.col("_gone")).alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with what is left of their texts; documents whose lines are all gone are left out. A column n_chars follows the text."""
    rows = _joined(docs).withColumn("_left", _without(F.col("_doc.text"), F.col("_gone")))
    rows = rows.where(F.col("_gone").isNull() | (F.trim(F.regexp_replace("_left", r"\s+", " ")) != ""))
    changed = {"text": F.col("_left"), "n_chars": F.when(F.col("_gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_left").cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*(changed[c].alias(c) if changed.get(c) is not None else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
