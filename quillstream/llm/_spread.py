"""Values of a group joined to its rows, also where one group holds very many of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that the rows of a group are dealt over: the bits of a long.
PLACES = 64
PLACE = "_place"


def place(*by: str) -> Column:
    """The place of a row, by the hash of these columns."""
    return F.pmod(F.xxhash64(*by), F.lit(PLACES)).cast("int")


def places(place: Column) -> Column:
    """Aggregate: the places that rows of a group have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place))


def at_places(totals: DataFrame, bits: str) -> DataFrame:
    """totals, a row of a group, once for each of its places (PLACE): never more rows than the group has."""
    held = F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda p: F.call_function("getbit", F.col(bits), p) == 1)
    return totals.withColumn(PLACE, F.explode(held)).drop(bits)


def with_totals(rows: DataFrame, key: str, by: str, *totals: Column) -> DataFrame:
    """rows with aggregates of their group; rows without a key go. A group is joined by key and place, so no task gets a whole large one."""
    rows = rows.withColumn(PLACE, place(by))
    found = rows.groupBy(key).agg(*totals, places(F.col(PLACE)).alias("_places"))
    return rows.join(at_places(found, "_places"), [key, PLACE]).drop(PLACE)
