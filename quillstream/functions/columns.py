"""Helpers for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_case(rules: list[tuple[Column, object]], otherwise: Column | None = None) -> Column:
    """The value of the first rule that holds."""
    out = otherwise if otherwise is not None else F.lit(None)
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return out


def filled(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))
