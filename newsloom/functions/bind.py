"""Names for intermediate values that must be computed once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """`keep` and the new columns, each computed once per row.

    Spark pushes a filter on a plain computed column below the projection and
    computes the column again there, as often as the filter names it.  It does
    not push through a generator, so a one-row generator keeps costly columns
    (parsing, edit distances) single.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def compiled(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """As `computed`, for long expressions: they are a projection below the generator.

    A generator's own expressions are interpreted if one of them is a higher-order function; a projection compiles the rest.
    """
    made = df.select(*keep, F.struct(*(c.alias(n) for n, c in columns.items())).alias("_made"))
    return made.select(*keep, F.inline(F.array("_made")))
