"""Settling computed columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with `columns` computed once per row.

    The columns go through a one-row generator, which the optimizer neither
    merges into later projections nor pushes filters through, so a long
    expression that is used many times isn't repeated at each use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
