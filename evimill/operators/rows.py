"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: list[str | Column], array: Column, pos: str, item: str) -> DataFrame:
    """One row per array element, with its 0-based position.

    For arrays that are costly to compute. From a plain explode the optimizer derives a
    filter for non-empty arrays and pushes it down, which computes the array once more.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
