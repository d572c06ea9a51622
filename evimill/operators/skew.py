"""Joins whose key may be hot.

Adaptive execution splits a hot key only where both sides of a sort-merge join come straight
from a shuffle. A side that was just aggregated by the join keys is partitioned by them
already, the join makes use of that, and the rows of a hot key on the other side all meet in
one task. The functions here give the small side of such a join another partitioning, so that
the join shuffles its few rows once more. A side small enough is broadcast as ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimill.operators.numbering import range_count


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as the session shuffles into, never to fewer.

    Adaptive execution puts partitions together by their bytes on disk. Targets of an inventory or logs
    made of few words take a byte or two a row there, so that one task gets tens of millions of rows,
    which it holds at their full width to group or sort them.
    """
    return df.repartition(range_count(df), *keys)


def lookup_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, made distinct under a wider partitioning than that of the keys."""
    return df.select(*keys, F.xxhash64(*keys).alias("_wider")).distinct().drop("_wider")


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same for rows whose keys are unique already, where a distinct would be optimized away."""
    return df.select(*keys).repartition(F.xxhash64(*keys))
