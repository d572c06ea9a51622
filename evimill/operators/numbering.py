"""Consecutive numbering inside groups of any size.

``row_number().over(partitionBy(group))`` sends a whole group through one task. Here a
group is cut into ranges of its order key, each range is summed on its own, and the sums
of the ranges before it are added: no task sees more than one range of one group, and
the numbers are the same whatever the cuts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys drawn per range, so that ranges come out about even.
_DRAWS = 8


def range_count(df: DataFrame) -> int:
    """Number of ranges: as many as the session shuffles into."""
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return max(2, int(setting) if setting.isdigit() else 200)


def _cut_points(keys: DataFrame, ranges: int) -> Column:
    """Sorted array of keys drawn by hash, ``ranges`` or somewhat more or less, always the same.

    Every key is drawn with the same chance, which follows from the number of rows, so about
    ``_DRAWS`` times ``ranges`` are collected whatever the size of the input. The array is a
    scalar subquery.
    """
    rows = keys.agg(F.count(F.lit(1))).scalar()
    one_in = F.greatest(F.lit(1), F.ceil(rows / (ranges * _DRAWS)))
    drawn = keys.filter(F.pmod(F.xxhash64(*keys.columns), one_in) == 0)
    step = F.greatest(F.lit(1), F.floor(F.size("s") / ranges))
    return (
        drawn.agg(F.collect_list(F.struct(*keys.columns)).alias("s"))
        .select(F.array_sort("s").alias("s"))
        .select(F.filter("s", lambda _, i: i % step == step - 1))
        .scalar()
    )


def _range_of(key: Column, cuts: Column, ranges: int) -> Column:
    """Number of cut points not above the key, found by halving: a step for each bit, not one for each cut.

    There are at most ``_DRAWS`` times as many cuts as ranges but for chance; beyond the last step
    the number would be too small but still the same for the same key and in order of keys.
    """
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range((2 * _DRAWS * ranges).bit_length()))])

    def found(one: Column) -> Column:
        def step(below: Column, more: Column) -> Column:
            return F.when(F.try_element_at(cuts, below + more) <= one, below + more).otherwise(below)

        return F.aggregate(steps, F.lit(0), step)

    # the key is made once, not at each step
    return F.element_at(F.transform(F.array(key), found), 1)


def _placed(df: DataFrame, keys: list[str], ranges: int | None, drawn_from: DataFrame | None) -> DataFrame:
    """Rows dealt by ``_slot``: their group and their range of ``keys``, of which the first is the group."""
    ranges = ranges or range_count(df)
    cuts = _cut_points((drawn_from or df).select(*keys), ranges)
    range_no = _range_of(F.struct(*keys), F.col("_cuts"), ranges)
    # One struct as the key of shuffle and join: a struct is never null, so the optimizer
    # adds no null test to either side, and the two sides read the same exchange.
    return (
        df.withColumn("_cuts", cuts)
        .withColumn("_slot", F.struct(F.col(keys[0]).alias("group"), range_no.alias("range")))
        .drop("_cuts")
        .repartition(range_count(df), "_slot")
    )


def _starts(placed: DataFrame, weight: Column) -> DataFrame:
    """(_slot, _start): sum of ``weight`` over the ranges before, in the same group."""
    # The filter is always true. It reads every column, so that none is pruned out of this branch
    # and the exchange is the same one; counts would not do, as the optimizer drops columns that
    # cannot be null from them.
    columns = [c for c in placed.columns if c != "_slot"]
    sums = (
        placed.groupBy("_slot")
        .agg(F.sum(weight).alias("_sum"), F.max(F.xxhash64(*columns)).alias("_read"))
        .filter(F.col("_read").isNotNull())
    )
    earlier = (
        Window.partitionBy("_slot.group")
        .orderBy("_slot.range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sums.select("_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))


def placed_rows(df: DataFrame, group: str, order: list[str], drawn_from: DataFrame | None = None) -> DataFrame:
    """Rows with ``_slot``, dealt as :func:`in_ranges` and :func:`with_offset` deal them.

    Another use of the same rows reads their exchange once more instead of computing them again, if it
    reads every column and no filter moves below the exchange: :func:`by_slot` sees to both.
    """
    return _placed(df, [group, *order], None, drawn_from)


def by_slot(rows: DataFrame, group: str, *aggregates: Column) -> DataFrame:
    """Aggregates of every range, one row each, with the group it belongs to as ``group``.

    The filter is always true and reads every column, as in :func:`_starts`. The group is an aggregate
    itself, so that no test of it moves below the exchange; it is taken from the few rows of the sums, as
    an aggregate of texts would sort all rows.
    """
    columns = [c for c in rows.columns if c != "_slot"]
    sums = (
        rows.groupBy("_slot")
        .agg(*aggregates, F.max(F.xxhash64(*columns)).alias("_read"))
        .filter(F.col("_read").isNotNull())
    )
    names = [c for c in sums.columns if c not in {"_slot", "_read"}]
    once = sums.groupBy("_slot").agg(F.max("_slot.group").alias(group), *[F.max(c).alias(c) for c in names])
    return once.select(group, *names)


def in_ranges(df: DataFrame, group: str, order: list[str], weight: Column) -> DataFrame:
    """Rows with ``_slot``, their range of their group, and ``_start``, the sum of ``weight`` over the ranges before.

    Rows that agree in group and order share a range, so what they hold can be ordered within it:
    a window over ``_slot`` needs no further shuffle.
    """
    placed = _placed(df, [group, *order], None, None)
    return placed.join(_starts(placed, weight), "_slot")


def with_offset(
    df: DataFrame, group: str, order: list[str], weight: Column, name: str, ranges: int | None = None,
    drawn_from: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same group that come earlier in order.

    ``group`` and ``order`` together must be unique. The range sums read the same shuffle
    as the rows themselves (a reused exchange), so the input is computed once. That holds if
    no column of ``df`` is dropped afterwards; leave out before what is not needed.

    The cuts are drawn from the keys of ``df``, or from ``drawn_from`` where keys spread alike
    come cheaper than those of ``df`` itself; numbers do not depend on them.
    """
    placed = _placed(df, [group, *order], ranges, drawn_from)
    inside = Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(_starts(placed, weight), "_slot")
        .withColumn(name, F.col("_start") + F.col("_before"))
        .select(*df.columns, name)
    )
