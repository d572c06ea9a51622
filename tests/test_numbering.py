"""Numbering inside groups, with one group far larger than the others."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evimill.operators.numbering import with_offset


def brute_force(rows):
    offsets, total = {}, defaultdict(int)
    for group, key, weight in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        offsets[group, key] = total[group]
        total[group] += weight
    return offsets


def skewed_rows(seed, n=3000):
    rng = random.Random(seed)
    groups = ["hot"] * 6 + ["b", "c", "d", None, "é", ""]
    return [(rng.choice(groups), f"f{rng.random():.12f}", rng.choice([0, 0, 1, 1, 2, 30])) for _ in range(n)]


@pytest.mark.parametrize("ranges", [2, 7, 100, 500])
def test_offsets_do_not_depend_on_the_cuts(spark, ranges):
    rows = skewed_rows(ranges)
    df = spark.createDataFrame(rows, "g string, k string, w int")
    got = with_offset(df, "g", ["k"], F.col("w"), "offset", ranges).collect()
    assert len(got) == len(rows)
    assert {(r["g"], r["k"]): r["offset"] for r in got} == brute_force(rows)


def test_hot_group_is_worked_on_in_many_ranges(spark):
    """No window partition holds more than a small part of the hot group."""
    df = spark.createDataFrame(skewed_rows(1, 20000), "g string, k string, w int")
    placed = with_offset(df, "g", ["k"], F.col("w"), "offset", 64)
    window = next(line for line in placed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [sum" in line)
    assert "_slot" in window
    from evimill.operators import numbering

    cuts = numbering._cut_points(df.select("g", "k"), 64)
    keys = df.withColumn("c", cuts).withColumn("r", numbering._range_of(F.struct("g", "k"), F.col("c"), 64))
    sizes = [r["count"] for r in keys.groupBy("g", "r").count().collect()]
    assert max(sizes) < 20000 / 10


def test_input_is_read_once_by_both_branches(spark, tmp_path):
    df = spark.createDataFrame(skewed_rows(2), "g string, k string, w int")
    df.write.parquet(str(tmp_path / "t"))
    placed = with_offset(spark.read.parquet(str(tmp_path / "t")), "g", ["k"], F.col("w"), "offset", 8)
    placed.collect()
    assert "ReusedExchange" in placed._jdf.queryExecution().executedPlan().toString()


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, k string, w int")
    assert with_offset(df, "g", ["k"], F.col("w"), "offset").collect() == []


def test_ranges_are_found_by_halving(spark):
    """A key is compared with a few of many cuts, and meets the number of those not above it."""
    from evimill.operators import numbering

    cuts = F.array(*[F.struct(F.lit(2 * k).cast("bigint").alias("k")) for k in range(300)])
    placed = spark.range(-3, 605).withColumn("c", cuts).select("id", numbering._range_of(F.struct(F.col("id").alias("k")), F.col("c"), 300).alias("r"))
    assert [r["r"] for r in placed.orderBy("id").collect()] == [min(300, max(0, k // 2 + 1)) for k in range(-3, 605)]
    assert "filter(" not in placed._jdf.queryExecution().optimizedPlan().toString()
