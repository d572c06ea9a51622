"""Joins on a key that a third of all rows share, when no side is small enough to broadcast."""

from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from evimill.operators import inventory as I
from evimill.operators import study_plan as P
from evimill.operators.evidence import case_records
from evimill.operators.numbering import with_offset
from evimill.plans import logs
from evimill.sources import views as V

# Sizes scaled down so that the small test tables count as large.
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def large_tables(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """(group_id, crate, target, file), a third of them in group 0, written in many files."""
    path = str(tmp_path_factory.mktemp("skew") / "rows")
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    df = spark.range(0, 120000, 1, 8).select(
        hot.alias("group_id"),
        F.concat(F.lit("c"), hot).alias("crate"),
        (F.col("id") % 7000).alias("target"),
        F.sha2(F.col("id").cast("string"), 256).alias("file"),
    )
    df.write.parquet(path)
    return spark.read.parquet(path)


def run(df):
    got = df.collect()
    return got, df._jdf.queryExecution().executedPlan().toString()


def test_selection_by_crate(spark, rows):
    names = rows.select("crate").distinct().filter("crate <> 'c1'")
    with large_tables(spark):
        got, plan = run(P.select_crates(rows, names))
    assert len(got) == rows.filter("crate <> 'c1'").count()
    assert "skew=true" in plan


def test_available_targets(spark, rows):
    groups = rows.select("group_id").distinct().withColumn("take_all", F.col("group_id") % 5 == 4)
    found = rows.filter("target % 2 = 0").select("group_id", "target")
    with large_tables(spark):
        got, plan = run(I.targets_available(groups, rows, found))
    local = [(r["group_id"], r["target"]) for r in rows.select("group_id", "target").collect()]
    every = {r for r in local if r[1] % 2 == 0 and r[0] % 5 == 4}
    expected = Counter([r for r in local if r[1] % 2 == 0 and r[0] % 5 != 4]) + Counter(every)
    assert Counter((r["group_id"], r["target"]) for r in got) == expected
    assert "skew=true" in plan


def test_backfill_of_a_hot_target(spark, rows):
    seeds = rows.select("crate", F.when(F.col("group_id") == 0, F.lit(-1)).otherwise(F.col("target")).alias("target"), "file")
    corpus = seeds.filter("target % 2 = 1")
    with large_tables(spark):
        got, plan = run(I.seed_backfill(corpus, seeds))
    own = {(r["crate"], r["target"]) for r in corpus.collect()}
    added = [r for r in seeds.collect() if (r["crate"], r["target"]) not in own]
    assert len(got) == corpus.count() + len(added)
    assert "skew=true" in plan


def test_collapse_with_a_hot_group(spark, rows):
    groups = rows.select("group_id").distinct().select(
        "group_id", F.lit(False).alias("take_all"), F.lit(None).cast("string").alias("listing_summary")
    )
    found = rows.filter("target % 2 = 0 AND group_id % 3 = 0").select("group_id", "target")
    with large_tables(spark):
        got, plan = run(I.group_collapse(groups, rows, found))
    local = [(r["group_id"], r["target"]) for r in rows.select("group_id", "target").collect()]
    present = {r for r in local if r[1] % 2 == 0 and r[0] % 3 == 0}
    running = {g for g, _ in present}
    expected = Counter([r for r in local if r not in present and r[0] in running])
    expected.update((g, None) for g in {g for g, _ in local} - running)
    assert Counter((r["group_id"], r["target"]) for r in got) == expected
    assert "skew=true" in plan


def test_what_packs_well_is_not_put_into_few_tasks(spark):
    """Adaptive execution joins partitions by bytes on disk; lists of targets, logs and keys stay as dealt."""
    listed = spark.range(60000).selectExpr("id % 50 AS group_id", "id % 700 AS target", "false AS take_all", "cast(null AS string) AS listing_summary")
    groups = listed.select("group_id", "take_all", "listing_summary").distinct()
    runs = spark.range(4000).selectExpr("concat('c', id % 3) AS crate", "concat('n', id) AS case_name", "'s' AS scope", "id % 2 = 0 AS success", "1L AS duration_ms", "'Undefined Behavior' AS combined_output")
    numbered = with_offset(listed.select("group_id", "target").distinct(), "group_id", ["target"], F.lit(1), "n")
    for df, keys in (
        (I.group_collapse(groups, listed, listed.filter("target < 300")), "group_id#"), (case_records(runs, runs), "crate#"), (numbered, "_slot#"),
    ):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any(f"hashpartitioning({keys}" in line and "REPARTITION_BY_NUM" in line for line in plan.split("\n")), keys


def test_group_sums_are_made_once(spark, rows):
    """The targets left to report, the groups with nothing to run and those with something read one exchange."""
    groups = rows.selectExpr("group_id", "group_id % 8 = 3 AS take_all", "cast(null AS string) AS listing_summary").distinct()
    _, plan = run(I.group_collapse(groups, rows, rows.filter("target % 2 = 0")))
    dealt = [line for line in plan.split("Initial Plan")[0].split("\n") if "REPARTITION_BY_NUM" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1


def test_keys_of_records_need_no_shuffle(spark):
    """What the cuts are drawn from are all configured targets with their group, without a join on few groups."""
    sf_dir = "/root/testdata/sf0.001"
    keys = logs.record_keys(spark, sf_dir)
    joined = V.configured(spark, sf_dir).join(V.planned_groups(spark, sf_dir), "group_id").select("crate", "group_ord", "target")
    targets = keys.filter("stage = 'missing'").select("crate", "group_ord", "record_no")
    assert targets.count() == joined.count() and not targets.exceptAll(joined).count()
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()
