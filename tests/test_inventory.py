"""Inventory joins on small fixtures, with brute force where there is something to count."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from evimill.operators import inventory as I

TARGETS = "group_id string, target string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def frames(spark, groups, configured, discovered):
    return (
        spark.createDataFrame(groups, "group_id string, take_all boolean, listing_summary string"),
        spark.createDataFrame(configured, TARGETS),
        spark.createDataFrame(discovered, TARGETS),
    )


def test_listing_leaves_out_blanks_and_warnings(spark):
    df = spark.createDataFrame([("g", "warning: ignore\n parse \n\nother\n")], "g string, t string")
    assert rows(I.discovered_targets(df, "g", F.col("t")), "g", "target") == [("g", "other"), ("g", "parse")]


def test_collapse_to_one_record(spark):
    got = I.group_collapse(*frames(spark, [("g", False, None)], [("g", "parse"), ("g", "x")], [("g", "other")]))
    assert rows(got, "group_id", "target", "status", "summary") == [
        ("g", None, "skipped", "no fuzz targets available: configured fuzz targets not present in local workspace")
    ]


def test_collapse_names_the_cause(spark):
    groups = [("none", False, None), ("failed", True, "cargo fuzz list failed"), ("all", True, None), ("some", False, None)]
    configured = [("none", "a"), ("some", "a"), ("some", "b")]
    got = I.group_collapse(*frames(spark, groups, configured, [("all", "z"), ("some", "a")]))
    assert rows(got, "group_id", "target", "summary") == [
        ("failed", None, "no fuzz targets available: cargo fuzz list failed"),
        ("none", None, "no fuzz targets available: no fuzz targets discovered"),
        ("some", "b", "configured fuzz target b not present in local workspace"),
    ]


def test_random_inventories(spark):
    rng = random.Random(3)
    names, targets = [f"g{i}" for i in range(12)], [f"t{i}" for i in range(9)]
    hot = ["g0"] * 8
    groups = [(g, rng.random() < 0.3, None) for g in names]
    configured = [(rng.choice(names + hot), rng.choice(targets)) for _ in range(60)]
    discovered = [(rng.choice(names[:8] + hot), rng.choice(targets)) for _ in range(40)]
    take_all = {g: every for g, every, _ in groups}
    found = set(discovered)
    to_run = sorted([r for r in configured if r in found and not take_all[r[0]]] + [r for r in found if take_all[r[0]]])
    g, c, d = frames(spark, groups, configured, discovered)
    assert rows(I.targets_available(g, c, d), "group_id", "target") == to_run
    missing = sorted(r for r in configured if r not in found)
    assert rows(I.targets_missing(c, d), "group_id", "target") == missing
    running = {r[0] for r in to_run}
    expected = [(n, None) for n in names if n not in running] + [
        r for r in missing if r[0] in running and not take_all[r[0]]
    ]
    assert rows(I.group_collapse(g, c, d), "group_id", "target") == sorted(expected, key=str)


def test_harness_takes_first_path(spark):
    crates = spark.createDataFrame([("serde_json",), ("memchr",)], "name string")
    dirs = spark.createDataFrame([("serde-json", "z/1"), ("serde_json", "a/2"), ("other", "o")], "name string, path string")
    assert rows(I.harness_attach(crates, dirs), "name", "harness_dir") == [("memchr", None), ("serde_json", "a/2")]


def test_backfill_does_not_merge(spark):
    schema = "crate string, target string, file string"
    corpus = spark.createDataFrame([("c", "t", "mine")], schema)
    seeds = spark.createDataFrame([("c", "t", "seed"), ("c", "u", "seed1"), ("c", "u", "seed2")], schema)
    assert rows(I.seed_backfill(corpus, seeds), "target", "file") == [("t", "mine"), ("u", "seed1"), ("u", "seed2")]


def test_artifacts(spark):
    schema = "dir string, path string, modified timestamp"
    t = [datetime(2024, 1, day) for day in (1, 2, 3)]
    before = spark.createDataFrame([("d", "old", t[0]), ("d", "touched", t[0]), ("e", "old", t[1])], schema)
    after = spark.createDataFrame(
        [("d", "old", t[0]), ("d", "touched", t[1]), ("d", "new", t[1]), ("e", "old", t[1]), ("f", "x", t[2])], schema
    )
    changed = I.artifacts_changed(before, after)
    assert rows(changed, "dir", "path") == [("d", "new"), ("d", "touched"), ("f", "x")]
    assert rows(I.artifact_newest(changed), "dir", "path") == [("d", "touched"), ("f", "x")]


def test_null_take_all_means_no(spark):
    groups, configured, discovered = frames(spark, [("g", None, None)], [("g", "a"), ("g", "b")], [("g", "a")])
    assert rows(I.targets_available(groups, configured, discovered), "group_id", "target") == [("g", "a")]
    assert rows(I.group_collapse(groups, configured, discovered), "group_id", "target", "status") == [("g", "b", "skipped")]


def test_repeated_missing_targets_are_reported_each(spark):
    got = I.group_collapse(*frames(spark, [("g", False, None)], [("g", "a"), ("g", "b"), ("g", "b")], [("g", "a")]))
    assert rows(got, "group_id", "target") == [("g", "b"), ("g", "b")]


def test_collapse_counts_a_target_once(spark):
    got = I.group_collapse(*frames(spark, [("g", False, None)], [("g", "a"), ("g", "b"), ("g", "b"), (None, "c")], [("g", "a"), ("g", "a")]), once=True)
    assert rows(got, "group_id", "target", "status") == [("g", "b", "skipped")]
