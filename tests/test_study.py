"""Study plans: reading, defaults, budgets, order."""

import json

import pytest
from pyspark.sql import functions as F

from evimill.operators import study_plan as P
from evimill.sources import files as SF

STUDY = {
    "study": {"name": "s", "fuzz_time": 3600, "fuzz_env": {"A": "1"}, "unknown": 1},
    "crate": [
        {
            "name": "one", "path": "targets/one", "cohort": "baseline", "coverage_tier": "tier1",
            "miri_case": [
                {"name": "h", "harness_dir": "m/one", "exact": True, "scope": "targeted", "env": {"K": "V"}},
                {"name": "plain"},
            ],
            "fuzz_group": [{"name": "g", "targets": ["a", "b"], "time": 30}, {"name": "all", "all": True, "harness_dir": "f"}],
        },
        {"name": "two", "path": "targets/two", "miri_case": [{"name": "only_harness", "harness_dir": "m/two"}]},
        {"name": "three", "path": "targets/three"},
    ],
}


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("study") / "study.json"
    path.write_text(json.dumps(STUDY, indent=1))
    return SF.read_study(spark, str(path))


def test_settings_and_crates(study):
    settings, crates = study
    assert settings.first()["fuzz_env"] == {"A": "1"}
    got = crates.orderBy("crate_ord").select("crate_ord", "name", "cohort").collect()
    assert [tuple(r) for r in got] == [(0, "one", "baseline"), (1, "two", None), (2, "three", None)]


def test_defaults(study):
    cases = P.study_cases(study[1]).orderBy("crate", "ordinal").collect()
    assert [(r["crate"], r["name"], r["scope"], r["exact"]) for r in cases] == [
        ("one", "h", "targeted", True), ("one", "plain", "unspecified", False), ("two", "only_harness", "unspecified", False),
    ]
    groups = P.study_groups(study[1]).orderBy("ordinal").collect()
    assert [(r["name"], r["take_all"], r["targets"]) for r in groups] == [("g", False, ["a", "b"]), ("all", True, [])]
    targets = P.group_targets(P.study_groups(study[1])).orderBy("ordinal").collect()
    assert [(r["group_name"], r["ordinal"], r["target"]) for r in targets] == [("g", 0, "a"), ("g", 1, "b")]


def test_entries_keep_crates_without_any(study):
    got = P.study_entries(study[1]).filter("crate = 'three'").collect()
    assert [(r["entry"], r["name"]) for r in got] == [(None, None)]


def test_budget(evaluate):
    rows = [(600,), (None,), (10,), (900,)]
    caps = {p: evaluate(rows, "t bigint", P.capped_budget(F.col("t"), p)) for p in ("smoke", "baseline", "full")}
    assert caps == {"smoke": [30, 30, 10, 30], "baseline": [300, 300, 10, 300], "full": [600, None, 10, 900]}
    rows = [(30, 50, 3600), (None, 50, 3600), (None, None, 3600), (None, None, None)]
    schema, args = "g bigint, c bigint, s bigint", (F.col("g"), F.col("c"), F.col("s"))
    assert evaluate(rows, schema, P.effective_budget(*args, "full")) == [30, 50, 3600, 60]
    assert evaluate(rows, schema, P.effective_budget(*args, "baseline")) == [30, 50, 300, 300]


def test_injection(spark):
    crates = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "crate_id int, workspace boolean")
    entries = spark.createDataFrame(
        [(1, "b", None), (1, "h", "d"), (2, "h", "d"), (3, "h", "d")], "crate_id int, name string, harness_dir string"
    )
    every = P.inject_defaults(crates, entries, P.DEFAULT_CASE).filter("injected").orderBy("crate_id").collect()
    assert [(r["crate_id"], r["name"], r["scope"]) for r in every] == [(c, "upstream_full", "full_suite") for c in (2, 3, 4)]
    local = P.inject_defaults(crates, entries, P.DEFAULT_GROUP, F.col("workspace")).filter("injected")
    assert sorted(r["crate_id"] for r in local.collect()) == [2, 4]


def test_harness_groups(spark):
    crates = spark.createDataFrame([(1, "serde_json"), (2, "memchr"), (3, "none")], "crate_id int, name string")
    groups = spark.createDataFrame([(1, "g", None), (2, "own", "h")], "crate_id int, name string, harness_dir string")
    dirs = spark.createDataFrame([("serde-json", "d/s"), ("memchr", "d/m")], "name string, path string")
    got = P.attach_harness_groups(crates, groups, dirs).filter("name = 'harness_targets'").collect()
    assert [(r["crate_id"], r["harness_dir"], r["take_all"]) for r in got] == [(1, "d/s", True)]


def test_single_crate(spark):
    crates = spark.createDataFrame([(1, None), (2, {"ASAN_OPTIONS": "x", "B": "1"})], "crate_id int, env map<string,string>")
    cases, groups = P.single_crate_entries(crates, F.lit(30), F.col("env"))
    assert [r["name"] for r in cases.collect()] == ["upstream_full"] * 2
    got = {r["crate_id"]: r["env"] for r in groups.collect()}
    assert got == {1: {"ASAN_OPTIONS": "detect_leaks=0"}, 2: {"ASAN_OPTIONS": "x", "B": "1"}}


def test_plan_order(spark):
    entries = spark.createDataFrame([(1, 0, "h"), (1, 1, None), (1, 2, None), (1, 3, "h"), (2, 0, "h")], "crate_id int, ordinal int, harness_dir string")
    got = P.plan_order(entries).orderBy("crate_id", "position").collect()
    assert [(r["crate_id"], r["position"], r["ordinal"]) for r in got] == [(1, 1, 1), (1, 2, 2), (1, 3, 0), (1, 4, 3), (2, 1, 0)]


def test_selection(spark):
    df = spark.createDataFrame([("a", "scan"), ("b", "miri"), ("b", "fuzz")], "crate string, kind string")
    names = spark.createDataFrame([("b",), ("nowhere",)], "n string")
    assert P.select_crates(df, ["b", "nowhere"]).count() == P.select_crates(df, names).count() == 2
    assert P.select_phases(df, ["scan", "fuzz"]).count() == 2
    assert P.phase_label(["geiger", "scan"]) == "scan, geiger" and P.phase_label([]) == "-"
    with pytest.raises(ValueError, match="selected no crates"):
        P.require_crates(P.select_crates(df, ["nowhere"]))
    P.require_crates(P.select_crates(df, ["a", "nowhere"]))
