"""Records, roll-ups, review lists, sinks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evimill.functions import logs as L
from evimill.functions.vocabulary import REVIEW_SUFFIX
from evimill.operators import evidence as E
from evimill.operators import report as R
from evimill.operators.numbering import placed_rows
from evimill.operators.study_plan import RunSettings
from evimill.plans import reports
from evimill.sources import files as SF
from evimill.sources import reports as SR
from test_queries import nodes

STATUS = "crate string, kind string, status string"


def test_rollup_takes_the_worst(spark):
    rows = {
        "x": (["error", "finding"], "finding"), "y": (["clean", "pass"], "pass"), "z": (["skipped"], "skipped"),
        "v": (["pass", "error", "clean"], "error"), "w": (["skipped", "clean"], "clean"),
    }
    df = spark.createDataFrame([(c, "fuzz", s) for c, (all_, _) in rows.items() for s in all_], STATUS)
    assert {r["crate"]: r["status"] for r in E.status_rollup(df).collect()} == {c: w for c, (_, w) in rows.items()}
    counts = spark.createDataFrame([("x", 3), ("q", 0)], "crate string, n_sites bigint")
    got = {r["crate"]: tuple(r)[1:] for r in R.overview(counts, df).collect()}
    assert got == {"x": ("3", "-", "-", "finding"), "q": ("0", "-", "-", "-")}
    assert {r["sites"] for r in R.overview(counts, df, scan_selected=False).collect()} == {"-"}


def test_review_order_and_reasons(spark):
    schema = "crate string, site_id string, file string, line int, seq int, kind string, pattern string"
    sites = spark.createDataFrame(
        [
            ("c", "U0001", "b.rs", 10, 1, "operation", "unchecked_op"), ("c", "U0002", "a.rs", 1, 1, "operation", "transmute"),
            ("c", "U0003", "a.rs", 2, 1, "unsafe_fn", None), ("c", "U0004", "z.rs", 9, 1, "operation", "ptr_op"),
            ("d", "U0001", "a.rs", 1, 1, "unsafe_block", "ptr_op"),
        ],
        schema,
    )
    records = spark.createDataFrame([("c", "miri", "error"), ("d", "miri", "clean")], STATUS)
    got = R.review_priority(sites, records).orderBy("crate", "rank").collect()
    assert [(r["crate"], r["site_id"], r["reason"]) for r in got] == [
        ("c", "U0002", "transmute" + REVIEW_SUFFIX), ("c", "U0004", "ptr_op" + REVIEW_SUFFIX),
        ("c", "U0001", "unchecked_op" + REVIEW_SUFFIX), ("c", "U0003", "unsafe_fn"), ("d", "U0001", "ptr_op"),
    ]


def test_review_meets_ten_rows_of_each_part(spark):
    """Two levels of ranking; what the last one reads of a crate is bounded by the parts, not by the sites."""
    sites = spark.range(50_000).selectExpr(
        "concat('hot', id div 50000) AS crate", "concat('f', id % 97) AS file", "CAST(id AS int) AS line", "1 AS seq", "'operation' AS kind",
        "CASE WHEN id % 5000 = 7 THEN 'transmute' ELSE 'link' END AS pattern", "concat('U', id) AS site_id",
    )
    got = R.review_priority(sites.repartition(40))
    rows = [(r["rank"], r["line"]) for r in got.orderBy("rank").collect()]
    wanted = sorted((f"f{k % 97}", k) for k in range(7, 50_000, 5000))
    assert rows == [(n + 1, line) for n, (_, line) in enumerate(wanted)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(crate" in plan and "_part" in plan and plan.count("WindowGroupLimit") >= 3
    order, parts = ["file", "line", "seq"], F.pmod(F.xxhash64("file", "line", "seq"), F.lit(R.REVIEW_PARTS))
    first = R._first_ten(sites.withColumn("_part", parts), ["crate", "_part"], order)
    assert first.count() == R.REVIEW_PARTS * 10


def test_review_of_a_hot_crate(spark):
    rng = random.Random(5)
    rows = [
        ("hot" if rng.random() < 0.5 else f"c{rng.randrange(40)}", f"U{i}", f"f{rng.randrange(50)}", rng.randrange(9), i, "operation", rng.choice(["transmute", "ptr_op", "unchecked_op", "x"]))
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "crate string, site_id string, file string, line int, seq int, kind string, pattern string")
    score = {"transmute": 0, "ptr_op": 1, "unchecked_op": 2, "x": 3}
    expected = {}
    for r in sorted(rows, key=lambda r: (score[r[6]], r[2], r[3], r[4])):
        expected.setdefault(r[0], []).append(r[1])
    got = R.review_priority(df)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    mine = {}
    for r in got.orderBy("crate", "rank").collect():
        mine.setdefault(r["crate"], []).append(r["site_id"])
    assert mine == {c: ids[:10] for c, ids in expected.items()}


RUNS = "crate string, case_name string, scope string, success boolean, duration_ms bigint, combined_output string"


def test_case_records(spark):
    ub = "undefined behavior: stacked borrow"
    strict = spark.createDataFrame(
        [("c", "both", "targeted", False, 5, ub), ("c", "strict", "targeted", False, 5, ub), ("c", "alone", "targeted", False, 5, ub),
         ("c", "fine", "targeted", True, 5, "ok"), ("c", "bad", "targeted", False, 5, "boom")],
        RUNS,
    )
    baseline = spark.createDataFrame([("c", n, "targeted", True, 7, t) for n, t in [("both", ub), ("strict", "ok"), ("fine", ub), ("bad", ub)]], RUNS)
    got = {r["case_name"]: r for r in E.case_records(strict, baseline).collect()}
    assert {n: (r["verdict"], r["status"], r["ub_category"], r["duration_ms"]) for n, r in got.items()} == {
        "both": ("ub_observed", "finding", "provenance", 12), "strict": ("strict_only_ub", "finding", "provenance", 12),
        "alone": ("ub_observed", "finding", "provenance", 5), "fine": ("clean", "clean", None, 5), "bad": ("failed_no_ub", "error", None, 5),
    }
    assert got["strict"]["excerpt"] == ub + "\n\n--- baseline ---\nok"
    assert got["strict"]["summary"] == "targeted scope, verdict strict_only_ub"
    no_triage = {r["verdict"] for r in E.case_records(strict, baseline, triage=False).filter("case_name = 'strict'").collect()}
    assert no_triage == {"ub_observed"}


def test_records_of_logs_read_from_files(spark, tmp_path):
    logs = {
        "crates/demo/logs/miri.upstream_full.log": b"test result: ok\xff",
        "crates/demo/logs/fuzz.g_t.log": b"#1 runs: 123 cov: 4",
        "crates/demo/notes.log": b"no log of a run",
    }
    for path, content in logs.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    runs = SF.read_tool_logs(spark, str(tmp_path)).withColumns({"success": F.lit(True), "duration_ms": F.lit(1).cast("bigint")})
    got = {r["kind"]: r for r in E.phase_records(runs, F.lit("/w/demo")).collect()}
    assert set(got) == {"miri", "fuzz"}
    assert (got["fuzz"]["name"], got["fuzz"]["status"], int(got["fuzz"]["runs"])) == ("g_t", "clean", 123)
    assert (got["miri"]["verdict"], got["miri"]["excerpt"]) == ("clean", "test result: ok�")
    assert got["fuzz"]["log_path"] == "crates/demo/logs/fuzz.g_t.log"


def test_seed_reader(spark, tmp_path):
    for path in ["one/corpus/t/a", "one/corpus/t/sub/b", "one/src/x"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"s")
    got = SF.read_seeds(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["crate"], r["target"], r["file"]) for r in got] == [("one", "t", "a"), ("one", "t", "sub/b")]


def test_report_can_be_read_back(spark, tmp_path):
    documents = reports.report_nested(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "report")
    SR.write_report(documents, path)
    tables = SR.read_report(spark, path)
    records = reports.logs.crate_records(spark, "/root/testdata/sf0.001").drop("group_ord")
    study = tables["study"].first()
    assert study["study_name"] == "logs" and study["execution"]["fuzz_env"] == {"A": "1", "B": "2"}
    wanted = [c for c in records.columns if c != "record_no"]
    assert tables["phases"].select(wanted).exceptAll(records.select(wanted)).isEmpty()
    assert tables["phases"].count() == records.count()
    review = reports.code_review_priority(spark, "/root/testdata/sf0.001")
    assert tables["review"].select(review.columns).exceptAll(review).isEmpty() and tables["review"].count() == review.count()
    sites = tables["sites"].groupBy("crate").agg(F.count("*").alias("n"), F.max("number").alias("last"))
    heads = tables["crates"].select("crate", F.col("n_sites").alias("n"), F.col("n_sites").alias("last"))
    assert sites.exceptAll(heads).isEmpty()
    plan = tables["crates"].orderBy("crate_ord").select("crate", "path", "pattern_summary.*").collect()
    assert len(plan) == 25 and plan[0]["crate"] == "c0" and all(r["path"].startswith("targets/") for r in plan)
    assert sum(r["unsafe_blocks"] for r in plan) == tables["sites"].filter("kind = 'unsafe_block'").count()
    assert tables["phases"].filter("command LIKE 'cargo fuzz run %'").count() > 0


def test_markdown_is_written_in_order(spark, tmp_path):
    rows = reports.markdown_report(spark, "/root/testdata/sf0.001")
    path = tmp_path / "md"
    SR.write_markdown(rows, str(path))
    lines = [line for part in sorted(path.glob("part-*")) for line in part.read_text().split("\n")[:-1]]
    expected = [r["text"] for r in rows.orderBy(*R.REPORT_ORDER).collect()]
    assert lines == expected
    start = lines.index("## Crate `c0`")
    assert lines[start + 1 : start + 5] == ["", "Path: `targets/algeria`", "", "### Unsafe inventory"] or lines[start + 2].startswith("Path: `targets/")
    assert lines[start + 6].startswith("- sites: ")
    crates = [line.split("`")[1] for line in lines if line.startswith("## Crate ")]
    assert crates == [r["crate"] for r in reports.V.study(spark, "/root/testdata/sf0.001").orderBy("crate_ord").collect()]
    assert lines[0] == "# evidence report" and lines[start - 2].startswith(f"| {crates[-1]} |")


def test_report_without_scan_reads_no_code(spark):
    rows = reports.markdown_report_without_scan(spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in rows._jdf.queryExecution().executedPlan().toString()
    texts = [r["text"] for r in rows.filter("crate = 'c0'").orderBy(*R.REPORT_ORDER).collect()]
    assert texts[0].startswith("| c0 | - |") and texts[7 + 1 : 7 + 3] == ["- scan: skipped", "- sites: -"]


def test_null_logs_stay(spark):
    strict = spark.createDataFrame([("c", "x", "targeted", True, 5, None), ("c", "y", "targeted", False, 5, None)], RUNS)
    for triage in (True, False):
        got = {r["case_name"]: r["verdict"] for r in E.case_records(strict, strict.limit(0), triage).collect()}
        assert got == {"x": "clean", "y": "failed_no_ub"}
    runs = spark.createDataFrame(
        [("c", k, "n", True, 1, None) for k in ("geiger", "miri", "fuzz")],
        "crate string, kind string, name string, success boolean, duration_ms bigint, combined_output string",
    )
    assert {r["kind"]: r["status"] for r in E.phase_records(runs, F.lit("/w/c")).collect()} == dict.fromkeys(["geiger", "miri", "fuzz"], "clean")
    assert E.run_statuses(runs).count() == 3


def test_several_baselines_give_one_record(spark):
    ub = "undefined behavior"
    strict = spark.createDataFrame([("c", "x", "targeted", False, 5, ub)], RUNS)
    baseline = spark.createDataFrame([("c", "x", "targeted", True, ms, t) for ms, t in [(1, "ok"), (9, ub), (7, ub), (2, None)]], RUNS)
    (row,) = E.case_records(strict, baseline).collect()
    assert (row["verdict"], row["duration_ms"]) == ("ub_observed", 12)


def test_records_of_builds_and_missing_targets(spark):
    schema = (
        "crate string, kind string, name string, success boolean, duration_ms bigint, combined_output string, stage string, "
        "budget bigint, scope string, artifact string, group_name string, group_ord int"
    )
    bin_text = "error: can't find bin `t` at path `/x/t.rs`"
    runs = spark.createDataFrame(
        [
            ("c", "fuzz", "t", False, 1, bin_text, "build", 30, None, "a", "g", 0),
            ("c", "fuzz", "u", False, 1, " ", "build", None, None, "a", "g", 0),
            ("c", "fuzz", "v", False, 1, "panic occurred", "run", 30, None, "crash-1", "g", 0),
            ("c", "miri", "m", True, 1, "ok", "run", None, "targeted", None, None, None),
        ],
        schema,
    )
    got = {r["name"]: r for r in E.phase_records(runs, F.lit("/w/c")).collect()}
    assert (got["t"]["status"], got["t"]["error_kind"], got["t"]["artifact"]) == ("skipped", None, None)
    assert got["t"]["summary"] == "target t, budget 30s, declared source missing at /x/t.rs"
    assert (got["u"]["status"], got["u"]["error_kind"], got["u"]["excerpt"]) == ("error", "tool_error", "cargo fuzz build failed for u")
    assert (got["v"]["status"], got["v"]["artifact"], got["v"]["budget_secs"]) == ("finding", "crash-1", 30)
    assert got["m"]["summary"] == "targeted scope, verdict clean" and got["v"]["command"] == "cargo fuzz run v"
    statuses = {r["status"] for r in E.run_statuses(runs).collect()}
    assert statuses == {"skipped", "error", "finding", "clean"}
    skipped = spark.createDataFrame([(1, None, "skipped", "none"), (1, 7, "skipped", "gone")], "group_id bigint, target bigint, status string, summary string")
    plan = spark.createDataFrame([(1, "c", "g", 3, None)], "group_id bigint, crate string, group_name string, group_ord int, budget bigint")
    names = {r["name"]: (r["target"], r["budget_secs"], r["stage"]) for r in E.missing_records(skipped, plan).collect()}
    assert names == {"g": (None, 60, "missing"), "7": ("7", 60, "missing")}


def test_root_package_at_any_position(spark):
    rows = [(1, 2**48 + 5, "demo", None, 4), (1, 2**62, "dep", None, 2), (2, 2**60, "demo", "file:///else", 9), (2, 7, "dep", None, 1), (3, 1, "dep", None, 1)]
    packages = spark.createDataFrame(rows, "report_id int, pos bigint, name string, source_path string, unsafe_exprs bigint")
    root = E.package_root(packages, F.lit("demo"), F.lit("/w/demo"))
    assert sorted(tuple(r) for r in root.collect()) == [(1, 2**48 + 5, 1), (2, 2**60, 2)]
    metrics = E.package_metrics(packages, F.lit("demo"), F.lit("/w/demo"))
    assert sorted(tuple(r) for r in metrics.filter("root_unsafe IS NOT NULL").collect()) == [(1, 4, 2), (2, 9, 1)]


def test_detail_lists_known_fields_in_order(spark):
    fields = {
        "root_unsafe": 4, "dependency_unsafe": None, "verdict": None, "ub_category": None, "target": "t",
        "budget_secs": 30, "error_kind": "finding", "artifact": "a", "runs": 5, "excerpt": " x|y\nz ",
    }
    types = {"root_unsafe": "int", "dependency_unsafe": "int", "budget_secs": "int", "runs": "int"}
    schema = ", ".join(f"{k} {types.get(k, 'string')}" for k in fields)
    df = spark.createDataFrame([tuple(fields.values()), (None,) * len(fields)], schema)
    assert [r["d"] for r in df.select(R.evidence_detail().alias("d")).collect()] == [
        "root_unsafe_exprs=4; target=t; budget=30s; error_kind=finding; artifact=a; runs=5; excerpt=x\\|y z", "-",
    ]


def test_head_states_the_settings():
    lines = R.markdown_head(RunSettings(profile="smoke", jobs=0, phases=("miri",)), "evidence report")
    assert lines[0] == "# evidence report" and "- profile: `smoke`" in lines and "- jobs: `1`" in lines
    assert "- phases: `miri`" in lines and "- default_fuzz_time: `-`" in lines and "- fuzz_env: `-`" in lines


def test_formats(spark, tmp_path):
    documents = spark.createDataFrame([("head", "{}")], "section string, document string")
    lines = spark.createDataFrame([(0, -1, "", 0, 0, "x")], "part int, crate_ord int, crate string, section int, ordinal int, text string")
    SR.write_reports(documents, lines, str(tmp_path / "both"))
    assert sorted(p.name for p in (tmp_path / "both").iterdir()) == ["report.json", "report.md"]
    SR.write_reports(documents, lines, str(tmp_path / "one"), ["markdown"])
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["report.md"]


@pytest.mark.parametrize("name", ["markdown_report", "report_nested"])
def test_code_is_scanned_once_for_a_report(spark, name):
    """Counters and numbered sites come out of one shuffle."""
    df = getattr(reports, name)(spark, "/root/testdata/sf0.001")
    df.collect()
    ran = list(nodes(df._jdf.queryExecution().executedPlan()))
    texts = [t for node, t in ran if node.startswith("Scan") and "documents.parquet" in t and re.search(r"ReadSchema: .*\btext\b", t)]
    assert len(texts) == 1


@pytest.mark.parametrize("name, shuffles", [("markdown_report", 2), ("markdown_report_without_scan", 1), ("report_nested", 2)])
def test_records_are_made_once_for_a_report(spark, name, shuffles):
    """Roll-up and evidence come out of one shuffle, sites and counters out of another."""
    df = getattr(reports, name)(spark, "/root/testdata/sf0.001")
    df.collect()
    ran = list(nodes(df._jdf.queryExecution().executedPlan()))
    assert sum(node == "Exchange" and "hashpartitioning(_slot" in text for node, text in ran) == shuffles


def test_rollup_of_slots_is_that_of_records(spark):
    draw = random.Random(5)
    statuses = ["skipped", "clean", "pass", "error", "finding", None]
    rows = [(draw.choice(["a", "b", "c", None]), draw.choice(["geiger", "miri", "fuzz", "scan"]), draw.choice(statuses), i) for i in range(400)]
    records = spark.createDataFrame([*rows, ("only", "miri", None, 400)], STATUS + ", n int")
    of_kind = {kind: F.col("kind") == kind for kind in E.EVIDENCE_KINDS}
    placed = placed_rows(records, "crate", ["n"])
    got = E.status_columns_of_slots(placed, of_kind, L.severity(F.col("status")))
    expected = E.status_columns(records, E.EVIDENCE_KINDS)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())) and got.count() == 5
    sites = spark.createDataFrame([(c, f"f{i}", k, p) for i, (c, k, p) in enumerate(draw.choices([("a", "unsafe_block", "ptr_op"), ("b", "operation", "transmute"), (None, "x", None)], k=300))], "crate string, file string, kind string, pattern string")
    summary = R.pattern_summary_of_slots(placed_rows(sites, "crate", ["file"]))
    assert sorted(map(str, summary.collect())) == sorted(map(str, R.pattern_summary(sites).collect()))
