"""Log classification: one query per function, and the phase records they add up to."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimill.functions import logs as L
from evimill.functions import text as T
from evimill.functions import vocabulary as W
from evimill.operators import evidence as E
from evimill.operators import inventory as I
from evimill.plans import inventory
from evimill.plans.dialect import SPACE, VIEWS, contains_all, contains_any, literal, trim, with_views
from evimill.sources import views as V


def _marks():
    return F.col("marks")


def _runs(kind=None):
    def load(spark, sf_dir):
        runs = V.run_logs(spark, sf_dir)
        return runs if kind is None else runs.filter(F.col("kind") == kind)

    return load


def _per_log(load, name, function):
    """Query of one column: a function of the marks of the log, named ``name``."""

    def query(spark, sf_dir):
        marked = load(spark, sf_dir).withColumn("marks", L.marks(F.col("combined_output")))
        return marked.select("run_id", function(_marks()).alias(name))

    return query


def _fuzz_status(marks):
    return L.fuzz_status(F.col("success"), marks)


def _fuzz_summary(marks):
    return L.fuzz_summary(F.col("name"), _budget(), _fuzz_status(marks), L.fuzz_runs(marks), marks)


def _budget():
    return F.lit(W.DEFAULT_BUDGET_SECONDS).cast("bigint")


def strict_baseline_verdict(spark, sf_dir):
    return E.case_records(V.strict_runs(spark, sf_dir), V.baseline_runs(spark, sf_dir))


def build_outcome(spark, sf_dir):
    failed = V.run_logs(spark, sf_dir).filter("kind = 'fuzz' AND stage = 'build' AND NOT success")
    budget = F.coalesce("budget", _budget())
    return failed.select(
        "run_id", L.build_failure(F.col("name"), budget, F.col("combined_output"), L.marks(F.col("combined_output"))).alias("r")
    ).select("run_id", "r.*")


def package_tool_status(spark, sf_dir):
    counted = E.phase_records(_runs("geiger")(spark, sf_dir), _crate_path())
    return counted.select("run_id", "status", "summary", "root_unsafe", "dependency_unsafe")


def _crate_path():
    return F.concat(F.lit("/w/"), F.col("crate"))


def records(spark, sf_dir):
    """Phase records of all run logs."""
    return E.phase_records(V.run_logs(spark, sf_dir), _crate_path())


def crate_records(spark, sf_dir, with_artifacts=True):
    """All records of a study: targets that are missing, builds, runs, cases; ``record_no`` orders them.

    The plan says what there is to run. What is not there becomes a record at once, what ran is
    read off its log, and a run that left an artifact names the newest one.
    """
    planned = V.planned_groups(spark, sf_dir)
    skipped = I.group_collapse(
        planned.select("group_id", "take_all", "listing_summary"),
        V.configured(spark, sf_dir), V.listed(spark, sf_dir), once=True,
    )
    missing = E.missing_records(skipped, planned).withColumn(
        "record_no", F.coalesce(F.col("target").cast("bigint"), F.lit(0))
    )
    runs = V.run_logs(spark, sf_dir)
    if with_artifacts:
        artifacts = inventory.artifact_newest(spark, sf_dir).withColumnRenamed("path", "artifact")
        runs = runs.join(artifacts, "dir", "left")
    runs = runs.drop("dir")
    ran = E.phase_records(runs, _crate_path()).withColumnRenamed("run_id", "record_no")
    cases = strict_baseline_verdict(spark, sf_dir).select(
        "crate", F.lit("miri").alias("kind"), F.col("case_name").alias("name"), "status", "duration_ms",
        F.expr(_CASE_LOG_PATH).alias("log_path"), "summary", "verdict", "ub_category", "excerpt",
        F.lit(-1).alias("group_ord"), F.lit("run").alias("stage"),
        E.run_command(F.lit("miri"), F.col("case_name")).alias("command"),
        F.expr("CAST(substr(case_name, 6) AS bigint)").alias("record_no"),
    )
    return E.union_records(ran, cases, missing)


_CASE_LOG_PATH = "concat('crates/', crate, '/logs/miri.', case_name, '.log')"


def statuses(spark, sf_dir):
    """(crate, kind, status) of all records of the study."""
    return crate_records(spark, sf_dir, with_artifacts=False).select("crate", "kind", "status")


def record_keys(spark, sf_dir):
    """What orders the records, of all runs and of all targets that may be missing."""
    keys = ["crate", "kind", "group_ord", "stage", "record_no"]
    runs = V.run_logs(spark, sf_dir).withColumnRenamed("run_id", "record_no")
    targets = V.planned_targets(spark, sf_dir).select(
        "crate", F.lit("fuzz").alias("kind"), "group_ord", F.lit("missing").alias("stage"), F.col("target").alias("record_no")
    )
    return runs.select(*keys).unionByName(targets)


def argv_display(spark, sf_dir):
    """Command lines of the runs."""
    return V.run_logs(spark, sf_dir).select(
        "run_id", E.run_command(F.col("kind"), F.col("name")).alias("command")
    )


def record_order(spark, sf_dir):
    """Positions of all records of the study; of fuzz groups missing targets, then builds, then runs."""
    records = crate_records(spark, sf_dir, with_artifacts=False).select("crate", "kind", "group_ord", "stage", "record_no")
    return E.record_positions(records, "record_no", record_keys(spark, sf_dir))


def phase_totals(spark, sf_dir):
    """Durations of interpreter cases: strict and baseline milliseconds."""
    return E.phase_totals(strict_baseline_verdict(spark, sf_dir))


def heterogeneous_records(spark, sf_dir):
    """Records of cases and of the runs of the other tools, which carry different evidence fields."""
    cases = strict_baseline_verdict(spark, sf_dir).select(
        "crate", F.lit("miri").alias("kind"), F.col("case_name").alias("name"),
        "status", "duration_ms", "summary", "verdict", "ub_category",
    )
    others = V.run_logs(spark, sf_dir).filter("kind <> 'miri'")
    return E.union_records(
        cases,
        E.phase_records(others, _crate_path()).select(
            "crate", "kind", "name", "status", "duration_ms", "summary", "target", "error_kind", "root_unsafe",
        ),
    )


def log_path_names(spark, sf_dir):
    runs = V.run_logs(spark, sf_dir)
    name = F.concat_ws(".", "name", F.concat_ws("/", F.col("crate"), F.col("run_id").cast("string")))
    return runs.select("run_id", T.log_path(F.concat(F.lit("w/"), F.col("crate")), F.col("kind"), name).alias("path"))


def log_excerpt(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def duration_label(spark, sf_dir):
    """Log durations, and the event number times 50 for every possible tie of tenths."""
    events = V.table(spark, sf_dir, "events")
    ms = F.expr("cast(round(value * 1000) AS bigint)")
    return events.select(
        "event_id",
        T.duration_label(ms).alias("label"),
        T.duration_label(F.col("event_id") * 50 % 130000).alias("tie_label"),
    )


def utf8_repair(spark, sf_dir):
    """Documents with one invalid byte put in after the first twenty characters."""
    documents = V.table(spark, sf_dir, "documents")
    broken = F.concat(
        F.encode(F.left("text", F.lit(20)), "utf-8"),
        F.unhex(F.lit("FF")),
        F.encode(F.substring(F.col("text"), F.lit(21), F.length("text")), "utf-8"),
    )
    return documents.select("doc_id", T.lossy_text(broken).alias("text"))


QUERIES = {
    "log_path": log_path_names,
    "log_has_ub": _per_log(_runs(), "has_ub", L.has_ub),
    "ub_category": _per_log(_runs("miri"), "ub_category", L.ub_category),
    "strict_baseline_verdict": strict_baseline_verdict,
    "fuzz_status": _per_log(_runs("fuzz"), "status", _fuzz_status),
    "fuzz_error_kind": _per_log(
        _runs("fuzz"), "error_kind", lambda marks: L.fuzz_error_kind(_fuzz_status(marks), marks)
    ),
    "budget_reached": _per_log(_runs("fuzz"), "reached", L.budget_reached),
    "fuzz_runs": _per_log(_runs("fuzz"), "runs", L.fuzz_runs),
    "fuzz_summary": _per_log(_runs("fuzz"), "summary", _fuzz_summary),
    "missing_bin": _per_log(_runs("fuzz"), "path", L.missing_source),
    "build_outcome": build_outcome,
    "package_tool_status": package_tool_status,
    "last_json_line": _per_log(_runs("geiger"), "report", L.last_report_line),
    "log_excerpt": log_excerpt,
    "duration_label": duration_label,
    "utf8_repair": utf8_repair,
    "phase_records": records,
    "crate_records": crate_records,
    "heterogeneous_records": heterogeneous_records,
    "phase_totals": phase_totals,
    "record_order": record_order,
    "argv_display": argv_display,
    "status_rollup": lambda spark, sf_dir: E.status_rollup(statuses(spark, sf_dir)),
}


# ---- oracles ----------------------------------------------------------------------------

O = "combined_output"
HAS_UB = contains_any(O, W.UB_MARKERS)


def ub_category_sql(expr: str) -> str:
    arms = " ".join(
        f"WHEN {contains_any(expr, words)} THEN {literal(label)}" for label, words in W.UB_CATEGORIES
    )
    return f"CASE {arms} WHEN {contains_any(expr, W.UB_MARKERS)} THEN {literal(W.UB_OTHER)} END"


LSAN = contains_all(O, W.LSAN_PTRACE_MARKERS)
REACHED = (
    f"(len(list_filter(list_transform(string_split({O}, chr(10)), lambda x: {trim('x')}), "
    "lambda x: starts_with(x, 'Done ') AND contains(substr(x, 6), ' runs in ') "
    "AND contains(substr(x, 6), ' second(s)'))) > 0)"
)
FUZZ_STATUS_SQL = f"""CASE WHEN success AND {REACHED} THEN 'pass' WHEN success THEN 'clean'
  WHEN {LSAN} THEN 'error' WHEN {contains_any(O, W.FUZZ_FINDING_MARKERS)} THEN 'finding' ELSE 'error' END"""
RUNS_SQL = f"""TRY_CAST(coalesce(
  nullif(regexp_extract({O}, '(^|[^0-9A-Za-z:])runs:[^0-9A-Za-z:]?([0-9]+)([^0-9A-Za-z:]|$)', 2), ''),
  nullif(regexp_extract({O}, '(^|\\n)Done ([0-9]+)', 2), '')) AS DECIMAL(20, 0))"""
MISSING_SQL = f"""CASE WHEN regexp_matches({O}, 'error: can''t find bin `[^`]*`(?s:.*?) at path `[^`]*`')
  THEN regexp_extract({O}, 'error: can''t find bin `[^`]*`(?s:.*?) at path `([^`]*)`', 1) END"""

FUZZ_CTE = f"""fuzz AS (SELECT *, {FUZZ_STATUS_SQL} AS status, {RUNS_SQL} AS runs, {LSAN} AS lsan
  FROM run_logs WHERE kind = 'fuzz')"""
BUDGET_SQL = "coalesce(budget, 60)"
BUILD_SQL = "(stage = 'build' AND NOT success)"
FUZZ_LABEL_SQL = f"""concat('target ', name, ', budget 60s, ',
  CASE WHEN runs IS NULL THEN '' ELSE concat(CAST(runs AS VARCHAR), ' runs, ') END,
  CASE WHEN status = 'pass' THEN 'pass (reached budget limit without findings)'
    WHEN status = 'error' AND lsan THEN 'environment error: LeakSanitizer unsupported under ptrace'
    ELSE status END)"""
FUZZ_SUMMARY_SQL = FUZZ_LABEL_SQL.replace("budget 60s, '", f"budget ', {BUDGET_SQL}, 's, '")
BUILD_SUMMARY_SQL = f"""concat('target ', name, ', budget ', {BUDGET_SQL}, 's, ', CASE WHEN path IS NULL THEN 'build error'
    ELSE concat('declared source missing at ', path) END)"""
ERROR_KIND_SQL = """CASE WHEN status = 'finding' THEN 'finding' WHEN status <> 'error' THEN NULL
  WHEN lsan THEN 'environment_error' ELSE 'tool_error' END"""

REPORT_SQL = f"""list_last(list_filter(list_transform(string_split({O}, chr(10)), lambda x: {trim('x')}),
  lambda x: CASE WHEN starts_with(x, '{{') AND contains(x, '"packages"') AND json_valid(x)
    THEN json_type(x, '$.packages') = 'ARRAY' ELSE false END))"""
ROOT_SQL = "CAST(json_extract(report, '$.packages[1].unsafety.used.exprs.unsafe_') AS BIGINT)"
DEP_SQL = "CAST(json_extract(report, '$.packages[0].unsafety.used.exprs.unsafe_') AS BIGINT)"
PANIC_SQL = " AND ".join(f"contains({O}, {literal(m)})" for m in W.COUNTER_PANIC_MARKERS)
COUNTER_CTE = f"""counter AS (SELECT *, {ROOT_SQL} AS root_unsafe, {DEP_SQL} AS dependency_unsafe,
  CASE WHEN success THEN 'clean' WHEN {PANIC_SQL} THEN 'skipped' ELSE 'error' END AS status
  FROM (SELECT *, {REPORT_SQL} AS report FROM run_logs WHERE kind = 'geiger'))"""
COUNTER_SUMMARY_SQL = """CASE WHEN root_unsafe IS NOT NULL
    THEN concat('root unsafe exprs ', CAST(root_unsafe AS VARCHAR), ', dependency unsafe exprs ', CAST(dependency_unsafe AS VARCHAR))
  WHEN status = 'skipped' THEN 'geiger tool failure, skipped' WHEN success THEN 'geiger completed' ELSE 'geiger failed' END"""

CASES_CTE = f"""cases AS (SELECT s.crate, s.case_name, s.scope, s.success, {contains_any('s.combined_output', W.UB_MARKERS)} AS strict_ub,
    {contains_any('b.combined_output', W.UB_MARKERS)} AS baseline_ub, b.case_name IS NOT NULL AS has_baseline,
    s.duration_ms AS strict_ms, b.duration_ms AS baseline_ms, s.combined_output AS strict_output, b.combined_output AS baseline_output
  FROM strict_runs s LEFT JOIN baseline_runs b ON b.crate = s.crate AND b.case_name = s.case_name),
triaged AS (SELECT *, strict_ub AND has_baseline AS used FROM cases),
judged_cases AS (SELECT *,
    CASE WHEN success AND NOT strict_ub THEN 'clean' WHEN strict_ub AND (NOT used OR baseline_ub) THEN 'ub_observed'
      WHEN strict_ub THEN 'strict_only_ub' ELSE 'failed_no_ub' END AS verdict,
    CASE WHEN used THEN concat(strict_output, chr(10), chr(10), '--- baseline ---', chr(10), baseline_output)
      ELSE strict_output END AS log
  FROM triaged),
case_records AS (SELECT crate, case_name, status, verdict,
    CASE WHEN status = 'finding' THEN {ub_category_sql('log')} END AS ub_category,
    strict_ms + CASE WHEN used THEN baseline_ms ELSE 0 END AS duration_ms,
    concat(scope, ' scope, verdict ', verdict) AS summary, {{excerpt}} AS excerpt
  FROM (SELECT *, CASE WHEN verdict = 'clean' THEN 'clean' WHEN verdict IN ('ub_observed', 'strict_only_ub')
    THEN 'finding' ELSE 'error' END AS status FROM judged_cases))"""


def excerpt_sql(expr: str) -> str:
    t = trim(expr)
    return (
        f"CASE WHEN {t} = '' THEN NULL WHEN strlen({t}) <= 700 THEN {t} "
        f"ELSE concat('...', right({t}, 700)) END"
    )


CASES_CTE = CASES_CTE.replace("{excerpt}", excerpt_sql("log"))
CASE_VIEWS = ["strict_runs", "baseline_runs"]

SAFE = "regexp_replace({}, '[^A-Za-z0-9_-]', '_', 'g')"


def log_path_sql(crate: str, kind: str, name: str) -> str:
    return f"concat('crates/', {SAFE.format(crate)}, '/logs/', {SAFE.format(kind)}, '.', {SAFE.format(name)}, '.log')"


_PLAN = "group_name, group_ord, stage, concat('cargo ', kind, CASE kind WHEN 'fuzz' THEN ' run ' ELSE ' test ' END, name) AS command"
RUN_RECORDS_CTE = f"""{FUZZ_CTE}, {COUNTER_CTE},
interpreter AS (SELECT *, {HAS_UB} AS ub,
    CASE WHEN success AND NOT {HAS_UB} THEN 'clean' WHEN {HAS_UB} THEN 'ub_observed' ELSE 'failed_no_ub' END AS verdict
  FROM run_logs WHERE kind = 'miri'),
builds AS (SELECT *, {MISSING_SQL} AS path FROM fuzz WHERE {BUILD_SQL}),
parts AS (
  SELECT run_id, crate, kind, name, status, duration_ms, {O}, {COUNTER_SUMMARY_SQL} AS summary, root_unsafe, dependency_unsafe,
    {_PLAN}, dir FROM counter
  UNION ALL BY NAME
  SELECT run_id, crate, kind, name, CASE verdict WHEN 'clean' THEN 'clean' WHEN 'ub_observed' THEN 'finding' ELSE 'error' END AS status,
    duration_ms, {O}, concat(scope, ' scope, verdict ', verdict) AS summary, verdict,
    CASE WHEN verdict = 'ub_observed' THEN {ub_category_sql(O)} END AS ub_category, {_PLAN}, dir FROM interpreter
  UNION ALL BY NAME
  SELECT run_id, crate, kind, name, status, duration_ms, {O}, {FUZZ_SUMMARY_SQL} AS summary,
    name AS target, CAST({BUDGET_SQL} AS BIGINT) AS budget_secs, {ERROR_KIND_SQL} AS error_kind, runs, {_PLAN}, dir
  FROM fuzz WHERE NOT {BUILD_SQL}
  UNION ALL BY NAME
  SELECT run_id, crate, kind, name, CASE WHEN path IS NULL THEN 'error' ELSE 'skipped' END AS status, duration_ms, {O},
    {BUILD_SUMMARY_SQL} AS summary, name AS target, CAST({BUDGET_SQL} AS BIGINT) AS budget_secs,
    CASE WHEN path IS NULL THEN 'tool_error' END AS error_kind, {_PLAN}, dir FROM builds),
run_records AS (SELECT run_id, crate, kind, name, status, duration_ms, {log_path_sql('crate', 'kind', 'name')} AS log_path,
    summary, CAST(root_unsafe AS BIGINT) AS root_unsafe, CAST(dependency_unsafe AS BIGINT) AS dependency_unsafe,
    CAST(verdict AS VARCHAR) AS verdict, CAST(ub_category AS VARCHAR) AS ub_category, CAST(target AS VARCHAR) AS target,
    CAST(budget_secs AS BIGINT) AS budget_secs, CAST(error_kind AS VARCHAR) AS error_kind,
    CAST(runs AS DECIMAL(20, 0)) AS runs, {excerpt_sql(O)} AS excerpt, group_name, CAST(group_ord AS INTEGER) AS group_ord,
    stage, command, dir FROM parts)"""

#: Views that the records of the whole study need.
RECORD_VIEWS = [
    "run_logs", "strict_runs", "baseline_runs", "configured_once", "discovered", "inventory_groups", "planned_groups",
    "artifacts_before", "artifacts_after",
]
RECORDS_CTE = f"""{RUN_RECORDS_CTE}, {CASES_CTE}, {inventory.CHANGED}, {', '.join(inventory.COLLAPSE_CTES).replace('FROM configured c', 'FROM configured_once c')},
newest AS (SELECT dir, path FROM changed QUALIFY row_number() OVER (PARTITION BY dir ORDER BY modified DESC, path DESC) = 1),
collapsed AS ({inventory.COLLAPSED}),
records AS (
  SELECT r.* EXCLUDE (run_id, dir), CASE WHEN kind = 'fuzz' AND stage = 'run' THEN path END AS artifact, run_id AS record_no
    FROM run_records r LEFT JOIN newest n ON n.dir = r.dir
  UNION ALL BY NAME
  SELECT crate, 'miri' AS kind, case_name AS name, status, duration_ms, {_CASE_LOG_PATH} AS log_path, summary, verdict, ub_category, excerpt,
    -1 AS group_ord, 'run' AS stage, concat('cargo miri test ', case_name) AS command, CAST(substr(case_name, 6) AS BIGINT) AS record_no
    FROM case_records
  UNION ALL BY NAME
  SELECT p.crate, 'fuzz' AS kind, coalesce(CAST(target AS VARCHAR), group_name) AS name, status, CAST(0 AS BIGINT) AS duration_ms, summary,
    CAST(target AS VARCHAR) AS target, CAST(coalesce(budget, 60) AS BIGINT) AS budget_secs, group_name, group_ord,
    'missing' AS stage, coalesce(target, 0) AS record_no FROM collapsed JOIN planned_groups p USING (group_id))"""
#: Order of the records of a crate in its report.
RECORD_ORDER_SQL = """list_position(['geiger', 'miri', 'fuzz'], kind), group_ord, list_position(['missing', 'build', 'run'], stage), record_no"""

SEVERITY_SQL = "CASE status " + " ".join(
    f"WHEN {literal(s)} THEN {i}" for i, s in enumerate(W.STATUS_BY_SEVERITY, 1)
) + " END"


def _fuzz(body: str) -> str:
    return with_views(["run_logs"], body, FUZZ_CTE)


ORACLES = {
    "log_path": with_views(
        ["run_logs"],
        "SELECT run_id, "
        + log_path_sql("concat('w/', crate)", "kind", "concat(name, '.', crate, '/', CAST(run_id AS VARCHAR))")
        + " AS path FROM run_logs",
    ),
    "log_has_ub": with_views(["run_logs"], f"SELECT run_id, {HAS_UB} AS has_ub FROM run_logs"),
    "ub_category": with_views(
        ["run_logs"], f"SELECT run_id, {ub_category_sql(O)} AS ub_category FROM run_logs WHERE kind = 'miri'"
    ),
    "strict_baseline_verdict": with_views(CASE_VIEWS, "SELECT * FROM case_records", CASES_CTE),
    "fuzz_status": _fuzz("SELECT run_id, status FROM fuzz"),
    "fuzz_error_kind": _fuzz(f"SELECT run_id, {ERROR_KIND_SQL} AS error_kind FROM fuzz"),
    "budget_reached": _fuzz(f"SELECT run_id, {REACHED} AS reached FROM fuzz"),
    "fuzz_runs": _fuzz("SELECT run_id, runs FROM fuzz"),
    "fuzz_summary": _fuzz(f"SELECT run_id, {FUZZ_LABEL_SQL} AS summary FROM fuzz"),
    "missing_bin": _fuzz(f"SELECT run_id, {MISSING_SQL} AS path FROM fuzz"),
    "build_outcome": _fuzz(
        f"""SELECT run_id, CASE WHEN path IS NULL THEN 'error' ELSE 'skipped' END AS status,
  CASE WHEN path IS NULL THEN 'tool_error' END AS error_kind, {BUILD_SUMMARY_SQL} AS summary,
  CASE WHEN {trim(O)} = '' THEN concat('cargo fuzz build failed for ', name) ELSE {O} END AS detail
FROM (SELECT *, {MISSING_SQL} AS path FROM fuzz WHERE {BUILD_SQL})"""
    ),
    "package_tool_status": with_views(
        ["run_logs"],
        f"SELECT run_id, status, {COUNTER_SUMMARY_SQL} AS summary, root_unsafe, dependency_unsafe FROM counter",
        COUNTER_CTE,
    ),
    "last_json_line": with_views(
        ["run_logs"], f"SELECT run_id, {REPORT_SQL} AS report FROM run_logs WHERE kind = 'geiger'"
    ),
    "log_excerpt": f"SELECT doc_id, {excerpt_sql('text')} AS excerpt FROM documents",
    "duration_label": """WITH t AS (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS a, event_id * 50 % 130000 AS b FROM events)
SELECT event_id, {a} AS label, {b} AS tie_label FROM t""".format(
        **{
            c: f"""CASE WHEN {c} < 1000 THEN concat(CAST({c} AS VARCHAR), 'ms')
  WHEN {c} < 60000 THEN printf('%.1fs', {c} / 1000.0::DOUBLE)
  ELSE printf('%dm%02ds', {c} // 60000, {c} // 1000 % 60) END"""
            for c in "ab"
        }
    ),
    "utf8_repair": "SELECT doc_id, concat(text[:20], chr(65533), text[21:]) AS text FROM documents",
    "phase_records": with_views(
        ["run_logs"], "SELECT *, CAST(NULL AS VARCHAR) AS artifact FROM run_records", RUN_RECORDS_CTE
    ),
    "crate_records": with_views(RECORD_VIEWS, "SELECT * FROM records", RECORDS_CTE),
    "heterogeneous_records": with_views(
        ["run_logs", *CASE_VIEWS],
        f"""SELECT crate, 'miri' AS kind, case_name AS name, status, duration_ms, summary, verdict, ub_category,
  CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS BIGINT) AS root_unsafe FROM case_records
UNION ALL SELECT crate, kind, name, status, duration_ms, summary, NULL, NULL, target, error_kind, NULL FROM run_records WHERE kind = 'fuzz'
UNION ALL SELECT crate, kind, name, status, duration_ms, {COUNTER_SUMMARY_SQL}, NULL, NULL, NULL, NULL, root_unsafe FROM counter""",
        CASES_CTE,
        RUN_RECORDS_CTE,
    ),
    "phase_totals": with_views(
        CASE_VIEWS,
        """SELECT crate, count(*) AS records, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM case_records GROUP BY crate""",
        CASES_CTE,
    ),
    "record_order": with_views(
        RECORD_VIEWS,
        f"""SELECT crate, kind, group_ord, stage, record_no,
  row_number() OVER (PARTITION BY crate ORDER BY {RECORD_ORDER_SQL}) AS position FROM records""",
        RECORDS_CTE,
    ),
    "argv_display": with_views(
        ["run_logs"],
        """SELECT run_id, concat('cargo ', kind, CASE kind WHEN 'fuzz' THEN ' run ' ELSE ' test ' END, name) AS command
FROM run_logs""",
    ),
    "status_rollup": with_views(
        RECORD_VIEWS,
        f"SELECT crate, kind, arg_max(status, {SEVERITY_SQL}) AS status FROM records GROUP BY crate, kind",
        RECORDS_CTE,
    ),
}
