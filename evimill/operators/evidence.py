"""Phase records from tool logs, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimill.functions import logs as L
from evimill.functions.text import argv_text, excerpt, log_path
from evimill.functions.vocabulary import DEFAULT_BUDGET_SECONDS, PHASE_KINDS
from evimill.operators.numbering import by_slot, with_offset
from evimill.operators.skew import spread

CASE_KEY = ["crate", "case_name"]

# Kinds of records that give evidence, in report order.
EVIDENCE_KINDS = ["geiger", "miri", "fuzz"]

# Columns of a phase record; which of the evidence fields are set depends on its kind.
RECORD_COLUMNS = [
    "crate", "kind", "name", "status", "duration_ms", "log_path", "summary",
    "root_unsafe", "dependency_unsafe", "verdict", "ub_category",
    "target", "budget_secs", "artifact", "error_kind", "runs", "excerpt",
    "group_name", "group_ord", "stage", "command",
]


def case_records(strict: DataFrame, baseline: DataFrame, triage: bool = True) -> DataFrame:
    """One record per interpreter case.

    The baseline run of a case counts only if triage is on and the strict run shows
    undefined behaviour, so only those cases take part in the join; logs of the others
    are classified where they are. A run without a log shows nothing. Of several baseline
    runs of a case one that shows undefined behaviour is taken before one that does not,
    then the shortest, then the first by its log.
    """
    shows_ub = F.coalesce(L.text_has_ub(F.col("combined_output")), F.lit(False))
    none = {
        "baseline_output": F.lit(None).cast("string"),
        "baseline_ms": F.lit(None).cast("bigint"),
        "baseline_ub": F.lit(None).cast("boolean"),
    }
    if triage:
        preferred = Window.partitionBy(*CASE_KEY).orderBy(
            shows_ub.desc(), F.col("duration_ms").asc_nulls_last(), "combined_output"
        )
        runs = (
            spread(baseline, CASE_KEY)
            .withColumn("_nth", F.row_number().over(preferred))
            .filter("_nth = 1")
            .select(
                *CASE_KEY,
                F.col("combined_output").alias("baseline_output"),
                F.col("duration_ms").alias("baseline_ms"),
                shows_ub.alias("baseline_ub"),
            )
        )
        with_ub = strict.filter(shows_ub).withColumn("strict_ub", F.lit(True))
        without = strict.filter(~shows_ub).withColumn("strict_ub", F.lit(False)).withColumns(none)
        cases = with_ub.join(runs, CASE_KEY, "left").unionByName(without)
    else:
        cases = strict.withColumn("strict_ub", shows_ub).withColumns(none)

    verdict = L.interpreter_verdict(F.col("success"), F.col("strict_ub"), F.col("baseline_ub"))
    log = L.combined_log(F.col("combined_output"), F.col("baseline_output"))
    return (
        cases.withColumn("verdict", verdict)
        .withColumn("log", log)
        .withColumn("status", L.verdict_status(F.col("verdict")))
        # searched once a finding, not once a category
        .withColumn("_marks", F.when(F.col("status") == "finding", L.marks(F.col("log"))))
        .select(
            *CASE_KEY,
            "status",
            "verdict",
            L.ub_category(F.col("_marks")).alias("ub_category"),
            (F.col("duration_ms") + F.coalesce(F.col("baseline_ms"), F.lit(0))).alias("duration_ms"),
            F.concat(F.col("scope"), F.lit(" scope, verdict "), F.col("verdict")).alias("summary"),
            excerpt(F.col("log")).alias("excerpt"),
        )
    )


# What a table of runs may say about them besides, with its meaning where it does not.
RUN_DEFAULTS = {
    "stage": ("string", "run"),
    "group_name": ("string", None),
    "group_ord": ("int", None),
    "budget": ("bigint", None),
    "scope": ("string", "full_suite"),
    "artifact": ("string", None),
}


def _given(runs: DataFrame, name: str) -> Column:
    kind, default = RUN_DEFAULTS[name]
    return F.col(name) if name in runs.columns else F.lit(default).cast(kind)


def _failed_build(runs: DataFrame) -> Column:
    failed = (F.col("kind") == "fuzz") & (_given(runs, "stage") == "build") & ~F.col("success")
    return F.coalesce(failed, F.lit(False))


def run_command(kind: Column, name: Column) -> Column:
    """Command line of a run: program, arguments of the tool, then the target."""
    verb = F.when(kind == "fuzz", F.lit("run")).otherwise(F.lit("test"))
    return argv_text(F.lit("cargo"), F.array(kind, verb, name))


def phase_records(runs: DataFrame, crate_path: Column, budget: Column | None = None) -> DataFrame:
    """Records of a table that holds the runs of all tools, classified in one pass.

    ``runs`` is (crate, kind, name, success, duration_ms, combined_output) and any of
    RUN_DEFAULTS: a fuzz log of stage ``build`` tells how building the target ended, ``budget``
    goes before the argument of that name. Interpreter runs are taken as strict runs without a
    baseline. A null log is an empty one. Other columns are carried along.
    """
    text, success, kind = F.coalesce("combined_output", F.lit("")), F.col("success"), F.col("kind")
    fallback = F.lit(DEFAULT_BUDGET_SECONDS).cast("bigint") if budget is None else budget
    budget = F.coalesce(_given(runs, "budget"), fallback)
    is_counter, is_interpreter, is_fuzzer = kind == "geiger", kind == "miri", kind == "fuzz"
    failed_build = _failed_build(runs)
    extra = [c for c in runs.columns if c not in {*RECORD_COLUMNS, *RUN_DEFAULTS, "success", "combined_output"}]

    no_baseline = F.lit(None).cast("boolean")
    marks = F.col("_marks")
    counted = runs.withColumn("_marks", L.marks(text)).withColumns(
        {
            "_report": F.when(is_counter, L.last_report(marks)["report"]),
            "verdict": F.when(
                is_interpreter, L.interpreter_verdict(success, L.has_ub(marks), no_baseline)
            ),
            "runs": F.when(is_fuzzer & ~failed_build, L.fuzz_runs(marks)),
            "status": L.run_status(kind, success, marks, failed_build),
            "_build": F.when(failed_build, L.build_failure(F.col("name"), budget, text, marks)),
        }
    ).withColumn("_counts", L.package_counts(F.col("_report"), F.col("crate"), crate_path))
    status = F.col("status")
    summary = (
        F.when(failed_build, F.col("_build.summary"))
        .when(
            is_counter,
            L.counter_summary(status, success, F.col("_counts.root_unsafe"), F.col("_counts.dependency_unsafe")),
        )
        .when(is_interpreter, F.concat(_given(runs, "scope"), F.lit(" scope, verdict "), F.col("verdict")))
        .when(is_fuzzer, L.fuzz_summary(F.col("name"), budget, status, F.col("runs"), marks))
    )
    columns = {
        "log_path": log_path(F.col("crate"), kind, F.col("name")),
        "summary": summary,
        "root_unsafe": F.col("_counts.root_unsafe"),
        "dependency_unsafe": F.col("_counts.dependency_unsafe"),
        "ub_category": F.when(is_interpreter & (status == "finding"), L.ub_category(marks)),
        "target": F.when(is_fuzzer, F.col("name")),
        "budget_secs": F.when(is_fuzzer, budget),
        "artifact": F.when(is_fuzzer & ~failed_build, _given(runs, "artifact")),
        "error_kind": F.when(failed_build, F.col("_build.error_kind")).when(
            is_fuzzer, L.fuzz_error_kind(status, marks)
        ),
        "excerpt": excerpt(F.coalesce("_build.detail", text)),
        "group_name": _given(runs, "group_name"),
        "group_ord": _given(runs, "group_ord"),
        "stage": _given(runs, "stage"),
        "command": run_command(kind, F.col("name")),
    }
    return counted.select(
        *extra, *[columns[c].alias(c) if c in columns else F.col(c) for c in RECORD_COLUMNS]
    )


def missing_records(skipped: DataFrame, plan: DataFrame) -> DataFrame:
    """Records of targets that could not be run.

    ``skipped`` is what :func:`evimill.operators.inventory.group_collapse` returns, ``plan``
    the groups: (group_id, crate, group_name, group_ord, budget). A group without any target is
    one record under its own name.
    """
    target = F.col("target").cast("string")
    return skipped.join(plan, "group_id").select(
        "crate",
        F.lit("fuzz").alias("kind"),
        F.coalesce(target, F.col("group_name")).alias("name"),
        "status",
        F.lit(0).cast("bigint").alias("duration_ms"),
        "summary",
        target.alias("target"),
        F.coalesce(F.col("budget"), F.lit(DEFAULT_BUDGET_SECONDS)).cast("bigint").alias("budget_secs"),
        "group_name",
        "group_ord",
        F.lit("missing").alias("stage"),
    )


def run_statuses(runs: DataFrame) -> DataFrame:
    """(crate, kind, status) alone, for the roll-ups that need no more of a record."""
    marked = runs.withColumn("_marks", L.marks(F.coalesce("combined_output", F.lit(""))))
    status = L.run_status(F.col("kind"), F.col("success"), F.col("_marks"), _failed_build(runs))
    return marked.select("crate", "kind", status.alias("status"))


# Stages of the records of a fuzz group, in report order.
GROUP_STAGES = ["missing", "build", "run"]


def _ordered(records: DataFrame) -> DataFrame:
    kinds, stages = (F.array(*[F.lit(v) for v in values]) for values in (PHASE_KINDS, GROUP_STAGES))
    return records.withColumns(
        {
            "_kind": F.array_position(kinds, F.col("kind")),
            "_stage": F.array_position(stages, F.col("stage")),
        }
    )


def record_positions(records: DataFrame, target_order: str, drawn_from: DataFrame | None = None) -> DataFrame:
    """Records with their 1-based position in the report of their crate.

    Kinds come in report order, then groups by ``group_ord``, their place in the plan, then the
    stages of a group, then ``target_order``, which must be unique within all that. For
    ``drawn_from`` see :func:`with_offset`.
    """
    keys = None if drawn_from is None else _ordered(drawn_from)
    order = ["_kind", "group_ord", "_stage", target_order]
    placed = with_offset(_ordered(records), "crate", order, F.lit(1), "position", drawn_from=keys)
    return placed.withColumn("position", F.col("position") + 1).drop("_kind", "_stage")


def union_records(*parts: DataFrame) -> DataFrame:
    """Records of several sources; evidence fields a source does not know are null."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


# ---- roll-ups: one partial and one final aggregation each ---------------------------------


def status_rollup(records: DataFrame) -> DataFrame:
    """Worst status per crate and kind."""
    worst = records.groupBy("crate", "kind").agg(F.max(L.severity(F.col("status"))).alias("worst"))
    return worst.select("crate", "kind", L.status_of(F.col("worst")).alias("status"))


def status_columns(records: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per crate with the worst status of each kind, ``-`` without records."""
    rank = L.severity(F.col("status"))
    worst = records.groupBy("crate").agg(
        *[F.max(F.when(F.col("kind") == kind, rank)).alias(kind) for kind in kinds]
    )
    return worst.select("crate", *[L.status_of(F.col(kind)).alias(kind) for kind in kinds])


def status_columns_of_slots(placed: DataFrame, of_kind: dict[str, Column], severity: Column) -> DataFrame:
    """The same for records with ``_slot``, out of a shuffle that numbers them as well."""
    worst = by_slot(placed, "crate", *[F.max(F.when(test, severity)).alias(kind) for kind, test in of_kind.items()])
    worst = worst.groupBy("crate").agg(*[F.max(kind).alias(kind) for kind in of_kind])
    return worst.select("crate", *[L.status_of(F.col(kind)).alias(kind) for kind in of_kind])


def finding_flags(records: DataFrame | None, statuses: DataFrame | None = None) -> DataFrame:
    """(crate, dynamic_finding): some record of the crate is a finding or an error.

    Only these two are the worst of a kind, so the flag follows from the roll-up, which a report
    needs anyway: both come from one shuffle.
    """
    worst = statuses or status_columns(records, EVIDENCE_KINDS)
    return worst.select(
        "crate", F.greatest(*[L.is_dynamic_finding(F.col(kind)) for kind in EVIDENCE_KINDS]).alias("dynamic_finding")
    )


def phase_totals(records: DataFrame) -> DataFrame:
    """Number of records and milliseconds per crate."""
    return records.groupBy("crate").agg(
        F.count(F.lit(1)).alias("records"), F.sum("duration_ms").alias("duration_ms")
    )


# ---- package metrics --------------------------------------------------------------------


def _firsts(crate: Column, crate_path: Column) -> list[Column]:
    """Position where the package is a root of tier 1, and of tier 2; else null."""
    tier = L.package_tier(F.col("name"), F.col("source_path"), crate, crate_path)
    return [F.when(tier == n, F.col("pos")) for n in (1, 2)]


def package_root(packages: DataFrame, crate: Column, crate_path: Column) -> DataFrame:
    """Position of the root package per report: best tier, then first; reports without one drop out."""
    exact, by_name = _firsts(crate, crate_path)
    best = packages.groupBy("report_id").agg(F.min(exact).alias("exact"), F.min(by_name).alias("by_name"))
    return best.filter("exact IS NOT NULL OR by_name IS NOT NULL").select(
        "report_id",
        F.coalesce("exact", "by_name").alias("pos"),
        F.when(F.col("exact").isNotNull(), F.lit(1)).otherwise(F.lit(2)).alias("tier"),
    )


def package_metrics(packages: DataFrame, crate: Column, crate_path: Column) -> DataFrame:
    """Count of the root package and of all others, null in reports without a root.

    The others are the total less the root, so one aggregation does for both.
    """
    exact, by_name = _firsts(crate, crate_path)
    sums = packages.groupBy("report_id").agg(
        F.count(exact).alias("n_exact"),
        F.min_by("unsafe_exprs", exact).alias("exact"),
        F.min_by("unsafe_exprs", by_name).alias("by_name"),
        F.sum("unsafe_exprs").alias("total"),
    )
    root = F.when(F.col("n_exact") > 0, F.col("exact")).otherwise(F.col("by_name"))
    return sums.select("report_id", root.alias("root_unsafe"), (F.col("total") - root).alias("dependency_unsafe"))
