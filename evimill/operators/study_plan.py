"""From a nested study description to the tables a run is planned from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.functions.text import env_overlay
from evimill.functions.vocabulary import DEFAULT_BUDGET_SECONDS, PHASE_KINDS, PROFILE_CAPS
from evimill.operators.inventory import harness_attach
from evimill.operators.numbering import with_offset
from evimill.operators.rows import explode_once
from evimill.operators.skew import lookup_keys

FORMATS = ["json", "markdown"]


@dataclass(frozen=True)
class RunSettings:
    """Settings of a run, as a report states them."""

    study_name: str = "study"
    profile: str = "full"
    jobs: int = 1
    fuzz_jobs: int = 1
    phases: tuple[str, ...] = tuple(PHASE_KINDS)
    miri_triage: bool = False
    fuzz_time: int | None = None
    fuzz_env: dict[str, str] = field(default_factory=dict)

    def as_document(self) -> dict:
        return {
            "schema_version": 1,
            "study_name": self.study_name,
            "execution": {
                "profile": self.profile,
                "jobs": max(self.jobs, 1),
                "fuzz_jobs": max(self.fuzz_jobs, 1),
                "phases": {kind: kind in self.phases for kind in PHASE_KINDS},
                "miri_triage": self.miri_triage,
                "fuzz_time": self.fuzz_time,
                "fuzz_env": dict(sorted(self.fuzz_env.items())),
            },
        }


# Fixed values of an entry added by default.
DEFAULT_CASE = {"name": "upstream_full", "scope": "full_suite"}
DEFAULT_GROUP = {"name": "existing_targets", "take_all": True, "budget_label": "default"}
HARNESS_GROUP = {"name": "harness_targets", "take_all": True, "budget_label": "harness"}
SINGLE_CRATE_LABEL = "single_crate"
SINGLE_CRATE_ENV = {"ASAN_OPTIONS": "detect_leaks=0"}


def study_cases(crates: DataFrame) -> DataFrame:
    """Interpreter cases of a nested study, one row each, defaults filled in."""
    return (
        explode_once(crates, [F.col("name").alias("crate")], F.col("miri_case"), "ordinal", "c")
        .select(
            "crate",
            "ordinal",
            F.col("c.name").alias("name"),
            F.coalesce("c.scope", F.lit("unspecified")).alias("scope"),
            "c.harness_dir",
            "c.test",
            F.col("c.case").alias("case_filter"),
            F.coalesce("c.exact", F.lit(False)).alias("exact"),
            "c.env",
        )
    )


def study_groups(crates: DataFrame) -> DataFrame:
    """Fuzz groups of a nested study, one row each, defaults filled in."""
    return (
        explode_once(crates, [F.col("name").alias("crate")], F.col("fuzz_group"), "ordinal", "g")
        .select(
            "crate",
            "ordinal",
            F.col("g.name").alias("name"),
            "g.harness_dir",
            F.coalesce("g.all", F.lit(False)).alias("take_all"),
            F.coalesce("g.targets", F.array().cast("array<string>")).alias("targets"),
            F.col("g.time").alias("time_s"),
            "g.budget_label",
            "g.env",
        )
    )


def study_entries(crates: DataFrame) -> DataFrame:
    """Cases and groups in one table of their common columns, the study read once.

    Crates without any entry stay, with a null entry.
    """
    cases = F.transform(
        "miri_case",
        lambda c, i: F.struct(
            F.lit("case").alias("entry"), i.alias("ordinal"), c["name"].alias("name"),
            c["harness_dir"].alias("harness_dir"),
        ),
    )
    groups = F.transform(
        "fuzz_group",
        lambda g, i: F.struct(
            F.lit("group").alias("entry"), i.alias("ordinal"), g["name"].alias("name"),
            g["harness_dir"].alias("harness_dir"),
        ),
    )
    none = F.array().cast("array<struct<entry:string,ordinal:int,name:string,harness_dir:string>>")
    entries = F.concat(F.coalesce(cases, none), F.coalesce(groups, none))
    return crates.select(
        F.col("name").alias("crate"), "cohort", F.explode_outer(entries).alias("e")
    ).select("crate", "cohort", "e.*")


def group_targets(groups: DataFrame) -> DataFrame:
    """Configured targets of groups, in configured order."""
    keep = ["crate", F.col("name").alias("group_name")]
    return explode_once(groups, keep, F.col("targets"), "ordinal", "target")


def select_phases(records: DataFrame, phases: list[str]) -> DataFrame:
    return records.filter(F.col("kind").isin(phases))


def site_count_label(scan_selected: bool, count: Column) -> Column:
    """A skipped scan has no count, which is not the same as a count of 0."""
    return count.cast("string") if scan_selected else F.lit("-")


def phase_label(phases: list[str]) -> str:
    """Selected phases for display, in report order."""
    return ", ".join(kind for kind in PHASE_KINDS if kind in phases) or "-"


def select_crates(df: DataFrame, names: DataFrame | list[str], column: str = "crate") -> DataFrame:
    """Rows of the named crates; names that do not occur are ignored.

    A list is a filter that reaches the scan, a DataFrame is a semi join.
    """
    if isinstance(names, DataFrame):
        wanted = lookup_keys(names.select(F.col(names.columns[0]).alias(column)), [column])
        return df.join(wanted, column, "left_semi")
    return df.filter(F.col(column).isin(names))


def require_crates(crates: DataFrame) -> DataFrame:
    """The same crates, or an error when there are none."""
    if crates.isEmpty():
        raise ValueError("study manifest selected no crates")
    return crates


def capped_budget(seconds: Column, profile: str) -> Column:
    """Seconds within the cap of a profile; without a value the cap, if there is one."""
    cap = PROFILE_CAPS.get(profile)
    if cap is None:
        return seconds
    return F.least(F.coalesce(seconds, F.lit(cap).cast("bigint")), F.lit(cap).cast("bigint"))


def effective_budget(group: Column, cli: Column, study: Column, profile: str) -> Column:
    """Seconds of one target: group before command line before study, capped, else the fallback."""
    chosen = F.coalesce(group, capped_budget(F.coalesce(cli, study), profile))
    return F.coalesce(capped_budget(chosen, profile), F.lit(DEFAULT_BUDGET_SECONDS).cast("bigint"))


def job_count(jobs: Column) -> Column:
    return F.greatest(jobs, F.lit(1))


def inject_defaults(
    crates: DataFrame, entries: DataFrame, default: dict, workspace: Column | None = None
) -> DataFrame:
    """Entries and, per crate without a built-in one, the default entry.

    ``entries`` is (crate_id, name, harness_dir, ..); built-in means no harness directory.
    A crate with harness entries only gets the default where ``workspace`` holds (always, if
    not given), a crate with no entries at all gets it in any case. Which crates lack one is
    known from counts per crate, so entries take no part in the join.
    """
    built_in = F.count_if(F.col("harness_dir").isNull()).alias("built_in")
    per_crate = entries.groupBy("crate_id").agg(built_in, F.count(F.lit(1)).alias("n"))
    workspace = F.lit(True) if workspace is None else workspace
    lacking = crates.join(per_crate, "crate_id", "left").filter(
        F.col("n").isNull() | ((F.col("built_in") == 0) & workspace)
    )
    added = lacking.select(
        "crate_id", *[F.lit(v).alias(c) for c, v in default.items()], F.lit(True).alias("injected")
    )
    return entries.withColumn("injected", F.lit(False)).unionByName(added, allowMissingColumns=True)


def attach_harness_groups(crates: DataFrame, groups: DataFrame, harnesses: DataFrame) -> DataFrame:
    """Groups, and one of all targets for each crate that has a harness directory but no harness group.

    ``crates`` is (crate_id, name), ``harnesses`` (name, path), names compared as package names.
    """
    with_harness = groups.filter("harness_dir IS NOT NULL").select("crate_id").distinct()
    lacking = crates.join(with_harness, "crate_id", "left_anti").select("crate_id", "name")
    added = (
        harness_attach(lacking, harnesses)
        .filter("harness_dir IS NOT NULL")
        .select("crate_id", "harness_dir", *[F.lit(v).alias(c) for c, v in HARNESS_GROUP.items()])
    )
    return groups.unionByName(added, allowMissingColumns=True)


def single_crate_entries(crates: DataFrame, seconds: Column, env: Column) -> tuple[DataFrame, DataFrame]:
    """Cases and groups of crates that come without a study: one of each.

    ``env`` lies over the built-in setting of such groups, as it does everywhere else.
    """
    cases = crates.select("crate_id", *[F.lit(v).alias(c) for c, v in DEFAULT_CASE.items()])
    built_in = F.create_map(*[F.lit(part) for pair in SINGLE_CRATE_ENV.items() for part in pair])
    group = {**DEFAULT_GROUP, "budget_label": SINGLE_CRATE_LABEL}
    groups = crates.select(
        "crate_id",
        *[F.lit(v).alias(c) for c, v in group.items()],
        seconds.alias("time_s"),
        env_overlay(built_in, env).alias("env"),
    )
    return cases, groups


def plan_order(entries: DataFrame) -> DataFrame:
    """Entries with their 1-based position in the plan of their crate.

    Built-in entries come before those with a harness, otherwise the order of ``ordinal``
    stays. ``entries`` is (crate_id, ordinal, harness_dir, ..).
    """
    staged = entries.withColumn("stage", F.col("harness_dir").isNotNull().cast("int"))
    placed = with_offset(staged, "crate_id", ["stage", "ordinal"], F.lit(1), "position")
    return placed.withColumn("position", F.col("position") + 1)
