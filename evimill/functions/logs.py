"""Classification of tool logs.

A log is searched once: ``marks`` finds everything any classifier looks for, in one alternation, and
the classifiers work on that short array. What they call ``marks`` below is its result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimill.functions.text import (
    STRICT_JSON,
    file_url_path,
    json_valid,
    trim_space,
)
from evimill.functions.vocabulary import (
    BASELINE_SEPARATOR,
    COUNTER_PANIC_MARKERS,
    FUZZ_FINDING_MARKERS,
    LSAN_PTRACE_MARKERS,
    STATUS_BY_SEVERITY,
    UB_CATEGORIES,
    UB_MARKERS,
    UB_OTHER,
    WHITESPACE,
)

RUNS_TYPE = "decimal(20,0)"
LARGEST_RUNS = "18446744073709551615"

PACKAGE_REPORT_SCHEMA = (
    "packages array<struct<"
    "package:struct<id:struct<name:string,source:struct<Path:string>>>,"
    "unsafety:struct<used:struct<exprs:struct<unsafe_:bigint>>>>>"
)


# ---- the search -------------------------------------------------------------------------

_FOLDED = list(
    dict.fromkeys([*UB_MARKERS, *(m for _, words in UB_CATEGORIES for m in words), *FUZZ_FINDING_MARKERS, *LSAN_PTRACE_MARKERS])
)
def _by_first_letter(words: list[str]) -> str:
    """The words as alternatives, those that begin alike tried together."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in tails.items())


_FIELD = "0-9A-Za-z:"
_INDENT = WHITESPACE.replace("\n", "")
#: What marks can be: a word of any case, a word of this case, a line that reads ``Done`` or holds an
#: object, a field of runs with the token behind it, a message about a missing source. No alternative
#: begins like another one, so at most one fits any place.
_ALTERNATIVES = [
    f"(?i:{_by_first_letter(_FOLDED)})",
    *map(re.escape, COUNTER_PANIC_MARKERS),
    rf"(?:^|(?<=\n))[{_INDENT}]*+(?:Done |\{{)[^\n]*+",
    rf"(?<![{_FIELD}])runs:[{_FIELD}]*+(?:[^{_FIELD}][{_FIELD}]*+)?+",
    r"error: can't find bin `[^`]*+`[\s\S]*? at path `[^`]*+`",
]
_FIRST = "".join(sorted({c for m in _FOLDED for c in (m[0], m[0].upper())} | {m[0] for m in COUNTER_PANIC_MARKERS} | set("D{re")))
#: Every other ASCII sign, one by one: single signs are looked up in a table, while a class with many
#: parts beyond ASCII is tried part by part, which only signs beyond ASCII have to go through.
_NEVER_FIRST = "".join(rf"\x{{{code:x}}}" for code in range(128) if chr(code) not in _FIRST + _INDENT)
#: Matches are empty, so one may lie within another; what was seen is the group.
_MARKS = rf"(?![{_NEVER_FIRST}])(?=[\x00-\x7f]|[{_INDENT}])(?=({'|'.join(_ALTERNATIVES)}))"
_LONGEST = max(map(len, _FOLDED))


def marks(text: Column) -> Column:
    """What the classifiers look for, in text order, found in one search of the text."""
    return F.regexp_extract_all(text, F.lit(_MARKS), F.lit(1))


def _any_of(marks: Column, words: list[str]) -> Column:
    """Whether one of the words is among the marks, ignoring the case of ASCII letters only.

    A mark that is a word is all ASCII, and no other mark begins like a word, so any lower case will do.
    """
    return F.exists(marks, lambda m: (F.octet_length(m) <= _LONGEST) & F.lower(m).isin(words))


def _all_of(marks: Column, words: list[str]) -> Column:
    test = F.lit(True)
    for word in words:
        test = test & _any_of(marks, [word])
    return test


# ---- statuses ---------------------------------------------------------------------------


def severity(status: Column) -> Column:
    """1 (skipped) to 5 (finding)."""
    ladder = F.lit(None).cast("int")
    for rank, label in enumerate(STATUS_BY_SEVERITY, start=1):
        ladder = F.when(status == label, F.lit(rank)).otherwise(ladder)
    return ladder


def status_of(severity_rank: Column) -> Column:
    """Inverse of :func:`severity`; ``-`` where there is no record."""
    labels = F.array(*[F.lit(label) for label in STATUS_BY_SEVERITY])
    return F.coalesce(F.try_element_at(labels, severity_rank), F.lit("-"))


def is_dynamic_finding(status: Column) -> Column:
    """Errors count as findings here: both call for a look at the crate."""
    return status.isin("finding", "error")


# ---- interpreter ------------------------------------------------------------------------


def has_ub(marks: Column) -> Column:
    return _any_of(marks, UB_MARKERS)


_UB_FIRST = "".join(sorted({c for m in UB_MARKERS for c in (m[0], m[0].upper())}))


def text_has_ub(text: Column) -> Column:
    """The same from the log itself, where nothing else is looked for: the search ends at the first marker."""
    return text.rlike(rf"(?=[{_UB_FIRST}])(?i:" + "|".join(map(re.escape, UB_MARKERS)) + ")")


def ub_category(marks: Column) -> Column:
    ladder = F.when(_any_of(marks, UB_CATEGORIES[0][1]), F.lit(UB_CATEGORIES[0][0]))
    for label, words in UB_CATEGORIES[1:]:
        ladder = ladder.when(_any_of(marks, words), F.lit(label))
    return ladder.when(has_ub(marks), F.lit(UB_OTHER))


def interpreter_verdict(success: Column, strict_ub: Column, baseline_ub: Column) -> Column:
    """Verdict of a strict run; ``baseline_ub`` is null when there was no baseline run."""
    return (
        F.when(success & ~strict_ub, F.lit("clean"))
        .when(strict_ub & F.coalesce(baseline_ub, F.lit(True)), F.lit("ub_observed"))
        .when(strict_ub, F.lit("strict_only_ub"))
        .otherwise(F.lit("failed_no_ub"))
    )


def verdict_status(verdict: Column) -> Column:
    return (
        F.when(verdict == "clean", F.lit("clean"))
        .when(verdict.isin("ub_observed", "strict_only_ub"), F.lit("finding"))
        .otherwise(F.lit("error"))
    )


def combined_log(strict: Column, baseline: Column) -> Column:
    return F.concat(strict, F.coalesce(F.concat(F.lit(BASELINE_SEPARATOR), baseline), F.lit("")))


# ---- fuzzer -----------------------------------------------------------------------------


def is_environment_failure(marks: Column) -> Column:
    return _all_of(marks, LSAN_PTRACE_MARKERS)


def budget_reached(marks: Column) -> Column:
    """Some line, trimmed, reads ``Done ... runs in ... second(s)``."""

    def closing_line(mark: Column) -> Column:
        line = trim_space(mark)
        rest = F.substring(line, F.lit(6), F.length(line))
        return (
            F.startswith(line, F.lit("Done "))
            & F.contains(rest, F.lit(" runs in "))
            & F.contains(rest, F.lit(" second(s)"))
        )

    return F.exists(marks, closing_line)


def fuzz_status(success: Column, marks: Column) -> Column:
    return (
        F.when(success & budget_reached(marks), F.lit("pass"))
        .when(success, F.lit("clean"))
        .when(is_environment_failure(marks), F.lit("error"))
        .when(_any_of(marks, FUZZ_FINDING_MARKERS), F.lit("finding"))
        .otherwise(F.lit("error"))
    )


def fuzz_error_kind(status: Column, marks: Column) -> Column:
    return (
        F.when(status == "finding", F.lit("finding"))
        .when((status == "error") & is_environment_failure(marks), F.lit("environment_error"))
        .when(status == "error", F.lit("tool_error"))
    )


def _run_count(digits: Column) -> Column:
    """Digits as an unsigned 64-bit number, null if they are none or too many."""
    number = F.when(digits.rlike(r"^[0-9]+$"), digits.try_cast(RUNS_TYPE))
    return F.when(number <= F.lit(LARGEST_RUNS).cast(RUNS_TYPE), number)


def fuzz_runs(marks: Column) -> Column:
    """Number of executed runs: the first readable ``runs:`` field, else a ``Done`` line.

    The number may be glued to ``runs:`` or be the token right after it. A token looked at
    as that number is used up, also when it is none.
    """
    start = F.struct(F.lit(None).cast(RUNS_TYPE).alias("found"), F.lit(False).alias("used"))

    def step(state: Column, field: Column) -> Column:
        glued = F.regexp_extract(field, rf"^runs:([{_FIELD}]*)", 1)
        behind = F.regexp_extract(field, rf"^runs:[^{_FIELD}]([{_FIELD}]*)$", 1)
        digits = F.when(~state["used"], F.when(glued != "", glued).otherwise(behind))
        return F.struct(
            F.coalesce(state["found"], _run_count(digits)).alias("found"),
            (~state["used"] & (glued == "") & F.startswith(behind, F.lit("runs:"))).alias("used"),
        )

    fields = F.filter(marks, lambda m: F.startswith(m, F.lit("runs:")))
    done_lines = F.filter(marks, lambda m: F.startswith(m, F.lit("Done ")))
    numbers = F.transform(
        done_lines,
        lambda line: _run_count(
            F.regexp_extract(line, rf"^Done [{WHITESPACE}]*\+?([0-9]+)(?=[{WHITESPACE}]|$)", 1)
        ),
    )
    in_done_line = F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(1))
    return F.coalesce(F.aggregate(fields, start, step, lambda s: s["found"]), in_done_line)


def fuzz_summary(target: Column, budget: Column, status: Column, runs: Column, marks: Column) -> Column:
    outcome = (
        F.when(status == "pass", F.lit("pass (reached budget limit without findings)"))
        .when(
            (status == "error") & is_environment_failure(marks),
            F.lit("environment error: LeakSanitizer unsupported under ptrace"),
        )
        .otherwise(status)
    )
    runs_part = F.coalesce(F.concat(runs.cast("string"), F.lit(" runs, ")), F.lit(""))
    return F.concat(
        F.lit("target "), target, F.lit(", budget "), budget.cast("string"), F.lit("s, "), runs_part, outcome
    )


def missing_source(marks: Column) -> Column:
    """Path in a ``can't find bin`` message, null without one."""
    messages = F.filter(marks, lambda m: F.startswith(m, F.lit("error: can't find bin ")))
    return F.regexp_extract(F.try_element_at(messages, F.lit(1)), r" at path `([^`]*)`$", 1)


def build_failure(target: Column, budget: Column, detail: Column, marks: Column) -> Column:
    """Record of a target that did not build: ``struct(status, error_kind, summary, detail)``."""
    missing = missing_source(marks)
    prefix = F.concat(F.lit("target "), target, F.lit(", budget "), budget.cast("string"), F.lit("s, "))
    return F.struct(
        F.when(missing.isNull(), F.lit("error")).otherwise(F.lit("skipped")).alias("status"),
        F.when(missing.isNull(), F.lit("tool_error")).alias("error_kind"),
        F.when(missing.isNull(), F.concat(prefix, F.lit("build error")))
        .otherwise(F.concat(prefix, F.lit("declared source missing at "), missing))
        .alias("summary"),
        F.when(trim_space(detail) == "", F.concat(F.lit("cargo fuzz build failed for "), target))
        .otherwise(detail)
        .alias("detail"),
    )


# ---- package counter --------------------------------------------------------------------


def counter_status(success: Column, marks: Column) -> Column:
    panicked = F.lit(True)
    for marker in COUNTER_PANIC_MARKERS:
        panicked = panicked & F.array_contains(marks, F.lit(marker))
    return (
        F.when(success, F.lit("clean")).when(panicked, F.lit("skipped")).otherwise(F.lit("error"))
    )


def counter_summary(status: Column, success: Column, root: Column, dependency: Column) -> Column:
    root_part = F.concat(F.lit("root unsafe exprs "), root.cast("string"))
    dependency_part = F.concat(F.lit(", dependency unsafe exprs "), dependency.cast("string"))
    return (
        F.when(root.isNotNull(), F.concat(root_part, F.coalesce(dependency_part, F.lit(""))))
        .when(status == "skipped", F.lit("geiger tool failure, skipped"))
        .when(success, F.lit("geiger completed"))
        .otherwise(F.lit("geiger failed"))
    )


def _package_report(line: Column) -> Column:
    """Parsed report; null where the line is no JSON to its end or lacks a required field."""
    report = F.from_json(line, PACKAGE_REPORT_SCHEMA, STRICT_JSON)
    complete = F.forall(
        report["packages"],
        lambda p: p["package"]["id"]["name"].isNotNull()
        & (p["unsafety"]["used"]["exprs"]["unsafe_"] >= 0),
    )
    return F.when(F.coalesce(complete, F.lit(False)) & json_valid(line), report)


def last_report(marks: Column) -> Column:
    """``struct(line, report)`` of the last line that is a readable package report, else null.

    Each line is parsed once; what follows works on the parsed report.
    """
    lines = F.filter(
        F.transform(marks, trim_space),
        lambda line: F.startswith(line, F.lit("{")) & F.contains(line, F.lit('"packages"')),
    )
    parsed = F.transform(lines, lambda line: F.struct(line.alias("line"), _package_report(line).alias("report")))
    return F.try_element_at(F.filter(parsed, lambda x: x["report"].isNotNull()), F.lit(-1))


def last_report_line(marks: Column) -> Column:
    """Last line that is a readable package report, null without one."""
    return last_report(marks)["line"]


def package_tier(name: Column, source_path: Column, crate: Column, crate_path: Column) -> Column:
    """1: same name, and the same path or none given; 2: same name only; null: not the root."""
    same_path = source_path.isNull() | (file_url_path(source_path) == crate_path)
    return F.when(
        name == crate, F.when(F.coalesce(same_path, F.lit(False)), F.lit(1)).otherwise(F.lit(2))
    )


def package_counts(report: Column, crate: Column, crate_path: Column) -> Column:
    """``struct(root_unsafe, dependency_unsafe)`` of one parsed report; nulls without a root."""
    packages = F.transform(
        report["packages"],
        lambda p, pos: F.struct(
            package_tier(
                p["package"]["id"]["name"], p["package"]["id"]["source"]["Path"], crate, crate_path
            ).alias("tier"),
            pos.alias("pos"),
            p["unsafety"]["used"]["exprs"]["unsafe_"].alias("n"),
        ),
    )
    root = F.array_min(F.filter(packages, lambda p: p["tier"].isNotNull()))
    total = F.aggregate(packages, F.lit(0).cast("bigint"), lambda s, p: s + p["n"])
    return F.struct(root["n"].alias("root_unsafe"), (total - root["n"]).alias("dependency_unsafe"))


# ---- any tool ---------------------------------------------------------------------------


def run_status(kind: Column, success: Column, marks: Column, failed_build: Column) -> Column:
    """Status of one run of any tool; an interpreter run counts as strict, without baseline."""
    verdict = interpreter_verdict(success, has_ub(marks), F.lit(None).cast("boolean"))
    return (
        F.when(failed_build, F.when(missing_source(marks).isNull(), F.lit("error")).otherwise(F.lit("skipped")))
        .when(kind == "geiger", counter_status(success, marks))
        .when(kind == "miri", verdict_status(verdict))
        .when(kind == "fuzz", fuzz_status(success, marks))
    )
