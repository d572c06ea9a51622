"""Report tables over run logs and the corpora of the same crates."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from evimill.functions import logs as L
from evimill.functions import vocabulary as W
from evimill.operators import evidence as E
from evimill.operators import report as R
from evimill.operators import report_update as RU
from evimill.operators import site_scan as S
from evimill.operators.numbering import placed_rows
from evimill.operators.study_plan import RunSettings
from evimill.plans import logs
from evimill.plans.corpus import NUMBERED, code_sites_cte, counters_sql, scan_sql
from evimill.plans.dialect import literal, with_views
from evimill.plans.logs import RECORD_ORDER_SQL, RECORD_VIEWS, RECORDS_CTE, SEVERITY_SQL, excerpt_sql
from evimill.sources import views as V

SETTINGS = RunSettings(study_name="logs", miri_triage=True, fuzz_time=60, fuzz_env={"B": "2", "A": "1"})
TITLE = "evidence report"

# Columns that order the records of a crate.
RECORD_ORDER = ["kind_ord", "group_ord", "stage_ord", "record_no"]
_KIND_ORD = "array_position(array('geiger', 'miri', 'fuzz'), kind)"
_STAGE_ORD = "array_position(array('missing', 'build', 'run'), stage)"


def _scanned(spark, sf_dir):
    """Code of the crates of the run logs."""
    return S.scan_code(V.code_files(spark, sf_dir, V.REPORT_CRATE))


def _crates(spark, sf_dir):
    """The plan: all crates of the study."""
    return V.study(spark, sf_dir)


def _ordered(records):
    return records.withColumns({"kind_ord": F.expr(_KIND_ORD), "stage_ord": F.expr(_STAGE_ORD)})


def _records(spark, sf_dir):
    return _ordered(logs.crate_records(spark, sf_dir))


def review_priority(spark, sf_dir):
    """Sites of the pages, the ten to look at first per crate, with the findings of its logs."""
    scanned = S.scan_files(V.report_files(spark, sf_dir), S.HTML_RULES)
    return R.review_priority(S.numbered_sites(scanned, S.HTML_RULES), logs.statuses(spark, sf_dir))


def code_review_priority(spark, sf_dir):
    return _code_review(spark, sf_dir, E.status_columns(logs.statuses(spark, sf_dir), E.EVIDENCE_KINDS))


def _code_review(spark, sf_dir, statuses):
    sites = S.numbered_sites(_scanned(spark, sf_dir), S.CODE_RULES)
    return R.review_priority(sites, statuses=statuses)


def _counts(spark, sf_dir):
    """Counters of every crate of the plan."""
    summary = R.pattern_summary(S.site_rows(_scanned(spark, sf_dir), S.CODE_RULES))
    return R.summary_counts(_crates(spark, sf_dir), summary)


def _counts_beside_sites(spark, sf_dir):
    """The same in a report that numbers the sites, which are scanned once for both."""
    summary = R.pattern_summary_of_slots(S.placed_sites(_scanned(spark, sf_dir), S.CODE_RULES))
    return R.summary_counts(_crates(spark, sf_dir), summary)


def _overview(spark, sf_dir):
    counts = R.site_counts(_crates(spark, sf_dir), _scanned(spark, sf_dir))
    return R.overview(counts, logs.statuses(spark, sf_dir))


def _without_scan(spark, sf_dir, statuses):
    counts = _crates(spark, sf_dir).select("crate")
    return R.overview(counts, None, scan_selected=False, statuses=statuses)


def overview_without_scan(spark, sf_dir):
    """The overview when the scan was not selected: ``-``, not 0."""
    return _without_scan(spark, sf_dir, E.status_columns(logs.statuses(spark, sf_dir), E.EVIDENCE_KINDS))


def markdown_overview(spark, sf_dir):
    return R.markdown_overview(_overview(spark, sf_dir))


def markdown_evidence(spark, sf_dir):
    return R.markdown_evidence(logs.crate_records(spark, sf_dir)).select("crate", "kind", "record_no", "text")


def markdown_inventory(spark, sf_dir):
    return R.markdown_inventory(_counts(spark, sf_dir))


def markdown_review(spark, sf_dir):
    return R.markdown_review(code_review_priority(spark, sf_dir))


# The severity comes behind a key that is unique without it: the roll-up reads it from the same shuffle,
# and no reader of that leaves it out.
_EVIDENCE_ORDER = [*RECORD_ORDER, "severity"]


def _evidence(spark, sf_dir):
    lines = R.markdown_evidence(_records(spark, sf_dir)).withColumn("severity", L.severity(F.col("status")))
    return lines.select("crate", *_EVIDENCE_ORDER, "text")


def _of_kind():
    return {kind: F.col("kind_ord") == k for k, kind in enumerate(E.EVIDENCE_KINDS, start=1)}


def _evidence_keys(spark, sf_dir):
    return _ordered(logs.record_keys(spark, sf_dir)).withColumn("severity", F.lit(0))


def _statuses_beside(evidence, keys):
    """Roll-up in a report that numbers this evidence, which is made once for both."""
    placed = placed_rows(evidence, "crate", _EVIDENCE_ORDER, keys)
    return E.status_columns_of_slots(placed, _of_kind(), F.col("severity"))


def markdown_report(spark, sf_dir):
    """Every line of the report; sorted only by the sink."""
    evidence, keys = _evidence(spark, sf_dir), _evidence_keys(spark, sf_dir)
    statuses = _statuses_beside(evidence, keys)
    return R.markdown_report(
        R.markdown_head(SETTINGS, TITLE),
        _crates(spark, sf_dir),
        R.overview(_counts_beside_sites(spark, sf_dir), None, with_counters=True, statuses=statuses),
        evidence,
        R.markdown_review(_code_review(spark, sf_dir, statuses)),
        _EVIDENCE_ORDER,
        drawn_from=keys,
    )


def markdown_report_without_scan(spark, sf_dir):
    """The report of a run that left out the scan: nothing is read of the code."""
    evidence, keys = _evidence(spark, sf_dir), _evidence_keys(spark, sf_dir)
    review = spark.createDataFrame([], "crate string, ordinal int, text string")
    settings = dataclasses.replace(SETTINGS, phases=("geiger", "miri", "fuzz"))
    return R.markdown_report(
        R.markdown_head(settings, TITLE),
        _crates(spark, sf_dir),
        _without_scan(spark, sf_dir, _statuses_beside(evidence, keys)),
        evidence,
        review,
        _EVIDENCE_ORDER,
        scan_selected=False,
        drawn_from=keys,
    )


def report_nested(spark, sf_dir):
    sites = S.numbered_sites(_scanned(spark, sf_dir), S.CODE_RULES)
    counters = [*R.CODE_COUNTERS_BY_KIND.values(), *R.CODE_COUNTERS_BY_PATTERN.values(), "other"]
    heads = _crates(spark, sf_dir).join(_counts_beside_sites(spark, sf_dir), "crate").select(
        "crate", "crate_ord", "path", "cohort", "n_sites", F.struct(*counters).alias("pattern_summary")
    )
    numbered = sites.withColumn("number", F.substring("site_id", 2, 20).cast("bigint"))
    records, keys = _records(spark, sf_dir), _ordered(logs.record_keys(spark, sf_dir))
    statuses = E.status_columns_of_slots(
        placed_rows(records, "crate", RECORD_ORDER, keys), _of_kind(), L.severity(F.col("status"))
    )
    return R.nested_report(
        SETTINGS, heads, numbered, records, _code_review(spark, sf_dir, statuses), RECORD_ORDER, drawn_from=keys
    )


def report_stale_crates(spark, sf_dir):
    """Crates to make again since the last report: one lacked a run, one had another log, one two equal runs more."""
    now = V.run_logs(spark, sf_dir)
    then = now.filter(~F.expr(_NEW_RUN)).withColumn("combined_output", F.expr(_OLD_OUTPUT))
    then = then.unionByName(now.filter(_TWICE))
    # the count of all runs of a crate beside its name
    runs = now.groupBy("crate").agg(F.count(F.lit(1)).alias("n_runs"))
    return RU.stale_crates(RU.input_digests({"runs": then}), RU.input_digests({"runs": now})).join(runs, "crate")


_NEW_RUN = "crate = 'c3' AND run_id % 5 = 0"
_OLD_OUTPUT = "CASE WHEN crate = 'c8' AND run_id % 7 = 0 THEN concat(combined_output, ' older') ELSE combined_output END"
_TWICE = "crate = 'c1' AND run_id % 3 = 0"


QUERIES = {
    "report_stale_crates": report_stale_crates,
    "review_priority": review_priority,
    "code_review_priority": code_review_priority,
    "overview_pivot": _overview,
    "overview_without_scan": overview_without_scan,
    "markdown_overview": markdown_overview,
    "markdown_evidence": markdown_evidence,
    "markdown_inventory": markdown_inventory,
    "markdown_review": markdown_review,
    "markdown_report": markdown_report,
    "markdown_report_without_scan": markdown_report_without_scan,
    "report_nested": report_nested,
}

# ---- oracles ----------------------------------------------------------------------------

_REASON = "coalesce(pattern, kind)"
_SCORE = (
    "CASE "
    + " ".join(f"WHEN contains({_REASON}, {literal(w)}) THEN {i}" for i, w in enumerate(W.REVIEW_WORDS))
    + f" ELSE {len(W.REVIEW_WORDS)} END"
)
_REVIEW = f"""flags AS (SELECT crate, bool_or(status IN ('finding', 'error')) AS dynamic_finding FROM records GROUP BY crate),
ranked AS (SELECT *, printf('U%04d', number) AS site_id,
    row_number() OVER (PARTITION BY crate ORDER BY {_SCORE}, file, line, seq) AS rank FROM numbered),
review AS (SELECT crate, CAST(rank AS INTEGER) AS rank, site_id, file, line,
    concat({_REASON}, CASE WHEN dynamic_finding AND pattern IS NOT NULL THEN {literal(W.REVIEW_SUFFIX)} ELSE '' END) AS reason
  FROM ranked LEFT JOIN flags USING (crate) WHERE rank <= {W.REVIEW_ROWS})"""

_CODE = [RECORDS_CTE, code_sites_cte(V.REPORT_CRATE), NUMBERED, _REVIEW]

_STATUSES = ", ".join(
    f"coalesce((SELECT arg_max(status, {SEVERITY_SQL}) FROM records r WHERE r.crate = c.crate AND kind = '{kind}'), '-') AS {kind}"
    for kind in R.EVIDENCE_KINDS
)
_OVERVIEW = f"""crates AS (SELECT crate, crate_ord, path, cohort FROM study),
counts AS (SELECT c.crate, (SELECT count(*) FROM sites s WHERE s.crate = c.crate) AS n_sites FROM crates c),
overview AS (SELECT c.crate, CAST(n_sites AS VARCHAR) AS sites, {_STATUSES} FROM counts c)"""

_CELL = f"CASE WHEN excerpt IS NOT NULL THEN replace(replace({excerpt_sql('excerpt')}, '|', '\\|'), chr(10), ' ') END"
_DETAIL = f"""coalesce(nullif(concat_ws('; ', 'root_unsafe_exprs=' || root_unsafe, 'dependency_unsafe_exprs=' || dependency_unsafe,
  'verdict=' || verdict, 'ub_category=' || ub_category, 'target=' || target, 'budget=' || budget_secs || 's',
  'error_kind=' || error_kind, 'artifact=' || artifact, 'runs=' || runs, 'excerpt=' || {_CELL}), ''), '-')"""
_EVIDENCE = f"""evidence AS (SELECT crate, record_no, kind, group_ord, stage, concat('| ', concat_ws(' | ', kind, name, status,
    concat(replace(summary, '|', '\\|'), ' (', duration_ms, ' ms)'), {_DETAIL}, coalesce(log_path, '-')), ' |') AS text
  FROM records)"""

_SUMMARY = f"summary AS ({counters_sql(R.CODE_COUNTERS_BY_KIND, R.CODE_COUNTERS_BY_PATTERN)})"
_LINE_LIST = ["concat('- sites: ', n_sites)"] + [
    f"concat('- {label}: ', coalesce({name}, 0))" for label, name in R.INVENTORY_LINES
]
_LINES = ", ".join(_LINE_LIST)
_INVENTORY = f"""inventory AS (SELECT crate, CAST(unnest(range({len(R.INVENTORY_LINES) + 1})) AS INTEGER) AS ordinal, unnest([{_LINES}]) AS text
  FROM counts LEFT JOIN summary USING (crate))"""
_REVIEW_LINES = """review_lines AS (SELECT crate, rank AS ordinal,
    concat('- `', file, '`:', line, ' `', site_id, '` - ', reason) AS text FROM review)"""

_RECORD_JSON = [
    "kind", "name", "status", "duration_ms", "log_path", "summary", "root_unsafe", "dependency_unsafe", "verdict",
    "ub_category", "target", "budget_secs", "artifact", "error_kind", "runs", "excerpt", "group_name", "stage", "command",
]
_COUNTERS = [*R.CODE_COUNTERS_BY_KIND.values(), *R.CODE_COUNTERS_BY_PATTERN.values(), "other"]


def _struct(fields: list[str]) -> str:
    return "{" + ", ".join(f"'{f}': {f}" for f in fields) + "}"


_STUDY = (
    '{"schema_version":1,"study_name":"logs","execution":{"profile":"full","jobs":1,"fuzz_jobs":1,'
    '"phases":{"scan":true,"geiger":true,"miri":true,"fuzz":true},"miri_triage":true,"fuzz_time":60,'
    '"fuzz_env":{"A":"1","B":"2"}}}'
)
_NESTED = f"""SELECT CAST(NULL AS VARCHAR) AS crate, 'study' AS section, CAST(0 AS BIGINT) AS chunk, {literal(_STUDY)} AS document
UNION ALL
SELECT crate, 'head' AS section, CAST(0 AS BIGINT) AS chunk,
  CAST(to_json({{'crate': crate, 'crate_ord': crate_ord, 'path': path, 'cohort': cohort, 'n_sites': n_sites,
    'pattern_summary': {{{', '.join(f"'{c}': coalesce({c}, 0)" for c in _COUNTERS)}}}, 'review': (SELECT list({_struct(['rank', 'site_id', 'file', 'line', 'reason'])} ORDER BY rank) FROM review r
      WHERE r.crate = c.crate)}}) AS VARCHAR) AS document
  FROM counts c JOIN crates USING (crate) LEFT JOIN summary USING (crate)
UNION ALL
SELECT crate, 'sites', chunk, CAST(to_json({{'crate': crate, 'sites': items}}) AS VARCHAR) FROM (
  SELECT crate, (number - 1) // 500 AS chunk,
    list({_struct(['number', 'site_id', 'file', 'line', 'kind', 'pattern'])} ORDER BY number) AS items
  FROM ranked GROUP BY crate, (number - 1) // 500)
UNION ALL
SELECT crate, 'phases', chunk, CAST(to_json({{'crate': crate, 'phases': items}}) AS VARCHAR) FROM (
  SELECT crate, (number - 1) // 500 AS chunk, list({_struct(['number', *_RECORD_JSON])} ORDER BY number) AS items
  FROM (SELECT * REPLACE (CAST(runs AS HUGEINT) AS runs), row_number() OVER (PARTITION BY crate
    ORDER BY {RECORD_ORDER_SQL}) AS number FROM records)
  GROUP BY crate, (number - 1) // 500)"""

_HEAD = """# evidence report

Schema version: `1`

Study: `logs`

## Execution

- profile: `full`
- jobs: `1`
- fuzz_jobs: `1`
- phases: `scan, geiger, miri, fuzz`
- miri_triage: `true`
- default_fuzz_time: `60s`
- fuzz_env: `A=1, B=2`

## Study overview

| crate | unsafe sites | geiger | miri | fuzz |
| --- | ---: | --- | --- | --- |"""
def _report_sql(head: str, inventory: list[str], sites: str, review: bool) -> str:
    """All lines, part by part; ``inventory`` and ``sites`` are expressions over counts and summary."""
    top = [
        "''", "concat('## Crate `', crate, '`')", "''", "concat('Path: `', path, '`')", "''", "'### Unsafe inventory'", "''",
        *inventory, "''", "'### Dynamic evidence'", "''",
        "'| phase | name | status | summary | detail | log |'", "'| --- | --- | --- | --- | --- | --- |'",
    ]
    lines = f"""SELECT CAST(0 AS INTEGER) AS part, CAST(-1 AS BIGINT) AS crate_ord, '' AS crate, CAST(0 AS INTEGER) AS section,
  CAST(generate_subscripts(string_split({literal(head)}, chr(10)), 1) - 1 AS BIGINT) AS ordinal,
  unnest(string_split({literal(head)}, chr(10))) AS text
UNION ALL SELECT 1, crate_ord, crate, 0, 0, concat('| ', concat_ws(' | ', crate, {sites}, geiger, miri, fuzz), ' |')
  FROM overview JOIN crates USING (crate)
UNION ALL SELECT 2, crate_ord, crate, 1, unnest(range({len(top)})), unnest([{', '.join(top)}])
  FROM crates JOIN counts USING (crate) LEFT JOIN summary USING (crate)
UNION ALL SELECT 2, crate_ord, crate, 2, row_number() OVER (PARTITION BY crate ORDER BY {RECORD_ORDER_SQL}) - 1, text
  FROM evidence JOIN crates USING (crate)"""
    if not review:
        return lines
    return lines + """
UNION ALL SELECT 2, crate_ord, crate, 3, ordinal * 4 + CASE ordinal WHEN 1 THEN 3 ELSE 0 END, text FROM review_lines JOIN crates USING (crate)
UNION ALL SELECT 2, crate_ord, crate, 3, 4 + unnest(range(3)), unnest(['', '### Review priority', ''])
  FROM review_lines JOIN crates USING (crate) WHERE ordinal = 1"""


def _code(body: str, *more: str) -> str:
    return with_views([*RECORD_VIEWS, "study"], body, *_CODE, *more)


ORACLES = {
    "report_stale_crates": with_views(
        ["run_logs"],
        """SELECT crate, count(*) AS n_runs FROM run_logs
WHERE crate IN (SELECT crate FROM (FROM now EXCEPT ALL FROM past) UNION SELECT crate FROM (FROM past EXCEPT ALL FROM now)) GROUP BY crate""",
        "now AS (SELECT run_id, crate, kind, name, success, duration_ms, combined_output FROM run_logs)",
        f"""past AS (SELECT * REPLACE ({_OLD_OUTPUT} AS combined_output) FROM now WHERE NOT ({_NEW_RUN})
  UNION ALL SELECT * FROM now WHERE {_TWICE})""",
    ),
    "review_priority": scan_sql(
        "report_files", S.HTML_RULES, "SELECT * FROM review", NUMBERED, RECORDS_CTE, _REVIEW,
        views=["report_files", *RECORD_VIEWS],
    ),
    "code_review_priority": _code("SELECT * FROM review"),
    "overview_pivot": _code("SELECT * FROM overview", _OVERVIEW),
    "overview_without_scan": _code("SELECT * REPLACE ('-' AS sites) FROM overview", _OVERVIEW),
    "markdown_overview": _code(
        "SELECT crate, concat('| ', concat_ws(' | ', crate, sites, geiger, miri, fuzz), ' |') AS text FROM overview",
        _OVERVIEW,
    ),
    "markdown_evidence": with_views(
        RECORD_VIEWS, "SELECT crate, kind, record_no, text FROM evidence", RECORDS_CTE, _EVIDENCE
    ),
    "markdown_inventory": _code("SELECT * FROM inventory", _OVERVIEW, _SUMMARY, _INVENTORY),
    "markdown_review": _code("SELECT * FROM review_lines", _REVIEW_LINES),
    "markdown_report": _code(
        _report_sql(_HEAD, _LINE_LIST, "sites", True), _OVERVIEW, _SUMMARY, _EVIDENCE, _REVIEW_LINES
    ),
    "markdown_report_without_scan": _code(
        _report_sql(
            _HEAD.replace("`scan, geiger, miri, fuzz`", "`geiger, miri, fuzz`"), ["'- scan: skipped'", "'- sites: -'"], "'-'", False
        ),
        _OVERVIEW, _SUMMARY, _EVIDENCE,
    ),
    "report_nested": _code(_NESTED, _OVERVIEW, _SUMMARY),
}
