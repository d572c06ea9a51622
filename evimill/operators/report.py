"""Report tables: summaries, ranked review lists, Markdown rows, nested documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimill.functions.text import escape_bars, excerpt, table_cell
from evimill.functions.vocabulary import REVIEW_ROWS, REVIEW_SUFFIX, REVIEW_WORDS
from evimill.operators.evidence import EVIDENCE_KINDS, finding_flags, status_columns
from evimill.operators.numbering import by_slot, with_offset
from evimill.operators.study_plan import RunSettings, phase_label

# Counters of source-code sites: a kind listed here counts as that kind whatever its
# pattern, other sites count by pattern.
CODE_COUNTERS_BY_KIND = {
    "unsafe_block": "unsafe_blocks",
    "unsafe_fn": "unsafe_fns",
    "unsafe_impl": "unsafe_impls",
    "extern_block": "extern_blocks",
}
CODE_COUNTERS_BY_PATTERN = {
    "ptr_op": "ptr_ops",
    "transmute": "transmutes",
    "unchecked_op": "unchecked_ops",
    "inline_asm": "inline_asm",
}

HTML_COUNTERS_BY_KIND = {"block": "blocks", "comment": "comments", "element": "elements"}
HTML_COUNTERS_BY_PATTERN = {"link": "links", "entity": "entities"}

# Labels of the inventory lines of a crate, with the counters they show.
INVENTORY_LINES = [
    ("unsafe blocks", "unsafe_blocks"),
    ("unsafe fns", "unsafe_fns"),
    ("unsafe impls", "unsafe_impls"),
    ("extern blocks", "extern_blocks"),
    ("pointer operations", "ptr_ops"),
    ("transmutes", "transmutes"),
    ("unchecked operations", "unchecked_ops"),
]


# ---- sites ------------------------------------------------------------------------------


def pattern_summary(
    sites: DataFrame,
    by_kind: dict[str, str] = CODE_COUNTERS_BY_KIND,
    by_pattern: dict[str, str] = CODE_COUNTERS_BY_PATTERN,
) -> DataFrame:
    """Counters per crate; every site counts in exactly one."""
    return sites.groupBy("crate").agg(*_counters(by_kind, by_pattern))


def _counters(by_kind: dict[str, str], by_pattern: dict[str, str]) -> list[Column]:
    kind, pattern = F.col("kind"), F.col("pattern")
    by_kind_alone = kind.isin(list(by_kind))
    known = by_kind_alone | F.coalesce(pattern.isin(list(by_pattern)), F.lit(False))
    return [
        *[F.count_if(kind == k).alias(name) for k, name in by_kind.items()],
        *[F.count_if(~by_kind_alone & (pattern == p)).alias(name) for p, name in by_pattern.items()],
        F.count_if(~known).alias("other"),
    ]


def pattern_summary_of_slots(
    sites: DataFrame,
    by_kind: dict[str, str] = CODE_COUNTERS_BY_KIND,
    by_pattern: dict[str, str] = CODE_COUNTERS_BY_PATTERN,
) -> DataFrame:
    """The same for sites with ``_slot``, out of a shuffle that numbers them as well."""
    counted = by_slot(sites, "crate", *_counters(by_kind, by_pattern))
    return counted.groupBy("crate").agg(*[F.sum(c).alias(c) for c in counted.columns if c != "crate"])


def site_counts(crates: DataFrame, scanned: DataFrame) -> DataFrame:
    """Sites per crate, 0 for crates without any; counted per file before the shuffle."""
    counts = scanned.groupBy("crate").agg(F.sum(F.size("sites")).alias("n_sites"))
    return crates.select("crate").join(counts, "crate", "left").select(
        "crate", F.coalesce("n_sites", F.lit(0)).cast("bigint").alias("n_sites")
    )


def summary_counts(crates: DataFrame, summary: DataFrame) -> DataFrame:
    """Crates with all counters of their summary, and their sum ``n_sites``; 0 where there is none."""
    counters = [c for c in summary.columns if c != "crate"]
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counters]
    joined = crates.select("crate").join(summary, "crate", "left").select("crate", *filled)
    return joined.withColumn("n_sites", sum((F.col(c) for c in counters), F.lit(0).cast("bigint")))


#: Parts of a crate that are ranked on their own first.
REVIEW_PARTS = 64


def _first_ten(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= REVIEW_ROWS)


def review_priority(
    sites: DataFrame, records: DataFrame | None = None, statuses: DataFrame | None = None
) -> DataFrame:
    """The ten sites per crate to look at first.

    A finding anywhere in the crate changes the wording of a reason, never its rank. So the
    ten are chosen first and the flag is joined to those alone. A crate is dealt into parts by
    hash, each task keeps ten per crate and part before the shuffle, and ten of each part meet:
    however many tasks hold a crate, the last one sees ``REVIEW_PARTS`` times ten of its rows.
    ``statuses`` is the roll-up of the records where there is one already.
    """
    base = F.coalesce("pattern", "kind")
    score = F.lit(len(REVIEW_WORDS))
    for rank, word in reversed(list(enumerate(REVIEW_WORDS))):
        score = F.when(F.contains(base, F.lit(word)), F.lit(rank)).otherwise(score)
    order = ["score", "file", "line", "seq"]
    dealt = sites.withColumn("score", score).withColumn("_part", F.pmod(F.xxhash64("file", "line", "seq"), F.lit(REVIEW_PARTS)))
    top = _first_ten(_first_ten(dealt, ["crate", "_part"], order), ["crate"], order)
    if records is None and statuses is None:
        flagged = top.withColumn("dynamic_finding", F.lit(False))
    else:
        flagged = top.join(finding_flags(records, statuses), "crate", "left")
    dynamic = F.coalesce("dynamic_finding", F.lit(False)) & F.col("pattern").isNotNull()
    reason = F.when(dynamic, F.concat(base, F.lit(REVIEW_SUFFIX))).otherwise(base)
    return flagged.select("crate", "rank", "site_id", "file", "line", reason.alias("reason"))


# ---- overview ---------------------------------------------------------------------------


def overview(
    counts: DataFrame, records: DataFrame | None, scan_selected: bool = True, with_counters: bool = False,
    statuses: DataFrame | None = None,
) -> DataFrame:
    """(crate, sites, geiger, miri, fuzz) for every crate of ``counts``, then its counters if wanted.

    ``statuses`` is the roll-up of the records where there is one already.
    """
    statuses = statuses or status_columns(records, EVIDENCE_KINDS)
    sites = F.col("n_sites").cast("string") if scan_selected else F.lit("-")
    return counts.join(statuses, "crate", "left").select(
        "crate",
        sites.alias("sites"),
        *[F.coalesce(kind, F.lit("-")).alias(kind) for kind in EVIDENCE_KINDS],
        *[c for c in counts.columns if with_counters and c != "crate"],
    )


# ---- Markdown ---------------------------------------------------------------------------


def _table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_overview(table: DataFrame) -> DataFrame:
    cells = [F.col(c) for c in ("crate", "sites", *EVIDENCE_KINDS)]
    return table.select("crate", _table_row(*cells).alias("text"))


def evidence_detail() -> Column:
    """``k=v; k=v`` of the evidence fields a record has, in fixed order; ``-`` for none."""
    cell = table_cell(excerpt(F.col("excerpt")))
    fields = [
        ("root_unsafe_exprs=", F.col("root_unsafe").cast("string"), ""),
        ("dependency_unsafe_exprs=", F.col("dependency_unsafe").cast("string"), ""),
        ("verdict=", F.col("verdict"), ""),
        ("ub_category=", F.col("ub_category"), ""),
        ("target=", F.col("target"), ""),
        ("budget=", F.col("budget_secs").cast("string"), "s"),
        ("error_kind=", F.col("error_kind"), ""),
        ("artifact=", F.col("artifact"), ""),
        ("runs=", F.col("runs").cast("string"), ""),
        ("excerpt=", cell, ""),
    ]
    parts = [F.concat(F.lit(name), value, F.lit(unit)) for name, value, unit in fields]
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("-"))


def markdown_evidence(records: DataFrame) -> DataFrame:
    """One table row per record; columns that are no part of a record are carried along."""
    summary = F.concat(
        escape_bars(F.col("summary")), F.lit(" ("), F.col("duration_ms").cast("string"), F.lit(" ms)")
    )
    row = _table_row(
        F.col("kind"), F.col("name"), F.col("status"), summary, evidence_detail(),
        F.coalesce("log_path", F.lit("-")),
    )
    return records.withColumn("text", row)


def inventory_lines(scan_selected: bool = True) -> list[Column]:
    """The counter lines of a crate, from a row of :func:`summary_counts`."""
    if not scan_selected:
        return [F.lit("- scan: skipped"), F.lit("- sites: -")]
    return [
        F.concat(F.lit(f"- {label}: "), F.col(name).cast("string"))
        for label, name in [("sites", "n_sites"), *INVENTORY_LINES]
    ]


def markdown_inventory(counts: DataFrame, scan_selected: bool = True) -> DataFrame:
    """(crate, ordinal, text): the counter lines of every crate of :func:`summary_counts`."""
    return counts.select("crate", F.posexplode(F.array(*inventory_lines(scan_selected))).alias("ordinal", "text"))


def markdown_review(review: DataFrame) -> DataFrame:
    """(crate, ordinal, text): one list item per review row."""
    item = F.concat(
        F.lit("- `"), F.col("file"), F.lit("`:"), F.col("line").cast("string"),
        F.lit(" `"), F.col("site_id"), F.lit("` - "), F.col("reason"),
    )
    return review.select("crate", F.col("rank").alias("ordinal"), item.alias("text"))


def markdown_head(settings: RunSettings, title: str) -> list[str]:
    """Lines before the rows of the overview table."""
    facts = settings.as_document()["execution"]
    selected = [kind for kind, on in facts["phases"].items() if on]
    shown = {
        "profile": facts["profile"],
        "jobs": facts["jobs"],
        "fuzz_jobs": facts["fuzz_jobs"],
        "phases": phase_label(selected),
        "miri_triage": str(facts["miri_triage"]).lower(),
        "default_fuzz_time": "-" if facts["fuzz_time"] is None else f"{facts['fuzz_time']}s",
        "fuzz_env": ", ".join(f"{k}={v}" for k, v in facts["fuzz_env"].items()) or "-",
    }
    return [
        f"# {title}", "", "Schema version: `1`", "", f"Study: `{settings.study_name}`", "",
        "## Execution", "", *[f"- {name}: `{value}`" for name, value in shown.items()], "",
        "## Study overview", "",
        "| crate | unsafe sites | geiger | miri | fuzz |",
        "| --- | ---: | --- | --- | --- |",
    ]


# Order of the lines of a report.
REPORT_ORDER = ["part", "crate_ord", "section", "ordinal"]
REPORT_COLUMNS = [*REPORT_ORDER[:2], "crate", *REPORT_ORDER[2:], "text"]


def markdown_report(
    head: list[str], crates: DataFrame, overview_rows: DataFrame, evidence: DataFrame,
    review: DataFrame, order: list[str], scan_selected: bool = True, drawn_from: DataFrame | None = None,
) -> DataFrame:
    """All lines of a report with the columns that order them, unsorted.

    Part 0 is the head, part 1 the overview with a row per crate, part 2 the crates in plan
    order. ``crates`` is the plan: (crate, crate_ord, path). ``overview_rows`` holds a row per crate
    with its counters and the cells of the overview; its line there and all lines of its head come
    from that row. ``order`` names the columns of ``evidence`` that order the records of a crate.
    """
    blank = F.lit("")
    top = [
        blank, F.concat(F.lit("## Crate `"), F.col("crate"), F.lit("`")), blank,
        F.concat(F.lit("Path: `"), F.col("path"), F.lit("`")), blank, F.lit("### Unsafe inventory"), blank,
        *inventory_lines(scan_selected),
        blank, F.lit("### Dynamic evidence"), blank,
        F.lit("| phase | name | status | summary | detail | log |"),
        F.lit("| --- | --- | --- | --- | --- | --- |"),
    ]

    def line(part: int, section: int, ordinal: int, text: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), F.lit(section).alias("section"),
            F.lit(ordinal).cast("bigint").alias("ordinal"), text.alias("text"),
        )

    cells = _table_row(*[F.col(c) for c in ("crate", "sites", *EVIDENCE_KINDS)])
    of_crate = F.array(line(1, 0, 0, cells), *[line(2, 1, k, text) for k, text in enumerate(top)])
    per_crate = overview_rows.join(crates, "crate").select("crate", "crate_ord", F.inline(of_crate))

    def rows(section: int, df: DataFrame, ordinal: Column) -> DataFrame:
        return df.join(crates.select("crate", "crate_ord"), "crate").select(
            "crate", "crate_ord", F.lit(2).alias("part"), F.lit(section).alias("section"),
            ordinal.cast("bigint").alias("ordinal"), "text",
        )

    numbered = with_offset(evidence, "crate", order, F.lit(1), "number", drawn_from=drawn_from)
    heading = F.when(F.col("ordinal") == 1, F.array(blank, F.lit("### Review priority"), blank))
    reviewed = review.select(
        "crate", "ordinal", F.posexplode(F.concat(F.coalesce(heading, F.array()), F.array("text"))).alias("n", "text")
    )
    head_rows = crates.sparkSession.createDataFrame(
        [("", -1, 0, 0, k, text) for k, text in enumerate(head)],
        "crate string, crate_ord bigint, part int, section int, ordinal bigint, text string",
    )
    return (
        head_rows.unionByName(per_crate)
        .unionByName(rows(2, numbered, F.col("number")))
        .unionByName(rows(3, reviewed, F.col("ordinal") * 4 + F.col("n")))
        .select(*REPORT_COLUMNS)
    )


# ---- nested documents -------------------------------------------------------------------


def nested_report(
    settings: RunSettings, crates: DataFrame, sites: DataFrame, records: DataFrame, review: DataFrame,
    record_order: list[str], chunk_rows: int = 500, drawn_from: DataFrame | None = None,
) -> DataFrame:
    """(crate, section, chunk, document): the report as JSON documents of bounded size.

    One document states the settings. A crate has one head with its review rows, and its sites
    and records in chunks of ``chunk_rows``, numbered in order. A crate of any size is a number of
    documents, never one row; :func:`evimill.sources.reports.read_report` puts the tables together
    again.

    ``crates`` holds one row per crate with the columns of its head, ``sites`` carries
    ``number`` (1-based in its crate).
    """
    keep_nulls = {"ignoreNullFields": "false"}

    def documents(section: str, df: DataFrame, number: Column, fields: list[str]) -> DataFrame:
        item = F.struct(number.alias("number"), *fields)
        chunks = df.groupBy("crate", F.floor((number - 1) / chunk_rows).cast("bigint").alias("chunk")).agg(
            F.array_sort(F.collect_list(item)).alias("items")
        )
        return chunks.select(
            "crate",
            F.lit(section).alias("section"),
            "chunk",
            F.to_json(F.struct("crate", F.col("items").alias(section)), keep_nulls).alias("document"),
        )

    numbered = with_offset(records, "crate", record_order, F.lit(1), "_offset", drawn_from=drawn_from)
    rows = review.groupBy("crate").agg(
        F.array_sort(F.collect_list(F.struct("rank", "site_id", "file", "line", "reason"))).alias("review")
    )
    head = F.struct(*[c for c in crates.columns], "review")
    heads = crates.join(rows, "crate", "left").select(
        "crate",
        F.lit("head").alias("section"),
        F.lit(0).cast("bigint").alias("chunk"),
        F.to_json(head, keep_nulls).alias("document"),
    )
    record_fields = [c for c in records.columns if c not in {"crate", *record_order}]
    study = crates.sparkSession.createDataFrame(
        [(None, "study", 0, json.dumps(settings.as_document(), separators=(",", ":")))],
        "crate string, section string, chunk bigint, document string",
    )
    return (
        study.unionByName(heads)
        .unionByName(
            documents("sites", sites, F.col("number"), ["site_id", "file", "line", "kind", "pattern"])
        )
        .unionByName(documents("phases", numbered, F.col("_offset") + 1, record_fields))
    )
