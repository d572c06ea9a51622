"""Corpus scans: files, sites, numbering, summaries, review lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimill.operators import report as R
from evimill.operators import rule_table as RT
from evimill.operators import site_scan as S
from evimill.plans.dialect import literal, with_views
from evimill.sources import views as V

# ---- queries ----------------------------------------------------------------------------


def corpus_files(spark, sf_dir):
    return V.corpus_files(spark, sf_dir).select(
        "crate", "file", "file_id", F.length("content").alias("n_chars")
    )


def site_scan(spark, sf_dir):
    files = V.corpus_files(spark, sf_dir)
    return _site_columns(S.site_rows(S.scan_files(files, S.HTML_RULES), S.HTML_RULES))


def text_site_scan(spark, sf_dir):
    files = V.text_files(spark, sf_dir)
    return _site_columns(S.site_rows(S.scan_files(files, S.TEXT_RULES), S.TEXT_RULES))


def _rule_table(spark, sf_dir):
    """A rule for each longer word of the benchmark passages, some with an ending, and two without an anchor."""
    items = V.table(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.posexplode(F.split("text", "[^A-Za-z]+")).alias("pos", "word")).filter(F.length("word") >= 9)
    ending = F.length("anchor") % 3 == 0
    named = words.groupBy(F.lower("word").alias("anchor")).agg(
        F.min(F.col("item_id") * 1000 + F.col("pos") + 10).cast("int").alias("rule_id")
    ).select(
        "rule_id", F.lit("word").alias("kind"), F.when(ending, F.lit("ending")).alias("pattern"),
        F.concat("anchor", F.when(ending, F.lit("[a-z]+")).otherwise(F.lit(""))).alias("rx"), "anchor",
    )
    fixed = spark.range(2).select(
        (F.col("id") + 1).cast("int").alias("rule_id"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("pattern"),
        F.when(F.col("id") == 0, F.lit("[0-9]{6,}")).otherwise(F.lit("[0-9]+%")).alias("rx"), F.lit(None).cast("string").alias("anchor"),
    )
    return named.unionByName(fixed)


def table_site_scan(spark, sf_dir):
    rules = _rule_table(spark, sf_dir)
    sites = RT.table_site_rows(RT.scan_with_table(V.text_files(spark, sf_dir), rules), rules)
    return sites.select("crate", "file", "line", "seq", "rule_id", "kind", "pattern")


def _site_columns(sites):
    return sites.select("crate", "file", "line", "seq", "kind", "pattern")


def _code_sites(spark, sf_dir):
    return S.site_rows(S.scan_code(V.code_files(spark, sf_dir)), S.CODE_RULES)


def code_site_scan(spark, sf_dir):
    return _code_sites(spark, sf_dir).select("crate", "file", "line", "kind", "pattern")


def code_rejects(spark, sf_dir):
    return S.code_rejects(V.code_files(spark, sf_dir))


def block_pattern(spark, sf_dir):
    blocks = _code_sites(spark, sf_dir).filter("kind = 'unsafe_block'")
    return blocks.select("crate", "file", "line", "pattern")


def code_pattern_summary(spark, sf_dir):
    return R.pattern_summary(_code_sites(spark, sf_dir))


def site_ids(spark, sf_dir):
    scanned = S.scan_files(V.corpus_files(spark, sf_dir), S.HTML_RULES)
    return S.numbered_sites(scanned, S.HTML_RULES).select("crate", "site_id", "file", "line", "seq", "kind", "pattern")


def pattern_summary(spark, sf_dir):
    sites = S.site_rows(S.scan_files(V.corpus_files(spark, sf_dir), S.HTML_RULES), S.HTML_RULES)
    return R.pattern_summary(sites, R.HTML_COUNTERS_BY_KIND, R.HTML_COUNTERS_BY_PATTERN)


def site_counts(spark, sf_dir):
    scanned = S.scan_files(V.text_files(spark, sf_dir), S.TEXT_RULES)
    crates = V.text_files(spark, sf_dir).select("crate").distinct()
    return R.site_counts(crates, scanned)


def corpus_rejects(spark, sf_dir):
    content = F.col("content")
    reason = F.when(F.trim(content) == "", F.lit("empty")).when(
        ~F.endswith(F.rtrim(content), F.lit("</html>")), F.lit("unterminated")
    )
    return S.rejected_files(V.corpus_files(spark, sf_dir), reason)


# ---- oracles ----------------------------------------------------------------------------


def _scan_ctes(view: str, rules: list[S.Rule]) -> list[str]:
    candidates = literal("|".join(f"(?:{r.rx})" for r in rules))

    def case(attribute: str) -> str:
        arms = " ".join(
            f"WHEN regexp_full_match(hit, {literal(r.rx)}) THEN "
            + ("NULL" if getattr(r, attribute) is None else literal(getattr(r, attribute)))
            for r in rules
        )
        return f"CASE {arms} END"

    return [
        f"""file_lines AS (SELECT crate, file, unnest(string_split(content, chr(10))) AS line_text,
  generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {view})""",
        f"""line_hits AS (SELECT crate, file, line, unnest(regexp_extract_all(line_text, {candidates})) AS hit,
  generate_subscripts(regexp_extract_all(line_text, {candidates}), 1) AS seq FROM file_lines)""",
        f"""sites AS (SELECT crate, file, CAST(line AS INTEGER) AS line, CAST(seq AS INTEGER) AS seq,
  {case('kind')} AS kind, {case('pattern')} AS pattern FROM line_hits)""",
    ]


def scan_sql(view: str, rules: list[S.Rule], body: str, *more: str, views: list[str] | None = None) -> str:
    return with_views(views or [view], body, *_scan_ctes(view, rules), *more)


# Sites of each code snippet in text order: (snippet, line within it, kind, pattern).
SNIPPET_SITES = [
    (1, 1, "unsafe_fn", None),
    (1, 2, "operation", "ptr_op"),
    (2, 2, "unsafe_block", "transmute"),
    (2, 2, "operation", "transmute"),
    (4, 1, "unsafe_impl", None),
    (5, 1, "extern_block", None),
    (6, 2, "operation", "unchecked_op"),
    (6, 3, "unsafe_block", None),
    (6, 3, "operation", "ptr_op"),
    (6, 3, "operation", "unchecked_op"),
    (7, 1, "unsafe_block", None),
    (7, 1, "operation", "inline_asm"),
    (8, 2, "unsafe_block", "ptr_op"),
    (8, 3, "operation", "ptr_op"),
    (10, 2, "unsafe_block", "ptr_op"),
    (10, 2, "operation", "ptr_op"),
]


def code_sites_cte(crate: str = "source") -> str:
    n = len(V.CODE_SNIPPETS)
    heights = "[" + ", ".join(str(s.count("\n") + 1) for s in V.CODE_SNIPPETS) + "]"
    known = ", ".join(
        f"({i}, {s}, {line}, {literal(kind)}, {literal(p) if p else 'NULL'})"
        for i, (s, line, kind, p) in enumerate(SNIPPET_SITES)
    )
    return f"""chosen AS (SELECT {crate} AS crate, concat('src/', CAST(doc_id AS VARCHAR), '.rs') AS file, {V.BROKEN_CODE} AS broken,
  doc_id % {n} AS a, doc_id * 7 % {n} AS b, (doc_id // 11) % {n} AS c, {heights} AS h,
  len(string_split(text, chr(10))) AS text_lines FROM documents),
placed AS (
  SELECT crate, file, a AS snippet, 1 AS above FROM chosen WHERE NOT broken
  UNION ALL SELECT crate, file, b, 1 + h[a + 1] + text_lines FROM chosen WHERE NOT broken
  UNION ALL SELECT crate, file, c, 1 + h[a + 1] + text_lines + h[b + 1] FROM chosen WHERE NOT broken),
known(seq, snippet, row_no, kind, pattern) AS (VALUES {known}),
sites AS (SELECT crate, file, CAST(above + row_no AS INTEGER) AS line, seq, kind, pattern
  FROM placed JOIN known USING (snippet))"""


def counters_sql(by_kind: dict[str, str], by_pattern: dict[str, str]) -> str:
    kinds = ", ".join(literal(k) for k in by_kind)
    patterns = ", ".join(literal(p) for p in by_pattern)
    parts = [f"count(*) FILTER (kind = {literal(k)}) AS {name}" for k, name in by_kind.items()]
    parts += [
        f"count(*) FILTER (kind NOT IN ({kinds}) AND pattern = {literal(p)}) AS {name}"
        for p, name in by_pattern.items()
    ]
    parts.append(
        f"count(*) FILTER (kind NOT IN ({kinds}) AND (pattern IS NULL OR pattern NOT IN ({patterns}))) AS other"
    )
    return f"SELECT crate, {', '.join(parts)} FROM sites GROUP BY crate"


QUERIES = {
    "corpus_files": corpus_files,
    "site_scan": site_scan,
    "text_site_scan": text_site_scan,
    "table_site_scan": table_site_scan,
    "code_site_scan": code_site_scan,
    "code_rejects": code_rejects,
    "block_pattern": block_pattern,
    "code_pattern_summary": code_pattern_summary,
    "site_ids": site_ids,
    "pattern_summary": pattern_summary,
    "site_counts": site_counts,
    "corpus_rejects": corpus_rejects,
}

NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY crate ORDER BY file, line, seq) AS number
  FROM sites)"""

# All rules at all places: one alternation of the whole table, then every rule against every match.
_TABLE_SCAN = with_views(
    ["text_files"],
    """SELECT m.crate, m.file, m.line, m.seq, r.rule_id, r.kind, r.pattern FROM named m JOIN rules r USING (rule_id)""",
    """words AS (SELECT item_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS word,
  generate_subscripts(string_split_regex(text, '[^A-Za-z]+'), 1) - 1 AS pos FROM benchmark)""",
    """rules AS (SELECT CAST(min(item_id * 1000 + pos + 10) AS INTEGER) AS rule_id, 'word' AS kind,
  CASE WHEN length(lower(word)) % 3 = 0 THEN 'ending' END AS pattern,
  concat(lower(word), CASE WHEN length(lower(word)) % 3 = 0 THEN '[a-z]+' ELSE '' END) AS rx
  FROM words WHERE length(word) >= 9 GROUP BY lower(word)
  UNION ALL SELECT 1, 'number', NULL, '[0-9]{6,}' UNION ALL SELECT 2, 'number', NULL, '[0-9]+%')""",
    "joined AS (SELECT string_agg(concat('(?:', rx, ')'), '|' ORDER BY rule_id) AS rx FROM rules)",
    """text_lines AS (SELECT crate, file, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line,
  unnest(string_split(content, chr(10))) AS content FROM text_files)""",
    """matches AS (SELECT crate, file, line, unnest(regexp_extract_all(content, joined.rx)) AS match,
  CAST(generate_subscripts(regexp_extract_all(content, joined.rx), 1) AS INTEGER) AS seq FROM text_lines, joined)""",
    """named AS (SELECT crate, file, line, seq, min(rule_id) AS rule_id FROM matches JOIN rules ON regexp_full_match(match, rules.rx)
  GROUP BY ALL)""",
)

ORACLES = {
    "corpus_files": with_views(
        ["corpus_files"],
        "SELECT crate, file, file_id, CAST(length(content) AS INTEGER) AS n_chars FROM corpus_files",
    ),
    "site_scan": scan_sql(
        "corpus_files", S.HTML_RULES, "SELECT crate, file, line, seq, kind, pattern FROM sites"
    ),
    "text_site_scan": scan_sql(
        "text_files", S.TEXT_RULES, "SELECT crate, file, line, seq, kind, pattern FROM sites"
    ),
    "table_site_scan": _TABLE_SCAN,
    "code_rejects": f"WITH {code_sites_cte()}\nSELECT crate, file, 'unbalanced brackets' AS reason FROM chosen WHERE broken",
    "code_site_scan": f"WITH {code_sites_cte()}\nSELECT crate, file, line, kind, pattern FROM sites",
    "block_pattern": f"""WITH {code_sites_cte()}
SELECT crate, file, line, pattern FROM sites WHERE kind = 'unsafe_block'""",
    "code_pattern_summary": f"WITH {code_sites_cte()}\n"
    + counters_sql(R.CODE_COUNTERS_BY_KIND, R.CODE_COUNTERS_BY_PATTERN),
    "site_ids": scan_sql(
        "corpus_files",
        S.HTML_RULES,
        "SELECT crate, printf('U%04d', number) AS site_id, file, line, seq, kind, pattern FROM numbered",
        NUMBERED,
    ),
    "pattern_summary": scan_sql(
        "corpus_files", S.HTML_RULES, counters_sql(R.HTML_COUNTERS_BY_KIND, R.HTML_COUNTERS_BY_PATTERN)
    ),
    "site_counts": scan_sql(
        "text_files",
        S.TEXT_RULES,
        """SELECT f.crate, count(s.kind) AS n_sites FROM (SELECT DISTINCT crate FROM text_files) f
LEFT JOIN sites s ON s.crate = f.crate GROUP BY f.crate""",
    ),
    "corpus_rejects": with_views(
        ["corpus_files"],
        """SELECT * FROM (SELECT crate, file, CASE WHEN trim(content) = '' THEN 'empty'
  WHEN NOT ends_with(rtrim(content), '</html>') THEN 'unterminated' END AS reason FROM corpus_files)
WHERE reason IS NOT NULL""",
    ),
}
