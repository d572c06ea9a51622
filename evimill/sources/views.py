"""Views that give the test tables the shape of the data this package works on.

No test table holds source code or tool logs, so logs, inventories and code files are
derived row by row from the given tables and grow with them. Where an expression reads
the same in Spark and DuckDB it is written once here and used by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Expressions valid in both dialects; k is the integer in events.props.
INTERPRETER_OUTPUT = """CASE k % 6
        WHEN 0 THEN 'test result: ok. 1 passed; 0 failed'
        WHEN 1 THEN 'error: Undefined Behavior: Stacked Borrows retag'
        WHEN 2 THEN 'error: Undefined Behavior: alignment 1, but 8 is required'
        WHEN 3 THEN 'memory access out-of-bounds'
        WHEN 4 THEN 'using uninitialized data'
        ELSE 'test failed: assertion' END"""

RUN_LOG_COLUMNS = {
    "run_id": "event_id",
    "crate": "concat('c', cast(user_id % 12 AS string))",
    "kind": "CASE event_id % 3 WHEN 0 THEN 'geiger' WHEN 1 THEN 'miri' ELSE 'fuzz' END",
    "name": "concat('n', cast(k % 5 AS string))",
    "success": "event_type NOT IN ('error', 'signup')",
    "duration_ms": "cast(round(value * 1000) AS bigint)",
    "combined_output": f"""CASE event_id % 3
      WHEN 0 THEN CASE k % 3
        WHEN 0 THEN concat('warning: x', chr(10),
          '{{"packages":[{{"package":{{"id":{{"name":"dep","source":null}}}},"unsafety":{{"used":{{"exprs":{{"unsafe_":', cast(k % 7 AS string),
          '}}}}}}}},{{"package":{{"id":{{"name":"c', cast(user_id % 12 AS string), '","source":{{"Path":"file:///w/c', cast(user_id % 12 AS string),
          '%230.1.0"}}}}}},"unsafety":{{"used":{{"exprs":{{"unsafe_":', cast(k AS string), '}}}}}}}}]}}',
          CASE k % 4 WHEN 0 THEN concat(chr(10), '{{"packages":[]}} trailing')
            WHEN 1 THEN concat(chr(10), '{{"packages":5}}')
            WHEN 2 THEN concat(chr(10), '{{"packages":[],''x'':1}}') ELSE '' END)
        WHEN 1 THEN concat('thread ''main'' panicked', chr(10), 'assertion failed: self.pending_ids.insert(id)')
        ELSE 'error: failed' END
      WHEN 1 THEN {INTERPRETER_OUTPUT}
      ELSE CASE k % 7
        WHEN 0 THEN concat('INFO: seed', chr(10), 'Done ', cast(event_id AS string), ' runs in ', cast(k AS string), ' second(s)')
        WHEN 1 THEN concat('#1 runs: ', cast(event_id AS string), ' cov: 4')
        WHEN 2 THEN 'panic occurred'
        WHEN 3 THEN 'LeakSanitizer has encountered a fatal error. does not work under ptrace'
        WHEN 4 THEN 'failed to execute fuzz target'
        WHEN 5 THEN 'error: can''t find bin `t` at path `/tmp/x/fuzz_targets/t.rs`'
        ELSE concat('ERROR: libFuzzer: timeout after ', cast(k AS string), ' seconds') END
      END""",
    # what the study says about the run
    "stage": """CASE WHEN event_id % 3 = 2 AND event_type IN ('error', 'signup') AND k % 7 IN (4, 5)
      THEN 'build' ELSE 'run' END""",
    "group_name": "concat('g', cast(k % 3 AS string))",
    "group_ord": "k % 3 * 2 % 3",
    "budget": "CASE k % 4 WHEN 0 THEN cast(30 AS bigint) WHEN 1 THEN cast(300 AS bigint) END",
    "scope": "CASE k % 2 WHEN 0 THEN 'targeted' ELSE 'full_suite' END",
    "dir": "user_id",
}

# Nations as the crates of the study, in an order of their own.
STUDY_COLUMNS = {
    "crate": "concat('c', cast(n_nationkey AS string))",
    "crate_ord": "cast(n_nationkey * 7 % 25 AS bigint)",
    "path": "concat('targets/', lower(n_name))",
    "cohort": "CASE WHEN n_regionkey > 0 THEN concat('cohort', cast(n_regionkey AS string)) END",
}

# The fuzz groups of the study, of which the inventory speaks by number.
PLANNED_GROUP_COLUMNS = {
    "group_id": "group_id",
    "crate": "concat('c', cast(group_id % 12 AS string))",
    "group_name": "concat('planned', cast(group_id AS string))",
    "group_ord": "cast(group_id * 3 % 50 + 10 AS int)",
    "budget": "CASE WHEN group_id % 2 = 0 THEN cast(30 AS bigint) END",
    "take_all": "group_id % 8 = 3",
    "listing_summary": "CASE WHEN group_id = 10 THEN 'cargo fuzz list failed' END",
}

# Interpreter runs of cases: of two events in a row the first is the strict run of a case and the
# second its baseline run, or if it is a view the baseline run of a case without a strict one.
CASE_RUN_COLUMNS = {
    "is_baseline": "event_id % 2 = 1",
    "crate": "concat('c', cast((event_id - event_id % 2) % 24 AS string))",
    "case_name": """concat(CASE WHEN event_id % 2 = 1 AND event_type = 'view' THEN 'other_' ELSE 'case_' END,
      cast(event_id - event_id % 2 AS string))""",
    "scope": "CASE event_id % 4 WHEN 0 THEN 'targeted' ELSE 'full_suite' END",
    "success": RUN_LOG_COLUMNS["success"],
    "duration_ms": RUN_LOG_COLUMNS["duration_ms"],
    "combined_output": INTERPRETER_OUTPUT,
}

# Lines of orders as configured targets of fifty groups, and as what discovery finds: nothing of
# every tenth group, other targets in group 7, every third one elsewhere.
CONFIGURED_COLUMNS = {"group_id": "l_orderkey % 50", "target": "l_partkey", "ordinal": "l_orderkey"}
DISCOVERED_COLUMNS = {
    "group_id": "CASE WHEN l_orderkey % 10 = 0 THEN -1 - l_orderkey % 50 ELSE l_orderkey % 50 END",
    "target": "CASE WHEN l_orderkey % 50 = 7 OR l_suppkey % 3 = 0 THEN -1 - l_partkey ELSE l_partkey END",
}

# Snapshots of artifacts by user and event type. The later one has a new type, and of every third
# user nothing has changed since.
SNAPSHOT_TIME = "TIMESTAMP '2024-01-20 00:00:00'"

GROUP_COLUMNS = {
    "group_id": "o_orderkey",
    "crate_id": "o_custkey",
    "harness_dir": "CASE WHEN o_orderstatus = 'F' OR o_custkey % 4 = 0 THEN 'h' END",
    "time_s": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(round(o_totalprice) AS bigint) % 4000 END",
}

PACKAGE_COLUMNS = {
    "report_id": "l_orderkey",
    "pos": "cast(l_linenumber AS bigint) * 1000000000000000000 + l_partkey * 100000 + l_suppkey % 1000 * 100 + cast(l_quantity AS bigint)",
    "name": "concat('p', cast(l_partkey % 5 AS string))",
    "source_path": "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'file:///w/root%230.1.0' ELSE 'file:///w/other' END",
    "unsafe_exprs": "cast(l_quantity AS bigint)",
}

# Documents as sources of the crates that occur in the run logs, and of one that does not.
REPORT_CRATE = "concat('c', cast(doc_id % 13 AS string))"

# Snippets of source code, chosen per document, which is their comment or text constant.
CODE_SNIPPETS = [
    'pub fn plain(a: &[u8]) -> usize { a.len() }',
    'pub unsafe fn f(p: *const u8) -> u8 {\n    *p\n}',
    'fn g(x: u8) -> i8 {\n    unsafe { std::mem::transmute::<u8, i8>(x) }\n}',
    '// unsafe { *p }\n/* unsafe impl X\n for Y */ const S: &str = "unsafe { *p }";',
    'unsafe impl Send for T {}',
    'extern "C" {\n    fn c();\n}',
    'fn h(xs: &[u8], i: usize) -> u8 {\n    let a = xs[i];\n    unsafe { *xs.get_unchecked(i) + a }\n}',
    'fn k() { unsafe { core::arch::asm!("nop") } }',
    'const R: &str = r#"unsafe { "x" }"#;\nfn w(p: *mut u8) { unsafe\n    { let q = p; if q.is_null() { return; } q.write(1); } }',
    'unsafe trait Q {\n    unsafe fn m(&self);\n    unsafe fn d(&self) { let _x = 1; }\n}',
    'fn deep(p: *mut u8) {\n    unsafe { ' + '{ ' * 9 + '} ' * 9 + '*p; }\n}',
]
# Documents whose file ends in the middle of a function.
BROKEN_CODE = "doc_id % 17 = 5"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(name) for name, e in columns.items()])


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a source tree: one crate per host."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("crate"),
        F.col("url").alias("file"),
        F.col("page_id").alias("file_id"),
        F.col("html").alias("content"),
    )


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the sources of the crates that occur in the run logs."""
    return table(spark, sf_dir, "pages").select(
        F.expr("concat('c', cast(page_id % 13 AS string))").alias("crate"),
        F.col("url").alias("file"),
        F.col("html").alias("content"),
    )


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source tree: one crate per source, one directory per language."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("crate"),
        F.expr("concat(lang, '/', cast(doc_id AS string))").alias("file"),
        F.col("text").alias("content"),
    )


def code_files(spark: SparkSession, sf_dir: str, crate: str = "source") -> DataFrame:
    """One source file per document: three snippets, and its text in the middle of them.

    The text is a comment, a string or a raw string; its first line is a comment on top.
    ``crate`` is an expression.
    """
    snippets, n = F.array(*[F.lit(s) for s in CODE_SNIPPETS]), len(CODE_SNIPPETS)
    chosen = [
        F.element_at(snippets, (F.expr(e) % n + 1).cast("int")) for e in ("doc_id", "doc_id * 7", "doc_id div 11")
    ]
    text, quote = F.coalesce("text", F.lit("")), F.lit('"')
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), quote, F.lit('\\"'))
    carrier = (
        F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("")), F.lit(" */")))
        .when(F.expr("doc_id % 3 = 1"), F.concat(F.lit('const T: &str = "'), escaped, F.lit('";')))
        .otherwise(F.concat(F.lit('const U: &str = r##"'), F.replace(text, F.lit('"##'), F.lit("")), F.lit('"##;')))
    )
    top = F.concat(F.lit("// "), F.substring_index(text, "\n", 1))
    end = F.when(F.expr(BROKEN_CODE), F.lit("fn broken() {"))
    return table(spark, sf_dir, "documents").select(
        F.expr(crate).alias("crate"),
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file"),
        F.concat_ws("\n", top, chosen[0], carrier, chosen[1], chosen[2], end).alias("content"),
    )


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_events(spark, sf_dir), RUN_LOG_COLUMNS)


def strict_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_events(spark, sf_dir), CASE_RUN_COLUMNS).filter("NOT is_baseline").drop("is_baseline")


def baseline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_events(spark, sf_dir), CASE_RUN_COLUMNS).filter("is_baseline").drop("is_baseline")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), CONFIGURED_COLUMNS)


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).distinct()


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What discovery finds, with its repeated rows."""
    return _select(table(spark, sf_dir, "lineitem"), DISCOVERED_COLUMNS)


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "nation"), STUDY_COLUMNS)


def planned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 50 AS group_id").distinct()
    return _select(numbers, PLANNED_GROUP_COLUMNS)


def planned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crate, group_ord, target) of what is configured: a group's number says all of it, so nothing is joined."""
    of_group = [F.expr(PLANNED_GROUP_COLUMNS[name]).alias(name) for name in ("crate", "group_ord")]
    return configured(spark, sf_dir).select(*of_group, "target")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), GROUP_COLUMNS)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), PACKAGE_COLUMNS)


def artifacts_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(
        table(spark, sf_dir, "events"),
        "CASE WHEN event_type = 'signup' THEN 'invitation' ELSE event_type END",
        f"least(ts, {SNAPSHOT_TIME})",
    )


def artifacts_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(
        table(spark, sf_dir, "events"),
        "event_type",
        f"CASE WHEN user_id % 3 = 0 THEN least(ts, {SNAPSHOT_TIME}) ELSE ts END",
    )


def _snapshot(events: DataFrame, path: str, modified: str) -> DataFrame:
    modified = modified.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return events.groupBy(F.col("user_id").alias("dir"), F.expr(path).alias("path")).agg(
        F.max(F.expr(modified)).alias("modified")
    )
