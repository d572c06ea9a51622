"""Configured against discovered targets, harnesses, seeds, artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimill.operators import inventory as I
from evimill.plans.dialect import trim, with_views
from evimill.sources import files
from evimill.sources import views as V


def _groups(spark, sf_dir):
    """Groups of the inventory; some take every target there is."""
    return V.planned_groups(spark, sf_dir).select("group_id", "take_all", "listing_summary")


def discovered_targets(spark, sf_dir):
    logs = V.run_logs(spark, sf_dir)
    return I.discovered_targets(logs, "run_id", F.col("combined_output"))


def discovered_lines(spark, sf_dir):
    """The same over whole documents, as listings of many lines."""
    documents = V.table(spark, sf_dir, "documents")
    return I.discovered_targets(documents, "doc_id", F.col("text"))


def targets_available(spark, sf_dir):
    return I.targets_available(
        _groups(spark, sf_dir), V.configured(spark, sf_dir), V.discovered(spark, sf_dir)
    )


def targets_missing(spark, sf_dir):
    return I.targets_missing(V.configured(spark, sf_dir), V.discovered(spark, sf_dir))


def group_collapse(spark, sf_dir):
    return I.group_collapse(_groups(spark, sf_dir), V.configured(spark, sf_dir), V.listed(spark, sf_dir))


# Pending orders are harnesses of other packages.
_HARNESS_PREFIX = "CASE WHEN o_orderstatus = 'P' THEN 'tool-' WHEN o_orderkey % 3 = 0 THEN 'pkg_' ELSE 'pkg-' END"


def harness_attach(spark, sf_dir):
    """Customers as crates, orders as harness directories."""
    crates = V.table(spark, sf_dir, "customer").select(
        F.expr("concat(CASE c_custkey % 2 WHEN 0 THEN 'pkg_' ELSE 'pkg-' END, cast(c_custkey AS string))").alias("name")
    )
    harnesses = V.table(spark, sf_dir, "orders").select(
        F.expr(f"concat({_HARNESS_PREFIX}, cast(o_custkey * 2 AS string))").alias("name"),
        F.expr("concat('harnesses/', cast(o_orderkey AS string))").alias("path"),
    )
    return I.harness_attach(crates, harnesses)


def _corpus_files(spark, sf_dir, seeds):
    """Lines of orders as files: the accepted returns are seeds, all others lie in the corpus."""
    flag = F.col("l_returnflag") == "A"
    return V.table(spark, sf_dir, "lineitem").filter(flag if seeds else ~flag).select(
        F.expr("l_suppkey").alias("crate"),
        F.expr("l_partkey").alias("target"),
        F.expr("concat(l_returnflag, '-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string))").alias("file"),
    )


def seed_backfill(spark, sf_dir):
    return I.seed_backfill(_corpus_files(spark, sf_dir, False), _corpus_files(spark, sf_dir, True))


def seed_files(spark, sf_dir):
    """Documents as files below a root: two of three lie in the seed corpus of their source."""
    folder = F.when(F.expr("doc_id % 3 = 1"), F.lit("/src/")).otherwise(F.lit("/corpus/"))
    relative = F.concat("source", folder, "lang", F.when(F.expr("doc_id % 5 = 0"), F.lit("")).otherwise(F.lit("/a b")), F.lit("/"), F.col("doc_id"))
    seeds = files.seed_files(V.table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "utf-8")), relative)
    return seeds.select("crate", "target", "file", F.octet_length("content").alias("n_bytes"))


def artifact_changed(spark, sf_dir):
    changed = I.artifacts_changed(V.artifacts_before(spark, sf_dir), V.artifacts_after(spark, sf_dir))
    return changed.select("dir", "path", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified_us"))


def artifact_newest(spark, sf_dir):
    return I.artifact_newest(
        I.artifacts_changed(V.artifacts_before(spark, sf_dir), V.artifacts_after(spark, sf_dir))
    )


QUERIES = {
    "discovered_targets": discovered_targets,
    "discovered_lines": discovered_lines,
    "targets_available": targets_available,
    "targets_missing": targets_missing,
    "group_collapse": group_collapse,
    "harness_attach": harness_attach,
    "seed_backfill": seed_backfill,
    "seed_files": seed_files,
    "artifact_changed": artifact_changed,
    "artifact_newest": artifact_newest,
}

MISSING = "concat('configured fuzz target ', CAST(target AS VARCHAR), ' not present in local workspace')"
INVENTORY = ["configured", "discovered", "inventory_groups"]


def _listing(key: str, text: str, source: str) -> str:
    names = (
        f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {trim('x')}), "
        "lambda x: x <> '' AND NOT starts_with(x, 'warning:'))"
    )
    return (
        f"SELECT {key}, unnest({names}) AS target, "
        f"CAST(generate_subscripts({names}, 1) - 1 AS INTEGER) AS pos FROM {source}"
    )


def _files(test: str) -> str:
    return f"""SELECT l_suppkey AS crate, l_partkey AS target,
  concat(l_returnflag, '-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS file
  FROM lineitem WHERE l_returnflag {test}"""


COLLAPSED = f"""SELECT group_id, CAST(NULL AS BIGINT) AS target, 'skipped' AS status,
  concat('no fuzz targets available: ', CASE WHEN n_discovered > 0
    THEN 'configured fuzz targets not present in local workspace'
    WHEN group_id = 10 THEN 'cargo fuzz list failed' ELSE 'no fuzz targets discovered' END) AS summary
FROM judged WHERE n_run = 0
UNION ALL
SELECT group_id, target, 'skipped', {MISSING} FROM marked JOIN judged USING (group_id)
WHERE n_run > 0 AND NOT take_all AND NOT present"""
COLLAPSE_CTES = [
        """marked AS (SELECT c.group_id, c.target, (c.group_id, c.target) IN (SELECT (group_id, target) FROM discovered) AS present
  FROM configured c)""",
        """judged AS (SELECT group_id, take_all, n_discovered, CASE WHEN take_all THEN n_discovered ELSE n_available END AS n_run
  FROM (SELECT group_id, take_all,
    (SELECT count(*) FROM discovered d WHERE d.group_id = g.group_id) AS n_discovered,
    (SELECT count(*) FROM marked m WHERE m.group_id = g.group_id AND m.present) AS n_available
    FROM inventory_groups g))""",
]

CHANGED = """changed AS (SELECT a.dir, a.path, a.modified FROM artifacts_after a
  LEFT JOIN artifacts_before b ON b.dir = a.dir AND b.path = a.path
  WHERE b.path IS NULL OR a.modified > b.modified)"""

ORACLES = {
    "discovered_targets": with_views(["run_logs"], _listing("run_id", "combined_output", "run_logs")),
    "discovered_lines": _listing("doc_id", "text", "documents"),
    "targets_available": with_views(
        INVENTORY,
        """SELECT group_id, target FROM configured c
WHERE EXISTS (SELECT 1 FROM discovered d WHERE d.group_id = c.group_id AND d.target = c.target)
  AND NOT (SELECT take_all FROM inventory_groups g WHERE g.group_id = c.group_id)
UNION ALL SELECT group_id, target FROM discovered JOIN inventory_groups USING (group_id) WHERE take_all""",
    ),
    "targets_missing": with_views(
        ["configured", "discovered"],
        f"""SELECT group_id, target, 'skipped' AS status, {MISSING} AS summary FROM configured c
WHERE NOT EXISTS (SELECT 1 FROM discovered d WHERE d.group_id = c.group_id AND d.target = c.target)""",
    ),
    "group_collapse": with_views(
        INVENTORY,
        COLLAPSED,
        *COLLAPSE_CTES,
    ),
    "harness_attach": """WITH crates AS (
  SELECT concat(CASE c_custkey % 2 WHEN 0 THEN 'pkg_' ELSE 'pkg-' END, CAST(c_custkey AS VARCHAR)) AS name FROM customer),
harnesses AS (
  SELECT concat({prefix}, CAST(o_custkey * 2 AS VARCHAR)) AS name,
    concat('harnesses/', CAST(o_orderkey AS VARCHAR)) AS path FROM orders)
SELECT c.name, min(h.path) AS harness_dir FROM crates c
LEFT JOIN harnesses h ON replace(h.name, '_', '-') = replace(c.name, '_', '-') GROUP BY c.name""".format(prefix=_HARNESS_PREFIX),
    "seed_backfill": f"""WITH corpus AS ({_files("<> 'A'")}), seeds AS ({_files("= 'A'")})
SELECT * FROM corpus UNION ALL SELECT * FROM seeds s
WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.crate = s.crate AND c.target = s.target)""",
    "seed_files": """SELECT source AS crate, lang AS target,
  concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'a b/' END, CAST(doc_id AS VARCHAR)) AS file, CAST(strlen(text) AS INTEGER) AS n_bytes
FROM documents WHERE doc_id % 3 <> 1""",
    "artifact_changed": with_views(
        ["artifacts_before", "artifacts_after"],
        "SELECT dir, path, epoch_us(modified) AS modified_us FROM changed",
        CHANGED,
    ),
    "artifact_newest": with_views(
        ["artifacts_before", "artifacts_after"],
        """SELECT dir, path FROM changed
QUALIFY row_number() OVER (PARTITION BY dir ORDER BY modified DESC, path DESC) = 1""",
        CHANGED,
    ),
}
