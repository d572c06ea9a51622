"""Study tables: entries, defaults, budgets, environments, plan order, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimill.functions import text as T
from evimill.functions.vocabulary import PROFILE_CAPS
from evimill.operators import study_plan as P
from evimill.plans.dialect import with_views
from evimill.sources import views as V
from evimill.sources.files import STUDY_CRATE_SCHEMA

ENV_SETTINGS = ["A", "B", "C", "D"]


def manifests(spark, sf_dir):
    """Parts as crates of a study, one JSON text each: up to three cases and three groups."""
    numbers = F.sequence(F.lit(1), F.lit(3))
    cases = F.transform(
        F.filter(numbers, lambda i: i <= F.col("p_size") % 4),
        lambda i: F.struct(
            F.concat(F.lit("case"), i).alias("name"),
            F.when(i != 2, F.lit("targeted")).alias("scope"),
            F.when((i + F.col("p_partkey")) % 2 == 0, F.concat(F.lit("harness/"), F.col("p_partkey"))).alias("harness_dir"),
            F.when(i > 1, i == 3).alias("exact"),
            F.lit("tier1").alias("coverage_tier"),
        ),
    )
    groups = F.transform(
        F.filter(numbers, lambda i: i <= F.col("p_partkey") % 4),
        lambda i: F.struct(
            F.concat(F.lit("group"), i).alias("name"),
            F.when(i == 2, F.lit("harness")).alias("harness_dir"),
            F.when(i == 3, F.lit(True)).alias("all"),
            F.when(i < 3, F.array(F.concat(F.lit("t"), i), F.col("p_type"))).alias("targets"),
            F.when(F.col("p_size") > 10, F.col("p_size") * 100).alias("time"),
        ),
    )
    document = F.struct(
        F.concat(F.lit("pkg"), F.col("p_partkey")).alias("name"),
        F.concat(F.lit("targets/"), F.col("p_partkey")).alias("path"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("cohort"),
        F.lit("tier1").alias("coverage_tier"),
        cases.alias("miri_case"),
        groups.alias("fuzz_group"),
    )
    return V.table(spark, sf_dir, "part").select(F.to_json(document).alias("manifest"))


def _study(spark, sf_dir):
    parsed = F.from_json("manifest", STUDY_CRATE_SCHEMA)
    return manifests(spark, sf_dir).select(parsed.alias("c")).select("c.*")


def study_explode(spark, sf_dir):
    return P.study_entries(_study(spark, sf_dir))


def plan_defaults(spark, sf_dir):
    cases = P.study_cases(_study(spark, sf_dir)).select(
        "crate", F.lit("case").alias("entry"), "ordinal", "scope", "exact",
        F.lit(None).cast("boolean").alias("take_all"), F.lit(None).cast("int").alias("n_targets"),
    )
    groups = P.study_groups(_study(spark, sf_dir)).select(
        "crate", F.lit("group").alias("entry"), "ordinal",
        F.lit(None).cast("string").alias("scope"), F.lit(None).cast("boolean").alias("exact"),
        "take_all", F.size("targets").alias("n_targets"),
    )
    return cases.unionByName(groups).withColumn("jobs", P.job_count(F.col("ordinal")))


def group_targets(spark, sf_dir):
    return P.group_targets(P.study_groups(_study(spark, sf_dir)))


def budget_cap(spark, sf_dir):
    groups = V.groups(spark, sf_dir)
    time = F.col("time_s")
    return groups.select(
        "group_id",
        P.capped_budget(time, "smoke").alias("smoke"),
        P.capped_budget(time, "baseline").alias("baseline"),
        P.capped_budget(time, "full").alias("full"),
        P.effective_budget(
            F.when(F.col("group_id") % 3 == 0, time), F.when(F.col("group_id") % 5 == 0, F.lit(7)),
            F.when(F.col("group_id") % 2 == 0, time + 1), "full",
        ).alias("effective"),
    )


def _env_layers():
    one = F.lit(1)
    study = F.create_map(F.lit("A"), F.col("o_orderstatus"), F.lit("B"), F.col("o_orderpriority"))
    group = F.when(
        F.col("o_orderkey") % 3 > 0,
        F.create_map(F.lit("B"), F.concat(F.lit("g"), F.col("o_custkey")), F.lit("C"), F.lit("group")),
    )
    cli = F.when(
        F.col("o_orderkey") % 2 == one,
        F.create_map(F.lit("D"), F.col("o_orderstatus"), F.lit("C"), F.lit("cli")),
    )
    return study, group, cli


def env_overlay(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.env_text(T.env_overlay(*_env_layers())).alias("env"))


def env_parse(spark, sf_dir):
    settings = V.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr(
            """CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_brand, '=', p_type)
            WHEN 2 THEN concat('=', p_type) ELSE concat(p_brand, '=', p_type, '=', p_name) END"""
        ).alias("setting"),
    )
    pair = T.env_pair(F.col("setting"))
    return settings.select(
        "p_partkey", pair["key"].alias("key"), pair["value"].alias("value"),
        F.when(pair.isNull(), F.col("setting")).alias("rejected"),
    )


def _entries(spark, sf_dir):
    """Orders as entries of customers; those of every ninth customer name a crate there is not."""
    owner = F.expr("CASE WHEN crate_id % 9 = 4 THEN -crate_id ELSE crate_id END")
    return V.groups(spark, sf_dir).withColumn("crate_id", owner)


def default_injection(spark, sf_dir):
    """Customers as crates, orders as their cases; every ninth crate has none."""
    crates = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crate_id"))
    cases = _entries(spark, sf_dir).select(
        "crate_id", F.concat(F.lit("o"), F.col("group_id")).alias("name"), F.lit("targeted").alias("scope"), "harness_dir",
    )
    return P.inject_defaults(crates, cases, P.DEFAULT_CASE)


def default_injection_groups(spark, sf_dir):
    """The same for fuzz groups, which need a fuzz workspace in the crate."""
    crates = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("crate_id"), (F.col("c_custkey") % 2 == 0).alias("has_workspace")
    )
    groups = _entries(spark, sf_dir).select(
        "crate_id", F.concat(F.lit("o"), F.col("group_id")).alias("name"), "harness_dir", F.lit(False).alias("take_all"),
        F.lit(None).cast("string").alias("budget_label"),
    )
    return P.inject_defaults(crates, groups, P.DEFAULT_GROUP, F.col("has_workspace"))


# Two of three customers have no harness of their own.
_OWN_HARNESS = "CASE WHEN crate_id % 3 = 0 THEN harness_dir END"


def harness_groups(spark, sf_dir):
    """Orders as groups of customers; suppliers name the harness directories."""
    crates = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("crate_id"), F.concat(F.lit("pkg_"), F.col("c_custkey")).alias("name")
    )
    groups = V.groups(spark, sf_dir).select(
        "crate_id", F.concat(F.lit("o"), F.col("group_id")).alias("name"),
        F.expr(_OWN_HARNESS).alias("harness_dir"),
    )
    harnesses = V.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("pkg-"), F.col("s_suppkey") * 3).alias("name"), F.concat(F.lit("harnesses/"), F.col("s_name")).alias("path")
    )
    return P.attach_harness_groups(crates, groups, harnesses)


def single_crate_plan(spark, sf_dir):
    """Groups of customers taken as crates without a study."""
    crates = V.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "crate_id")
    env = F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("ASAN_OPTIONS"), F.col("c_mktsegment")))
    seconds = P.capped_budget(F.col("c_nationkey").cast("bigint") * 20, "baseline")
    _, groups = P.single_crate_entries(crates, seconds, env)
    return groups.withColumn("env", T.env_text(F.col("env")))


def plan_order(spark, sf_dir):
    entries = V.groups(spark, sf_dir).select("crate_id", F.col("group_id").alias("ordinal"), "harness_dir")
    return P.plan_order(entries)


def phase_select(spark, sf_dir):
    runs = V.run_logs(spark, sf_dir)
    return P.select_phases(runs, ["miri", "fuzz"]).select("run_id", "crate", "kind")


def crate_select(spark, sf_dir):
    """Logs of the crates the pages of French sites name; other names are ignored."""
    names = (
        V.table(spark, sf_dir, "pages")
        .filter(F.col("url").contains("/fr/"))
        .select(F.expr("concat('c', cast(page_id % 19 AS string))").alias("crate"))
    )
    return P.select_crates(V.run_logs(spark, sf_dir), names).select("run_id", "crate", "name")


QUERIES = {
    "study_explode": study_explode,
    "plan_defaults": plan_defaults,
    "group_targets": group_targets,
    "budget_cap": budget_cap,
    "env_overlay": env_overlay,
    "env_parse": env_parse,
    "default_injection": default_injection,
    "default_injection_groups": default_injection_groups,
    "harness_groups": harness_groups,
    "single_crate_plan": single_crate_plan,
    "plan_order": plan_order,
    "phase_select": phase_select,
    "crate_select": crate_select,
}

_CASES = """cases AS (SELECT p.*, i FROM part p, unnest(range(1, p_size % 4 + 1)) AS u(i))"""
_GROUPS = """fuzz_groups AS (SELECT p.*, i FROM part p, unnest(range(1, p_partkey % 4 + 1)) AS u(i))"""


def _cap(expr: str, profile: str) -> str:
    cap = PROFILE_CAPS.get(profile)
    if cap is None:
        return expr
    return f"CASE WHEN {expr} IS NULL OR {expr} > {cap} THEN CAST({cap} AS BIGINT) ELSE {expr} END"


_EFFECTIVE = """coalesce(CASE WHEN group_id % 3 = 0 THEN time_s END, CASE WHEN group_id % 5 = 0 THEN 7 END,
  CASE WHEN group_id % 2 = 0 THEN time_s + 1 END, 60)"""

_ENTRIES = """entries AS (SELECT * REPLACE (CASE WHEN crate_id % 9 = 4 THEN -crate_id ELSE crate_id END AS crate_id) FROM groups)"""
_INJECTED = """added AS (SELECT c_custkey AS crate_id FROM customer c
  WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.crate_id = c.c_custkey AND e.harness_dir IS NULL){also})"""

ORACLES = {
    "study_explode": f"""WITH {_CASES}, {_GROUPS}, entries AS (
  SELECT p_partkey, 'case' AS entry, i, concat('case', i) AS name,
    CASE WHEN (i + p_partkey) % 2 = 0 THEN concat('harness/', p_partkey) END AS harness_dir FROM cases
  UNION ALL SELECT p_partkey, 'group', i, concat('group', i), CASE WHEN i = 2 THEN 'harness' END FROM fuzz_groups)
SELECT concat('pkg', p.p_partkey) AS crate, CASE WHEN p_size % 3 > 0 THEN p_brand END AS cohort,
  entry, CAST(i - 1 AS INTEGER) AS ordinal, name, harness_dir
FROM part p LEFT JOIN entries e ON e.p_partkey = p.p_partkey""",
    "plan_defaults": f"""WITH {_CASES}, {_GROUPS}
SELECT concat('pkg', p_partkey) AS crate, 'case' AS entry, CAST(i - 1 AS INTEGER) AS ordinal,
  CASE WHEN i = 2 THEN 'unspecified' ELSE 'targeted' END AS scope, i = 3 AS exact,
  CAST(NULL AS BOOLEAN) AS take_all, CAST(NULL AS INTEGER) AS n_targets, CAST(greatest(i - 1, 1) AS INTEGER) AS jobs FROM cases
UNION ALL
SELECT concat('pkg', p_partkey), 'group', CAST(i - 1 AS INTEGER), NULL, NULL, i = 3, CASE WHEN i < 3 THEN 2 ELSE 0 END,
  CAST(greatest(i - 1, 1) AS INTEGER)
FROM fuzz_groups""",
    "group_targets": f"""WITH {_GROUPS}
SELECT concat('pkg', p_partkey) AS crate, concat('group', i) AS group_name, CAST(0 AS INTEGER) AS ordinal,
  concat('t', i) AS target FROM fuzz_groups WHERE i < 3
UNION ALL SELECT concat('pkg', p_partkey), concat('group', i), 1, p_type FROM fuzz_groups WHERE i < 3""",
    "budget_cap": with_views(
        ["groups"],
        f"""SELECT group_id, {_cap('time_s', 'smoke')} AS smoke, {_cap('time_s', 'baseline')} AS baseline,
  time_s AS "full", {_EFFECTIVE} AS effective FROM groups""",
    ),
    "env_overlay": """WITH s AS (SELECT o_orderkey, o_orderstatus AS a,
    CASE WHEN o_orderkey % 3 > 0 THEN concat('g', o_custkey) ELSE o_orderpriority END AS b,
    CASE WHEN o_orderkey % 2 = 1 THEN 'cli' WHEN o_orderkey % 3 > 0 THEN 'group' END AS c,
    CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS d FROM orders)
SELECT o_orderkey, concat('A=', a, ', B=', b, CASE WHEN c IS NOT NULL THEN concat(', C=', c) ELSE '' END,
  CASE WHEN d IS NOT NULL THEN concat(', D=', d) ELSE '' END) AS env FROM s""",
    "env_parse": """WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_brand, '=', p_type)
    WHEN 2 THEN concat('=', p_type) ELSE concat(p_brand, '=', p_type, '=', p_name) END AS setting FROM part)
SELECT p_partkey, CASE WHEN contains(setting, '=') THEN split_part(setting, '=', 1) END AS key,
  CASE WHEN contains(setting, '=') THEN regexp_extract(setting, '^[^=]*=(.*)$', 1) END AS value,
  CASE WHEN NOT contains(setting, '=') THEN setting END AS rejected FROM s""",
    "default_injection": with_views(
        ["groups"],
        """SELECT crate_id, concat('o', group_id) AS name, 'targeted' AS scope, harness_dir, false AS injected FROM entries
UNION ALL SELECT crate_id, 'upstream_full', 'full_suite', NULL, true FROM added""",
        _ENTRIES,
        _INJECTED.format(also=""),
    ),
    "default_injection_groups": with_views(
        ["groups"],
        """SELECT crate_id, concat('o', group_id) AS name, harness_dir, false AS take_all,
  CAST(NULL AS VARCHAR) AS budget_label, false AS injected FROM entries
UNION ALL SELECT crate_id, 'existing_targets', NULL, true, 'default', true FROM added""",
        _ENTRIES,
        _INJECTED.format(
            also="""
  AND (c_custkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM entries e WHERE e.crate_id = c.c_custkey))"""
        ),
    ),
    "harness_groups": with_views(
        ["groups"],
        """SELECT crate_id, name, harness_dir, CAST(NULL AS BOOLEAN) AS take_all, CAST(NULL AS VARCHAR) AS budget_label FROM own
UNION ALL
SELECT c_custkey, 'harness_targets', min(concat('harnesses/', s_name)), true, 'harness'
FROM customer JOIN supplier ON s_suppkey * 3 = c_custkey
WHERE c_custkey NOT IN (SELECT crate_id FROM own WHERE harness_dir IS NOT NULL) GROUP BY c_custkey""",
        f"""own AS (SELECT crate_id, concat('o', group_id) AS name, {_OWN_HARNESS} AS harness_dir FROM groups)""",
    ),
    "single_crate_plan": """SELECT c_custkey AS crate_id, 'existing_targets' AS name, true AS take_all, 'single_crate' AS budget_label,
  CAST(least(c_nationkey * 20, 300) AS BIGINT) AS time_s,
  concat('ASAN_OPTIONS=', CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'detect_leaks=0' END) AS env FROM customer""",
    "plan_order": with_views(
        ["groups"],
        """SELECT crate_id, row_number() OVER (PARTITION BY crate_id ORDER BY harness_dir IS NOT NULL, group_id) AS position,
  group_id AS ordinal, harness_dir, CAST(harness_dir IS NOT NULL AS INTEGER) AS stage FROM groups""",
    ),
    "phase_select": with_views(
        ["run_logs"], "SELECT run_id, crate, kind FROM run_logs WHERE kind IN ('miri', 'fuzz')"
    ),
    "crate_select": with_views(
        ["run_logs"],
        """SELECT run_id, crate, name FROM run_logs WHERE crate IN
  (SELECT concat('c', CAST(page_id % 19 AS VARCHAR)) FROM pages WHERE contains(url, '/fr/'))""",
    ),
}
