"""Pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations

from evimill.functions.vocabulary import WHITESPACE
from evimill.sources import views as V


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def columns(exprs: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} AS {name}" for name, e in exprs.items())


SPACE = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"

EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def ascii_lower(expr: str) -> str:
    return f"translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def trim(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({ascii_lower(expr)}, {literal(w)})" for w in words) + ")"


def contains_all(expr: str, words: list[str]) -> str:
    return "(" + " AND ".join(f"contains({ascii_lower(expr)}, {literal(w)})" for w in words) + ")"


VIEWS = {
    "corpus_files": """SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS crate, url AS file,
  page_id AS file_id, html AS content FROM pages""",
    "report_files": """SELECT concat('c', CAST(page_id % 13 AS VARCHAR)) AS crate, url AS file,
  html AS content FROM pages""",
    "text_files": """SELECT source AS crate, concat(lang, '/', CAST(doc_id AS VARCHAR)) AS file,
  text AS content FROM documents""",
    "run_logs": f"SELECT {columns(V.RUN_LOG_COLUMNS)} FROM {EVENTS}",
    "strict_runs": f"SELECT {columns(V.CASE_RUN_COLUMNS)} FROM {EVENTS} WHERE event_id % 2 = 0",
    "baseline_runs": f"SELECT {columns(V.CASE_RUN_COLUMNS)} FROM {EVENTS} WHERE event_id % 2 = 1",
    "configured_once": f"""SELECT DISTINCT group_id, target FROM (SELECT {columns(V.CONFIGURED_COLUMNS)} FROM lineitem)""",
    "configured": f"SELECT {columns(V.CONFIGURED_COLUMNS)} FROM lineitem",
    "discovered": f"SELECT DISTINCT {columns(V.DISCOVERED_COLUMNS)} FROM lineitem",
    "inventory_groups": """SELECT DISTINCT l_orderkey % 50 AS group_id, l_orderkey % 50 % 8 = 3 AS take_all
  FROM lineitem""",
    "study": f"SELECT {columns(V.STUDY_COLUMNS)} FROM nation",
    "planned_groups": f"""SELECT {columns(V.PLANNED_GROUP_COLUMNS)}
  FROM (SELECT DISTINCT l_orderkey % 50 AS group_id FROM lineitem)""",
    "groups": f"SELECT {columns(V.GROUP_COLUMNS)} FROM orders",
    "packages": f"SELECT {columns(V.PACKAGE_COLUMNS)} FROM lineitem",
    "artifacts_before": f"""SELECT user_id AS dir, CASE WHEN event_type = 'signup' THEN 'invitation' ELSE event_type END AS path,
  max(least(ts, {V.SNAPSHOT_TIME})) AS modified FROM events GROUP BY ALL""",
    "artifacts_after": f"""SELECT user_id AS dir, event_type AS path,
  max(CASE WHEN user_id % 3 = 0 THEN least(ts, {V.SNAPSHOT_TIME}) ELSE ts END) AS modified FROM events GROUP BY ALL""",
}


def with_views(names: list[str], body: str, *more: str) -> str:
    """``body`` with the named views, and further CTEs, in front."""
    ctes = [f"{name} AS ({VIEWS[name]})" for name in names] + list(more)
    return f"WITH {', '.join(ctes)}\n{body}"
