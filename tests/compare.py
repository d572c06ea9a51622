"""Side-by-side check of queries and their DuckDB counterparts.

``python tests/compare.py [sf] [name ..]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def data_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else value
    return value


def _type_name(arrow_type) -> str:
    return str(arrow_type).replace("large_", "").replace("string_view", "string")


def _bag(arrow_table) -> tuple[list[str], dict[str, str], Counter]:
    names = sorted(arrow_table.column_names)
    types = {n: _type_name(arrow_table.schema.field(n).type) for n in names}
    columns = [[_plain(v) for v in arrow_table.column(n).to_pylist()] for n in names]
    return names, types, Counter(zip(*columns)) if columns else Counter()


def differences(spark_df, con, sql: str) -> tuple[int, list[str]]:
    """Row count of the query, and what differs from the SQL."""
    left, right = _bag(spark_df.toArrow()), _bag(con.sql(sql).to_arrow_table())
    rows = sum(left[2].values())
    if left[0] != right[0]:
        return rows, [f"columns {left[0]} != {right[0]}"]
    found = [f"type of {n}: {left[1][n]} != {right[1][n]}" for n in left[0] if left[1][n] != right[1][n]]
    if left[2] != right[2]:
        extra, lacking = left[2] - right[2], right[2] - left[2]
        found.append(f"{sum(extra.values())} rows only in Spark, e.g. {list(extra)[:2]}")
        found.append(f"{sum(lacking.values())} rows only in SQL, e.g. {list(lacking)[:2]}")
    return rows, found


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from evimill.session import local_session

    sf_dir = data_dir(argv[0] if argv else "0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                rows, found = differences(query(spark, sf_dir), con, oracles[name])
            else:
                rows, found = query(spark, sf_dir).count(), []
            verdict = "ok" if not found else "DIFF"
        except Exception as error:  # reported, not hidden: one bad query must not stop the list
            rows, found, verdict = -1, [str(error)[:1200]], "FAIL"
        failed += verdict != "ok"
        kind = "" if name in oracles else " (no oracle)"
        print(f"{verdict:5} {name:28} {rows:8} rows {time.time() - start:6.2f}s{kind}")
        for line in found:
            print("      ", line[:1500])
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
