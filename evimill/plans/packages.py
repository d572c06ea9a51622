"""Package metrics: root packages, counts, file URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimill.functions import text as T
from evimill.operators import evidence as E
from evimill.plans.dialect import with_views
from evimill.sources import views as V

ROOT_NAME, ROOT_PATH = "p3", "/w/root"


def package_root(spark, sf_dir):
    return E.package_root(V.packages(spark, sf_dir), F.lit(ROOT_NAME), F.lit(ROOT_PATH))


def package_metrics(spark, sf_dir):
    return E.package_metrics(V.packages(spark, sf_dir), F.lit(ROOT_NAME), F.lit(ROOT_PATH))


def file_url_path(spark, sf_dir):
    """URLs made from part names: encoded, with a plus sign, of another scheme, malformed."""
    urls = V.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr(
            """CASE p_partkey % 7
            WHEN 0 THEN concat('file:///w/', replace(p_name, ' ', '%20'), '%23', cast(p_size AS string))
            WHEN 1 THEN concat('http://host/', p_name)
            WHEN 2 THEN concat('file:///a+b/', cast(p_partkey AS string), '#', p_brand)
            WHEN 3 THEN 'file:///bad%zz'
            WHEN 4 THEN concat('file:///end/', p_type, '%4')
            WHEN 5 THEN concat('file:///s%C3%A9/', p_type)
            ELSE concat('file:///plain/', p_name, '%') END"""
        ).alias("url"),
    )
    return urls.select("p_partkey", T.file_url_path(F.col("url")).alias("path"))


QUERIES = {
    "package_root": package_root,
    "package_metrics": package_metrics,
    "file_url_path": file_url_path,
}

_RANKED = f"""ranked AS (SELECT *, CASE WHEN name <> '{ROOT_NAME}' THEN NULL
    WHEN source_path IS NULL OR source_path = 'file://{ROOT_PATH}%230.1.0' THEN 1 ELSE 2 END AS tier FROM packages),
roots AS (SELECT report_id, pos, tier, unsafe_exprs FROM ranked WHERE tier IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY tier, pos) = 1)"""

ORACLES = {
    "package_root": with_views(["packages"], "SELECT report_id, pos, tier FROM roots", _RANKED),
    "package_metrics": with_views(
        ["packages"],
        """SELECT p.report_id, max(r.unsafe_exprs) AS root_unsafe,
  CASE WHEN max(r.pos) IS NOT NULL THEN CAST(coalesce(sum(p.unsafe_exprs) FILTER (p.pos <> r.pos), 0) AS BIGINT) END
    AS dependency_unsafe
FROM packages p LEFT JOIN roots r ON r.report_id = p.report_id GROUP BY p.report_id""",
        _RANKED,
    ),
    "file_url_path": """SELECT p_partkey, CASE p_partkey % 7
  WHEN 0 THEN concat('/w/', p_name) WHEN 1 THEN NULL WHEN 2 THEN concat('/a+b/', p_partkey)
  WHEN 3 THEN NULL WHEN 4 THEN concat('/end/', p_type, '%4') WHEN 5 THEN concat('/s', chr(233), '/', p_type)
  ELSE concat('/plain/', p_name, '%') END AS path FROM part""",
}
