import math
from collections import defaultdict

import numpy as np
import pytest
from evimill.llm import near_profiles
from evimill.operators import site_scan
from evimill.sources.views import table
from pyspark.sql import functions as F

SCHEMA = "file_id bigint, cohort string, profile array<double>, size string, id string, root string, links string, kept string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, c, v, *["x"] * 5) for i, c, v in rows], schema)


def slow(rows, threshold=0.98):
    """(n_links, component_id) for each row, pair by pair."""
    parent, counts = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, c, u) in enumerate(rows):
        for j in range(i):
            if c is None or rows[j][1] != c or len(u) != len(rows[j][2]):
                continue
            v = rows[j][2]
            lengths = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
            if sum(x * y for x, y in zip(u, v, strict=True)) / lengths >= threshold:
                counts[i] += 1
                counts[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    return [(counts[k], min(groups[root(k)])) for k in range(len(rows))]


def compare(rows, found):
    wanted = slow(rows)
    got = {r["file_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert len(found) == len(rows)
    assert got == {row[0]: (*w, row[0] == w[1]) for row, w in zip(rows, wanted, strict=True)}


def clusters(draw, n, d, spread):
    """Vectors around centres, so that many cosines lie on either side of the threshold."""
    centres = draw.normal(size=(max(1, n // 8), d))
    return [(centres[k % len(centres)] + spread * draw.normal(size=d)).tolist() for k in range(n)]


@pytest.mark.parametrize("block", [2048, 40])
def test_matches_brute_force(spark, block):
    draw = np.random.default_rng(8)
    vectors = clusters(draw, 300, 16, 0.14) + clusters(draw, 60, 3, 0.1)
    rows = [(k, "ab"[k % 2] if k % 7 else None, v) for k, v in enumerate(vectors)]
    rows += [(1000 + k, "a", rows[1][2]) for k in range(30)]  # equal profiles
    assert len({w[0] for w in slow(rows)}) > 4
    compare(rows, near_profiles.near_profiles(frame(spark, rows).repartition(4), block=block).collect())


def test_bounds_hold_and_spare_most_pairs():
    draw = np.random.default_rng(9)
    for d in (1, 2, 64, 1500):
        vectors = np.concatenate([draw.normal(size=(150, d)), np.array(clusters(draw, 150, d, 0.14))])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        codes = near_profiles.Codes.of(unit)
        about, bound = codes.products(codes)
        assert (np.abs(about - unit @ unit.T) <= bound).all()
        everything = slice(0, len(vectors))
        near, again = near_profiles.linked(vectors, codes, everything, everything, 0.98)
        assert (near == (unit @ unit.T >= 0.98)).all()
        if d == 64:
            assert 0 < again < len(vectors) ** 2 / 20 and bound.max() < 0.05
    outlier = np.array([[1.0, 1e-9, 0, 0], [1.0, 0, 0, 0], [1e-9, 1.0, 0, 0]])
    assert near_profiles.Codes.of(outlier).codes.tolist() == [[127, 0, 0, 0], [127, 0, 0, 0], [0, 127, 0, 0]]


def test_crowd_gives_few_joins():
    draw = np.random.default_rng(10)
    crowd = 5 + draw.normal(size=(600, 32)) * 0.05
    counts, joins = near_profiles.tile(np.arange(600), np.ones(600, dtype=np.int64), 600, crowd, 0.98)
    assert set(counts.values()) == {599} and len(joins) == 599


def test_profiles_of_scanned_files(spark):
    """Files by the counters of their sites, within crates."""
    pages = table(spark, "/root/testdata/sf0.001", "pages").select(
        F.lit("pages").alias("crate"), F.col("page_id").alias("file"), F.col("html").alias("content")
    )
    sites = site_scan.site_rows(site_scan.scan_files(pages, site_scan.HTML_RULES), site_scan.HTML_RULES)
    names = ["script", "link", "entity", "style"]
    wide = sites.groupBy("crate", "file").pivot("pattern", names).count().na.fill(0)
    counted = wide.select(
        F.col("file").alias("file_id"), F.col("crate").alias("cohort"), F.array(*(F.col(n).cast("double") for n in names)).alias("profile")
    )
    rows = [(r["file_id"], r["cohort"], r["profile"]) for r in counted.collect() if any(r["profile"])]
    found = near_profiles.near_profiles(counted).collect()
    compare(rows, [r for r in found if r["file_id"] in {i for i, _, _ in rows}])
    assert len(found) == counted.count() and any(r["n_links"] for r in found)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (2, "a", [2.0, 0.0]), (3, None, [1.0, 0.0]), (4, "a", None),
        (5, "a", [nan, 1.0]), (6, "a", [inf, 0.0]), (7, "a", [0.0, 0.0]), (8, "a", [None, 1.0]), (9, "a", [1.0]), (10, "a", []),
        (None, "a", [3.0, 0.0]), (None, "b", [1.0, 1.0]), (11, "b", [-1.0, -1.0]), (12, "c", [1e200, 1e200]), (13, "c", [1e-200, 1e-200]),
    ]
    found = near_profiles.near_profiles(frame(spark, rows)).collect()
    got = sorted((r["file_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found)
    assert got == [
        (0, 0, 0, True), (0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False),
        *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)), (12, 1, 12, True), (13, 1, 12, False),
    ]
    assert not near_profiles.near_profiles(frame(spark, [])).collect()
    floats = near_profiles.near_profiles(frame(spark, [(1, "a", [1.0, 2.0]), (2, "a", [1.0, 2.0])], SCHEMA.replace("double", "float")))
    assert sorted((r["file_id"], r["n_links"]) for r in floats.collect()) == [(1, 1), (2, 1)]
