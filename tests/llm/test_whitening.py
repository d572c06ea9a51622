import math
import random
from fractions import Fraction

import numpy as np
import pytest
from evimill.llm import spectrum, whitening
from evimill.operators import site_scan
from evimill.sources.views import table
from pyspark.sql import functions as F

SCHEMA = "file_id bigint, counters array<bigint>, n string, component string, deviation string"


def profiles(spark, rows):
    return spark.createDataFrame([(i, c, "x", "x", "x") for i, c in rows], SCHEMA)


def slow_polynomial(a):
    """Characteristic polynomial, lowest first, by the traces of powers in fractions."""
    d = len(a)
    m, found = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (found[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        found.append(-sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(c) for c in reversed(found)]


def psd(draw, d, rank, most=50):
    rows = [[draw.randint(-most, most) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


def exact_polynomial(a):
    primes = spectrum.moduli(2 * spectrum.coefficient_bound(a))
    return spectrum.combined(primes, spectrum.residues(a, primes).tolist())


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (5, 5), (7, 3), (9, 12), (4, 0)])
def test_polynomial_is_exact(d, rank):
    a = psd(random.Random(d), d, rank)
    assert exact_polynomial(a) == slow_polynomial(a)
    sparse = [[7 if i == j else 0 for j in range(d)] for i in range(d)]
    assert exact_polynomial(sparse) == slow_polynomial(sparse)


def test_primes():
    assert [p for p in range(60) if spectrum.is_prime(p)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert not spectrum.is_prime(3_215_031_751 // 151) and spectrum.moduli(1)[0] == 2**31 - 1


def test_roots_of_any_multiplicity():
    polynomial = [1]
    for root in (9, 9, 9, 4, 1, 1, 0, 0):  # known roots, multiplied out
        polynomial = [b - root * a for a, b in zip([*polynomial, 0], [0, *polynomial], strict=True)]
    found = spectrum.largest_roots(polynomial, 8)
    assert [(float(r.value), r.multiplicity) for r in found] == [(9.0, 3), (4.0, 1), (1.0, 2)]
    root_two = spectrum.largest_roots([2, -4, 1], 8)  # 2 +- sqrt(2)
    assert [float(r.value) for r in root_two] == pytest.approx([2 + math.sqrt(2), 2 - math.sqrt(2)], rel=1e-15)


def test_vectors_of_close_roots():
    """Eigenvalues that agree in 15 digits still have their own vectors."""
    big = 10**15
    a = [[big + 1, 1, 0], [1, big + 1, 0], [0, 0, 5]]
    roots = spectrum.largest_roots(exact_polynomial(a), 8)
    vectors = [spectrum.unit(v) for r in roots for v in spectrum.null_vectors(a, r)]
    half = math.sqrt(0.5)
    assert np.allclose(np.abs(vectors), [[half, half, 0], [half, half, 0], [0, 0, 1]], rtol=0, atol=1e-15)


def test_sums_of_products_are_exact():
    draw = random.Random(4)
    for most in (1, 1000, 1 << 40, (1 << 62) - 1):
        rows = [[draw.randint(-most, most) for _ in range(3)] for _ in range(9000 if most == 1000 else 200)]
        found = whitening.products(np.array(rows, dtype=np.int64))
        assert all(found[i, j] == sum(r[i] * r[j] for r in rows) for i in range(3) for j in range(3))
        assert found[0, 3] == sum(r[0] for r in rows) and found[3, 3] == len(rows)


def checked(rows, found, k):
    x = np.array([c for _, c in rows], dtype=float)
    n, s = len(rows), [sum(c[i] for _, c in rows) for i in range(len(rows[0][1]))]
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    assert len(found) == n * k and {r["n"] for r in found} == {n}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    for component in range(1, k + 1):
        mine = {r["file_id"]: r for r in found if r["component"] == component}
        wanted = centred @ axes[:, -component] / math.sqrt(values[-component])
        got = np.array([mine[i]["whitened"] for i, _ in rows])
        turn = np.sign(got @ wanted)
        assert np.allclose(got, turn * wanted, atol=1e-8)
        for i, c in rows:
            assert mine[i]["deviation"] == sum((n * v - t) ** 2 for v, t in zip(c, s, strict=True))
            assert mine[i]["explained"] == pytest.approx(values[-component] / values.sum(), rel=1e-9)


def test_matches_floating_point(spark):
    draw = np.random.default_rng(6)
    mixed = draw.normal(size=(400, 12)) @ draw.normal(size=(12, 12)) * 100
    rows = [(k, [int(v) + 100_000 for v in c]) for k, c in enumerate(mixed)]
    checked(rows, whitening.whiten(profiles(spark, rows).repartition(5)).collect(), 8)


def test_profiles_of_scanned_files(spark):
    """The counters of the code scan, per crate, as the project has them."""
    files = table(spark, "/root/testdata/sf0.001", "pages").select(
        F.col("page_id").cast("string").alias("crate"), F.col("url").alias("file"), F.col("html").alias("content")
    )
    sites = site_scan.site_rows(site_scan.scan_files(files, site_scan.HTML_RULES), site_scan.HTML_RULES)
    names = ["script", "link", "entity", "style"]
    wide = sites.groupBy("crate").pivot("pattern", names).count().na.fill(0)
    frame = wide.select(F.col("crate").cast("bigint").alias("file_id"), F.array(*names).alias("counters"))
    rows = [(r["file_id"], r["counters"]) for r in frame.collect()]
    rank = np.linalg.matrix_rank(np.cov(np.array([c for _, c in rows]).T))
    found = whitening.whiten(frame).collect()
    checked(rows, found, rank)


def test_edges(spark):
    rows = [
        (1, [1, 5, 5]), (2, [2, 5, 9]), (2, [2, 5, 9]), (None, [4, 5, 1]), (3, None), (4, [1, None, 2]), (5, []), (6, [1, 2]),
    ]
    found = whitening.whiten(profiles(spark, rows)).collect()
    assert len(found) == 4 * 2 and {r["n"] for r in found} == {4} and {r["component"] for r in found} == {1, 2}
    assert sorted(r["file_id"] or 0 for r in found if r["component"] == 1) == [0, 1, 2, 2]
    for same in ([], [(1, None)], [(1, [3, 4])], [(1, []), (2, [])], [(k, [7, 7]) for k in range(5)]):
        assert not whitening.whiten(profiles(spark, same)).collect()
    far = (1 << 62) - 1
    wide = whitening.whiten(profiles(spark, [(1, [far, 0]), (2, [-far, 1]), (3, [0, 5])]))
    assert {r["deviation"] for r in wide.collect()} and wide.first()["identity_error"] < 1e-6
    (one,) = {r["deviation"] for r in wide.where("file_id = 3").collect()}
    assert one == (3 * 0 - 0) ** 2 + (3 * 5 - 6) ** 2
