"""Whitened principal components of counters, from an exact spectrum.

The scatter matrix of whole numbers is summed in whole numbers, so it does not depend on how rows are
cut into tasks, and centring before or after the products is the same. Its characteristic polynomial
is found modulo one prime per row of a Spark job and put together by Chinese remaindering; roots and
null spaces follow in long arithmetic (``spectrum``). What reaches the driver is bounded by the
number of counters, never by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimill.llm import spectrum
from evimill.llm.neighbours import matrix
from evimill.llm.storage import kept

#: Bits of a limb: products of limbs add up exactly in doubles over a block of rows.
LIMB = 20
#: What a sum is cut at, so that both parts fit 38 digits.
CUT = 80
BLOCK = 4096


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles ``l`` with x = sum of l[k] << (LIMB * k); all but the last are not negative."""
    out = []
    while x.size and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray) -> np.ndarray:
    """(d + 1, d + 1) exact sums of products of whole numbers; the last row and column are plain sums."""
    d = x.shape[1]
    total = np.zeros((d + 1, d + 1), dtype=object)
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at : at + BLOCK])
        for i, a in enumerate(parts):
            total[:d, d] += np.array([int(v) << LIMB * i for v in a.sum(axis=0).tolist()], dtype=object)
            for j, b in enumerate(parts):
                exact = (a.T @ b).astype(np.int64).astype(object)
                total[:d, :d] += exact * (1 << LIMB * (i + j))
        total[d, d] += len(x[at : at + BLOCK])
    return total


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            more = products(matrix(batch.column(0)).astype(np.int64, copy=False))
            total = more if total is None else total + more
    if total is not None:
        places = [(i, j, total[i, j]) for i in range(len(total)) for j in range(i, len(total))]
        whole = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in places], pa.int32()),
                pa.array([p[1] for p in places], pa.int32()),
                pa.array([Decimal(p[2] & ((1 << CUT) - 1)) for p in places], whole),
                pa.array([Decimal(p[2] >> CUT) for p in places], whole),
            ],
            names=["i", "j", "low", "high"],
        )


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums, and n times the scatter around the mean, of ``counters``; all exact."""
    sums = rows.select("counters").mapInArrow(_summed, "i int, j int, low decimal(38,0), high decimal(38,0)")
    total = [[0] * (d + 1) for _ in range(d + 1)]
    for r in sums.groupBy("i", "j").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect():
        total[r["i"]][r["j"]] = total[r["j"]][r["i"]] = (int(r["high"]) << CUT) + int(r["low"])
    n, s = total[d][d], [total[i][d] for i in range(d)]
    return n, s, [[n * total[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]


def characteristic_polynomial(rows: DataFrame, a: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first; each prime is a row of a Spark job."""
    spark = rows.sparkSession
    primes = spectrum.moduli(2 * spectrum.coefficient_bound(a))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spectrum.residues(a, batch.column(0).to_pylist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), kind)], names=["prime", "values"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    numbers = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(tasks)
    known = numbers.mapInArrow(reduced, "prime bigint, values array<bigint>").collect()
    return spectrum.combined([r["prime"] for r in known], [r["values"] for r in known])


def _projected(n: int, sums: list[int], axes: np.ndarray, roots: np.ndarray):
    """``axes`` (d, k) unit vectors, ``roots`` (k,) the square roots of their variances."""
    mean = np.array(sums, dtype=object)
    most = max(map(abs, sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1)).astype(np.int64, copy=False)
            largest = n * int(max(x.max(), -int(x.min()))) + most
            if len(sums) * largest**2 < 1 << 62:
                away = n * x - mean.astype(np.int64)
                squares = (away * away).sum(axis=1).tolist()
            else:
                away = n * x.astype(object) - mean
                squares = (away * away).sum(axis=1).tolist()
            whitened = (away.astype(np.float64) / n) @ axes / roots
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([str(v) for v in squares]),
                    pa.array(list(whitened), pa.list_(pa.float64())),
                ],
                names=["file_id", "deviation", "whitened"],
            )

    return run


OUT = "file_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(profiles: DataFrame, components: int = 8) -> DataFrame:
    """file_id, component, n, deviation, whitened, explained, identity_error: a row per file and component.

    ``profiles``: file_id bigint, counters array<bigint>, as the counters of a pattern summary; other
    columns are not read. With V the covariance of all n files (divisor n), ``component`` numbers its
    unit eigenvectors by falling eigenvalue from 1 to ``components``, those of eigenvalue zero left
    out; equal eigenvalues get some orthonormal basis of theirs. ``whitened`` is the file's distance
    from the mean along the component over the root of the eigenvalue, ``explained`` the eigenvalue's
    share of the trace. ``deviation`` is the exact squared distance of n times the counters from their
    sums, null beyond 38 digits. ``identity_error``, the same in all rows, is the largest entry by which
    the covariance of the whitened columns differs from the identity.

    Files without counters, with a null among them, or with another number of counters than most files
    take no part; rows given twice count twice, and a null file_id is a file like any other. No rows
    come out where no counter differs between files.
    """
    spark = profiles.sparkSession
    valid = profiles.where(F.col("counters").isNotNull() & F.forall("counters", lambda x: x.isNotNull())).select(
        F.col("file_id").cast("bigint").alias("file_id"), F.col("counters").cast("array<bigint>").alias("counters")
    )
    most = valid.groupBy(F.size("counters").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None or not most["d"]:
        return spark.createDataFrame([], OUT)
    rows = valid.where(F.size("counters") == most["d"])
    n, sums, a = scatter(rows, most["d"])
    found = spectrum.largest_roots(characteristic_polynomial(rows, a), components)
    if not found:
        return spark.createDataFrame([], OUT)
    pairs = [(root.value, spectrum.unit(v)) for root in found for v in spectrum.null_vectors(a, root)][:components]
    trace = sum(a[i][i] for i in range(len(a)))
    explained = [float(value / trace) for value, _ in pairs]
    roots = np.array([math.sqrt(Fraction(value, n * n)) for value, _ in pairs])
    axes = np.array([axis for _, axis in pairs]).T
    projected = kept(rows.select("file_id", "counters").mapInArrow(
        _projected(n, sums, axes, roots), "file_id bigint, deviation string, whitened array<double>"
    ))
    error = identity_error(projected, len(pairs))
    return projected.select("file_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "file_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"),
        "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened``, centred before multiplying, less the identity."""
    w = [F.col("whitened")[i] for i in range(k)]
    mean = projected.agg(*(F.avg(x) for x in w)).first()
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    found = projected.agg(*(F.avg((w[i] - mean[i]) * (w[j] - mean[j])) for i, j in upper)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, upper, strict=True))
