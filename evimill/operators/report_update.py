"""A finished report brought up to date: only crates whose inputs changed are made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section of a report that holds what its inputs looked like.
INPUTS = "inputs"
DIGEST_SCHEMA = "crate string, input string, n_rows bigint, digest string"


def _row_hash(df: DataFrame, seed: int) -> Column:
    """Hash of a row; the null test of each column keeps (null, x) and (x, null) apart."""
    cells = [c for name in df.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return F.xxhash64(F.lit(seed), *cells)


def input_digests(inputs: dict[str, DataFrame]) -> DataFrame:
    """(crate, input, n_rows, digest): what each crate has of each input, whatever the order of its rows.

    ``inputs`` are tables with a ``crate``: the rows a report is made of, or listings of them (path, length,
    time of change), which are cheaper. No column may be a map. Two sums of different hashes of the rows
    are one partial aggregation, so repeated rows count and no group meets in one task before that.
    Rows without a crate are left out, as no report has a place for them.
    """
    parts = [
        df.filter(F.col("crate").isNotNull())
        .select("crate", *[_row_hash(df, seed).cast("decimal(20,0)").alias(f"_h{seed}") for seed in (1, 2)])
        .groupBy("crate")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h1").alias("_h1"), F.sum("_h2").alias("_h2"))
        .select("crate", F.lit(name).alias("input"), "n_rows", F.concat_ws(":", F.col("_h1").cast("string"), F.col("_h2").cast("string")).alias("digest"))
        for name, df in sorted(inputs.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stale_crates(then: DataFrame, now: DataFrame) -> DataFrame:
    """crate: those of which any input differs between two sets of digests, new and gone ones included."""
    before = then.select("crate", "input", F.struct("n_rows", "digest").alias("_then"))
    after = now.select("crate", "input", F.struct("n_rows", "digest").alias("_now"))
    both = before.join(after, ["crate", "input"], "full")
    return both.filter(~F.col("_then").eqNullSafe(F.col("_now"))).select("crate").distinct()


def digest_documents(digests: DataFrame) -> DataFrame:
    """Digests as documents of a report, one per crate and input."""
    return digests.select(
        "crate", F.lit(INPUTS).alias("section"), F.lit(0).cast("bigint").alias("chunk"),
        F.to_json(F.struct(*digests.columns)).alias("document"),
    )


def updated_report(finished: DataFrame, fresh: DataFrame, stale: DataFrame) -> DataFrame:
    """(crate, section, document): ``finished`` with the stale crates taken from ``fresh``.

    ``fresh`` holds the documents of the stale crates and that of the study. A stale crate without fresh
    documents is gone from the report. Documents come in chunks, so one crate is never one row.
    """
    columns = ["crate", "section", "document"]
    kept = finished.filter(F.col("crate").isNotNull()).join(stale, "crate", "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))
