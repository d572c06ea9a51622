"""Near copies of profiles by int8 tile products with error bounds.

The rows of a cohort are dealt into blocks by hash, and every two blocks meet in one tile. Each unit
vector is rounded to int8 codes and a scale; the length of what the rounding leaves is kept with the
vector. A product of codes is then off by no more than both lengths allow, so most pairs are settled
by it: those surely below the threshold and those surely above. Only the rest is computed again, in
doubles. Products of codes are whole numbers that single precision holds exactly.

Equal profiles of a cohort are one class from the start. A tile gives the number of links of each of
its classes and only those links that join something new, so that a crowd never gives all its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimill.llm.components import components
from evimill.llm.neighbours import matrix, scaled, usable
from evimill.llm.storage import kept, shuffled

THRESHOLD = 0.98
#: Profiles in a block, about; a tile holds two blocks.
BLOCK = 2048
#: Rows of a tile that are multiplied at a time.
STRIP = 256
#: What the arithmetic of the bounds itself may be off by.
SLACK = 1e-9
#: Dimensions over which products of codes stay below 2**24.
EXACT = (1 << 24) // (127 * 127)


@dataclass(frozen=True)
class Codes:
    """Rounded unit vectors: ``codes`` * ``scale`` is off from the vector by a length of ``error`` at most."""

    codes: np.ndarray
    scale: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        scale = np.abs(unit).max(axis=1, initial=0.0) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        left = unit - codes * scale[:, None]
        return cls(codes, scale, np.sqrt((left * left).sum(axis=1)) + SLACK)

    def part(self, rows: slice) -> Codes:
        return Codes(self.codes[rows], self.scale[rows], self.error[rows])

    def products(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Products of all pairs, and what each may be off by."""
        whole = np.zeros((len(self.codes), len(other.codes)))
        for at in range(0, self.codes.shape[1], EXACT):
            some = slice(at, at + EXACT)
            whole += self.codes[:, some].astype(np.float32) @ other.codes[:, some].astype(np.float32).T
        bound = self.error[:, None] + other.error[None, :] + self.error[:, None] * other.error[None, :] + SLACK
        return whole * self.scale[:, None] * other.scale[None, :], bound


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, in doubles."""
    lengths = np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1))
    return (left * right).sum(axis=1) / lengths


def linked(vectors: np.ndarray, codes: Codes, rows: slice, columns: slice, threshold: float) -> tuple[np.ndarray, int]:
    """Which rows link with which columns, and how many pairs had to be computed in doubles."""
    about, bound = codes.part(rows).products(codes.part(columns))
    near = about - bound >= threshold
    open_rows, open_columns = np.nonzero(~near & (about + bound >= threshold))
    for at in range(0, len(open_rows), 1 << 16):
        i, j = open_rows[at : at + (1 << 16)], open_columns[at : at + (1 << 16)]
        near[i, j] = cosines(vectors[rows][i], vectors[columns][j]) >= threshold
    return near, len(open_rows)


def tile(ids: np.ndarray, sizes: np.ndarray, lows: int, vectors: np.ndarray, threshold: float) -> tuple[dict, list]:
    """(links of each class in other classes, links that connect all linked ones) of a tile.

    The first ``lows`` rows are one block and the rest the other; with all rows in one block its
    pairs meet, else those between the blocks.
    """
    codes = Codes.of(vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)))
    n, alone = len(ids), lows == len(ids)
    columns = slice(0, n) if alone else slice(lows, n)
    counts, group, joins = np.zeros(n, dtype=np.int64), np.arange(n), []
    for at in range(0, lows, STRIP):
        rows = slice(at, min(at + STRIP, lows))
        near, _ = linked(vectors, codes, rows, columns, threshold)
        if alone:
            near[np.arange(rows.stop - at), np.arange(at, rows.stop)] = False
        else:
            counts[columns] += sizes[rows] @ near
        counts[rows] += near @ sizes[columns]
        for i in np.nonzero(near.any(axis=1))[0].tolist():
            others = columns.start + np.nonzero(near[i])[0]
            joined, first = np.unique(group[others], return_index=True)
            mine = group[at + i]
            new = joined != mine
            if new.any():
                joins += [(int(ids[at + i]), int(ids[k])) for k in others[first[new]]]
                group[np.isin(group, joined[new])] = mine
    return {int(ids[k]): int(counts[k]) for k in np.nonzero(counts)[0]}, joins


def _tiles(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("upper", "ascending")])
        upper = rows.column("upper").to_numpy()
        lows = int((~upper).sum())
        counts, joins = tile(
            rows.column("id").to_numpy(), rows.column("size").to_numpy(), lows, scaled(matrix(rows.column("profile"))), threshold
        )
        return pa.table(
            {
                "a": pa.array([*counts, *(j[0] for j in joins)], pa.int64()),
                "b": pa.array([None] * len(counts) + [j[1] for j in joins], pa.int64()),
                "links": pa.array([*counts.values(), *[0] * len(joins)], pa.int64()),
            }
        )

    return run


def links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, links): ``links`` of class ``a`` in one tile where b is null, else a link that joins a and b.

    ``classes``: id, cohort, profile, size.
    """
    kinds = classes.withColumn("d", F.size("profile"))
    blocks = (
        kinds.groupBy("cohort", "d")
        .agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        .repartition(F.xxhash64("cohort", "d"))
    )
    dealt = (
        kinds.join(shuffled(blocks), ["cohort", "d"])
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    placed = dealt.select(
        "cohort", "d", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("upper"), "id", "size", "profile",
    )
    return placed.groupBy("cohort", "d", "low", "high").applyInArrow(_tiles(threshold), "a bigint, b bigint, links bigint")


def near_profiles(profiles: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """file_id, n_links, component_id, kept: one row per row, with the near copies within its cohort.

    ``profiles``: file_id bigint, cohort of any simple type, profile array<float or double>, as the
    counters of a pattern summary of a file or any other vector; other columns are not read. Two files
    link if their cohorts are equal and the cosine of their profiles, in doubles, is ``threshold`` or
    more. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest file_id
    linked directly or through others, itself included, ``kept`` whether that is the file's own.

    Null cohorts, and profiles that are null, empty, zero or hold null or non-finite numbers, link with
    nothing; nor do profiles of different length. Rows given twice link with each other and share
    ``kept``. A row without file_id takes part; it is kept if nothing it links with has an id.

    All pairs of a cohort are compared, as the method has it: a block meets as many others as its cohort
    has, so work grows with the square of a cohort, in tiles of bounded size whatever its share.
    """
    rows = kept(
        profiles.select(
            F.col("file_id").cast("bigint").alias("file_id"), "cohort", F.when(usable(F.col("profile")), F.col("profile")).alias("profile")
        )
    )
    valid = rows.where(F.col("cohort").isNotNull() & F.col("profile").isNotNull())
    classes = kept(
        valid.groupBy("cohort", "profile")
        .agg(F.count("*").alias("size"), F.min("file_id").alias("first"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    found = kept(links(classes, threshold, block))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).repartition(F.xxhash64("node"))
    named = kept(
        classes.join(shuffled(roots), F.col("id") == F.col("node"), "left")
        .join(shuffled(counts), F.col("id") == F.col("a"), "left")
        .select(
            "cohort", "profile", "first", F.coalesce("root", "id").alias("root"),
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id")).repartition(F.xxhash64("root"))
    answers = named.join(shuffled(lowest), "root").select("cohort", "profile", "n_links", "component_id")
    with_links = valid.join(shuffled(answers.repartition(F.xxhash64("cohort", "profile"))), ["cohort", "profile"]).select(
        "file_id", "n_links", "component_id"
    )
    alone = rows.where(F.col("cohort").isNull() | F.col("profile").isNull()).select(
        "file_id", F.lit(0).cast("bigint").alias("n_links"), F.col("file_id").alias("component_id")
    )
    return with_links.unionByName(alone).withColumn("kept", F.col("file_id").eqNullSafe(F.col("component_id")))
