"""Approximate nearest neighbours by a forest of random-projection trees.

The planes of all trees are fitted to a bounded sample: each node splits the sample at the median of
its projection on the difference of two of its vectors. Every vector is then stored at its leaf in
every tree. A query walks all trees through one priority queue, nearest plane first, until the
leaves it has reached hold the wanted share of all rows; what they hold is ranked by the exact
cosine. The reference data has no vectors, so the operator is general: any table of (vec_id,
embedding).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimill.llm.storage import kept, shuffled


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in heap order: ``normals`` (trees, nodes, dimension), ``offsets`` (trees, nodes)."""

    depth: int
    normals: np.ndarray
    offsets: np.ndarray

    def margins(self, unit: np.ndarray) -> np.ndarray:
        """(rows, trees, nodes): signed distances to all planes."""
        flat = self.normals.reshape(-1, unit.shape[1])
        return (unit @ flat.T).reshape(len(unit), *self.offsets.shape) - self.offsets

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector, from 0."""
        side = self.margins(unit) > 0
        rows, trees = np.arange(len(unit))[:, None], np.arange(len(self.offsets))[None, :]
        node = np.zeros((len(unit), len(self.offsets)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + side[rows, trees, node]
        return node - self.offsets.shape[1]

    def search(self, margins: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) by increasing distance until they hold ``wanted`` rows; ``sizes`` by tree and leaf."""
        inner = self.offsets.shape[1]
        queue, reached, found = [(0.0, tree, 0) for tree in range(len(self.offsets))], 0, []
        while queue and reached < wanted:
            distance, tree, node = heapq.heappop(queue)
            if node >= inner:
                if sizes[tree, node - inner]:
                    found.append((tree, node - inner))
                    reached += sizes[tree, node - inner]
                continue
            margin = margins[tree, node]
            near = 2 * node + (2 if margin > 0 else 1)
            heapq.heappush(queue, (distance, tree, near))
            heapq.heappush(queue, (max(distance, abs(margin)), tree, 4 * node + 3 - near))
        return found


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Doubles of magnitude about 1, divided by powers of two, so nothing is rounded or overflows."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    """Planes from unit vectors; nodes without two different vectors send everything to one side."""
    depth = max(0, min(depth, int(math.log2(max(len(sample), 1) / 8)) if len(sample) >= 8 else 0))
    nodes = 2**depth - 1
    dimension = sample.shape[1]
    normals, offsets = np.zeros((trees, nodes, dimension)), np.zeros((trees, nodes))
    for tree in range(trees):
        draw = np.random.Generator(np.random.PCG64([seed, tree]))
        at = np.zeros(len(sample), dtype=np.int64)
        for node in range(nodes):
            members = np.nonzero(at == node)[0]
            if len(members) > 1:
                a, b = draw.choice(members, 2, replace=False)
                normal = sample[a] - sample[b]
                length = np.linalg.norm(normal)
                if length > 0:
                    normals[tree, node] = normal / length
                    projected = sample[members] @ normals[tree, node]
                    offsets[tree, node] = np.median(projected)
                    at[members] = 2 * node + 1 + (projected > offsets[tree, node])
                    continue
            at[members] = 2 * node + 1
    return Forest(depth, normals, offsets)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(embedding: Column) -> Column:
    """Not null, all components finite, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def _stored(forest: Forest, parts: np.ndarray, kind: pa.DataType):
    """Index rows: each vector at its leaf in each tree; large leaves are split by vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                leaves = forest.leaves(unit(matrix(batch.column(1))))
                for tree in range(leaves.shape[1]):
                    leaf = leaves[:, tree]
                    part = ids % parts[tree, leaf]
                    place = (tree << 48 | leaf << 24) + part
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place), batch.column(0), batch.column(1).cast(kind)], names=["place", "vec_id", "v"]
                    )

    return run


def _counted(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros((len(forest.offsets), 2**forest.depth), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                for tree, leaf in enumerate(forest.leaves(unit(matrix(batch.column(0)))).T):
                    sizes[tree] += np.bincount(leaf, minlength=sizes.shape[1])
        tree, leaf = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree), pa.array(leaf), pa.array(sizes[tree, leaf])], names=["tree", "leaf", "n"]
        )

    return run


def _probed(forest: Forest, sizes: np.ndarray, parts: np.ndarray, wanted: float, kind: pa.DataType):
    """Probe rows: each distinct query vector at the leaves that its search reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                margins = forest.margins(unit(matrix(some.column(1))))
                places, rows = [], []
                for row in range(some.num_rows):
                    for tree, leaf in forest.search(margins[row], sizes, wanted):
                        for part in range(parts[tree, leaf]):
                            places.append((tree << 48 | leaf << 24) + part)
                            rows.append(row)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int64()), some.column(0).take(take), some.column(1).take(take).cast(kind)],
                    names=["place", "query", "v"],
                )

    return run


def _ranked(k: int):
    """The best ``k`` rows of a leaf for each query there, by exact cosine, then vec_id."""

    def rank(queries: pa.Table, stored: pa.Table) -> pa.Table:
        out_query, out_near = [], []
        if queries.num_rows and stored.num_rows:
            ids = stored.column("vec_id").to_numpy()
            rows = scaled(matrix(stored.column("v")))
            norms = np.sqrt((rows * rows).sum(axis=1))
            fine = rows / norms[:, None]
            names = queries.column("query").to_pylist()
            asked = scaled(matrix(queries.column("v")))
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                lengths = np.sqrt((part * part).sum(axis=1))
                close = (part / lengths[:, None]) @ fine.T
                cut = np.partition(close, -k, axis=1)[:, -k] if close.shape[1] > k else np.full(len(part), -2.0)
                for i, one in enumerate(part):
                    maybe = np.nonzero(close[i] >= cut[i] - 1e-9)[0]
                    # summed row by row, so that equal vectors score equally wherever they are stored
                    exact = (rows[maybe] * one).sum(axis=1) / (norms[maybe] * lengths[i])
                    best = np.lexsort((ids[maybe], -exact))[:k]
                    out_query.append(names[at + i])
                    out_near.append([{"away": -float(exact[b]), "vec_id": int(ids[maybe[b]])} for b in best])
        near = pa.list_(pa.struct([("away", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({"query": pa.array(out_query, pa.string()), "near": pa.array(out_near, near)})

    return rank


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    trees: int = 4,
    depth: int = 7,
    share: float = 1.75,
    sample_rows: int = 20_000,
    leaf_rows: int = 1 << 15,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the ``k`` nearest rows found for each query but itself.

    ``vectors`` and ``queries``: vec_id bigint, embedding array<float or double>; other columns are
    not read. A query is the row of that vec_id and never finds it. Ties go to the smaller vec_id.
    Null ids, null or zero vectors and such with null or non-finite components take no part, nor
    do vectors of another length than most. Rows that share id and vector count once.

    Planes are fitted to at most ``sample_rows`` vectors, drawn by hash of vec_id; all rows are
    indexed. A search ends once its leaves hold ``share`` times all rows, rows counted in each tree:
    1.75 finds over nine in ten neighbours even among vectors without any structure, a few hundredths
    do where there are clusters. Of equal vectors the k+1 of smallest vec_id are indexed, as no query
    can be nearer to another one. Leaves are split above ``leaf_rows``.
    """
    spark = vectors.sparkSession
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding")
    lengths = valid.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if most is None:
        return spark.createDataFrame([], out)
    valid = valid.where(F.size("embedding") == most["d"])
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    rows = kept(
        valid.distinct()
        .withColumn("n", F.row_number().over(alike))
        .where(F.col("n") <= k + 1)
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    )
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).select("embedding").toArrow()
    forest = fit_forest(unit(matrix(sample.column(0))), trees, depth, seed)
    counts = rows.select("embedding").mapInArrow(_counted(forest), "tree bigint, leaf bigint, n bigint")
    sizes = np.zeros((trees, 2**forest.depth), dtype=np.int64)
    for row in counts.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row["tree"], row["leaf"]] = row["n"]
    parts = np.maximum(1, -(-sizes // leaf_rows))
    element = dict(rows.dtypes)["embedding"]
    kind = pa.list_(pa.float32() if "float" in element else pa.float64())
    stored = rows.mapInArrow(_stored(forest, parts, kind), f"place bigint, vec_id bigint, v {element}")

    asked = kept(
        queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == most["d"]))
        .select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast(element).alias("embedding"))
        .distinct()
        .withColumn("query", F.sha2(F.col("embedding").cast("string"), 256))
    )
    distinct = asked.groupBy("query").agg(F.first("embedding").alias("embedding"))
    wanted = share * float(sizes[0].sum())
    probes = distinct.mapInArrow(_probed(forest, sizes, parts, wanted, kind), f"place bigint, query string, v {element}")
    near = "query string, near array<struct<away: double, vec_id: bigint>>"
    found = (
        probes.groupBy("place")
        .cogroup(stored.groupBy("place"))
        .applyInArrow(_ranked(k + 1), near)
        .groupBy("query")
        # k + 1 of each leaf reached, so bounded by the forest
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))
        .repartition(F.xxhash64("query"))
    )
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(shuffled(found), "query")
        .select("query_id", F.posexplode(others).alias("at", "x"))
        .select(
            "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.away")).alias("score")
        )
    )
