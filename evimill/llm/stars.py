"""Connected components by local forests and pointer jumping, with few shuffles for each round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimill.llm.storage import kept, shuffled

#: Links that a task joins at a time.
CHUNK = 1 << 18
#: Links for which one task is enough.
FEW = 1024


def local_stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for all nodes of ``links`` but the smallest ones."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(node, node) != top:
            parent[node], node = top, parent[node]
        return top

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(node, root(node)) for node in list(parent)]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple[int, int]] = []

    def emitted() -> pa.RecordBatch:
        found = local_stars(waiting)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        waiting += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(waiting) >= CHUNK:
            yield emitted()
            waiting = []
    if waiting:
        yield emitted()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b bigint) but the roots, the smallest of their component.

    A round joins the links of the larger node within its task, so each node points to smaller ones,
    and then lets every node jump to where its own target points. Depths halve; where nothing changes
    any more all point to their roots. The driver sees a count and a checksum. The count also says how
    many tasks a round needs, as a few links over all tasks of the session are mostly names of files.
    """
    edges, seen = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    dealt = edges.repartition("a")
    while True:
        edges = kept(dealt.mapInArrow(_stars, "a bigint, b bigint"))
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        tasks = -(-state["n"] // FEW) or 1
        edges = edges.coalesce(tasks)
        if state == seen or not state["n"]:
            # a node whose links went to several chunks points to its root once for each
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).coalesce(tasks)
        seen = state
        # one target for each node, or links would multiply; its other links stay rows of their own
        further = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("c")).coalesce(tasks)
        jumped = edges.join(shuffled(further), "b", "left").coalesce(tasks)
        dealt = jumped.select("a", F.coalesce("c", "b").alias("b")).repartition("a").coalesce(tasks)
