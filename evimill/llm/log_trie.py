"""Prefix trie of run logs by vertical bitmaps.

Runs that say the same for their first lines share a path of the trie. Runs are cut into shards by
ascending run_id. A shard is indexed by (position, line): the bitset of its runs that have that line
there. From the root, the bitset of all its runs, depth first: the postings at the next position of
the runs that are left, intersected with the bitset of the parent, are the children. Each node of a
shard becomes one row with its bitset, its number of runs and the list of those that end there.

Nodes of all shards meet by a digest of their path. Sums over subtrees need no walk from the leaves:
every node belongs to its smallest run, which from some depth on is the smallest of all nodes on its
path; so each run carries one total, and a node sums the totals of its runs, again by bitsets.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimill.llm.storage import kept, shuffled

#: Runs of a shard, and lines after which a shard ends.
RUNS, LINES = 1024, 1 << 16
ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()
INDEX = {
    "shard": pa.int64(), "segment": pa.int32(), "key": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "chars": pa.int64(),
    "n": pa.int64(), "run_id": pa.int64(), "low": pa.int32(), "bits": pa.binary(), "ends": pa.string(), "runs": pa.binary(),
}
_INDEX = (
    "shard bigint, segment int, key binary, parent binary, depth bigint, chars bigint, n bigint, run_id bigint, low int, bits binary, "
    "ends string, runs binary"
)


def packed(members: int) -> tuple[int, bytes]:
    """A bitset as its lowest place and the bytes from there on."""
    low = (members & -members).bit_length() - 1
    members >>= low
    return low, members.to_bytes((members.bit_length() + 7) // 8, "little")


def places(members: int) -> Iterator[int]:
    while members:
        yield (members & -members).bit_length() - 1
        members &= members - 1


def below(parent: bytes, line: bytes) -> bytes:
    """The digest of a path that goes on with a line."""
    return hashlib.blake2b(parent + line, digest_size=16).digest()


def nodes(runs: list[int], logs: list[list[tuple[bytes, int]]], start: bytes = ROOT, depth: int = 0, top: bool = True) -> Iterator[tuple]:
    """(key, parent, depth, chars, members, runs that end) of all nodes of a shard, depth first.

    ``logs`` holds (digest of the line, characters) from ``depth`` on, for each of ``runs``.
    """
    postings: list[dict[bytes, int]] = []
    ended: list[int] = []
    for k, log in enumerate(logs):
        while len(ended) <= len(log):
            ended.append(0)
            postings.append({})
        ended[len(log)] |= 1 << k
        for at, (line, _) in enumerate(log):
            postings[at][line] = postings[at].get(line, 0) | 1 << k
    everyone = (1 << len(runs)) - 1
    if top:
        yield start, None, depth, 0, everyone, ended[0]
    stack = [(start, 0, everyone)]
    while stack:
        key, at, members = stack.pop()
        left = members & ~ended[at]
        while left:
            line, chars = logs[(left & -left).bit_length() - 1][at]
            child = members & postings[at][line]
            left &= ~child
            name = below(key, line)
            yield name, key, depth + at + 1, chars, child, child & ended[at + 1]
            stack.append((name, at + 1, child))


class Shard:
    """Runs gathered until there are enough; a run too long for one shard goes on in the next segment."""

    def __init__(self) -> None:
        self.runs: list[int] = []
        self.logs: list[list[tuple[bytes, int]]] = []
        self.lines = self.segment = self.depth = 0
        self.start = ROOT

    def add(self, run: int, line: bytes | None, chars: int) -> Iterator[pa.RecordBatch]:
        if not self.runs or self.runs[-1] != run:
            if len(self.runs) == RUNS or self.lines >= LINES or self.segment:
                yield from self.flush(False)
            self.runs.append(run)
            self.logs.append([])
        elif self.lines >= LINES:
            yield from self.cut()
        if line is not None:
            self.logs[-1].append((line, chars))
            self.lines += 1

    def cut(self) -> Iterator[pa.RecordBatch]:
        """Before the last run, or within it where it is the only one."""
        if len(self.runs) > 1:
            run, log = self.runs.pop(), self.logs.pop()
            yield from self.flush(False)
            self.runs, self.logs, self.lines = [run], [log], len(log)
        else:
            yield from self.flush(True)

    def flush(self, more: bool) -> Iterator[pa.RecordBatch]:
        """The rows of what is gathered; ``more``: its only run goes on."""
        if not self.runs:
            return
        out: dict[str, list] = {name: [] for name in INDEX}
        key = self.start
        for key, parent, depth, chars, members, ended in nodes(self.runs, self.logs, self.start, self.depth, not self.segment):
            low, bits = packed(members)
            ended = 0 if more else ended
            values = (
                self.runs[0], self.segment, key, parent, depth, chars, members.bit_count(), self.runs[low], low, bits,
                ",".join(str(self.runs[k]) for k in places(ended)) if ended else None, None,
            )
            for name, value in zip(INDEX, values, strict=True):
                out[name].append(value)
            if len(out["key"]) == 4096:
                yield self.batch(out)
                out = {name: [] for name in INDEX}
        members = np.array(self.runs, dtype=np.int64).tobytes()
        for name in INDEX:
            out[name].append({"shard": self.runs[0], "segment": self.segment, "runs": members}.get(name))
        yield self.batch(out)
        run = self.runs[-1]
        done = self.depth + len(self.logs[-1])
        self.runs, self.logs, self.lines = ([run], [[]], 0) if more else ([], [], 0)
        self.segment, self.depth, self.start = (self.segment + 1, done, key) if more else (0, 0, ROOT)

    @staticmethod
    def batch(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in INDEX.items()], names=list(INDEX))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of the lines of a partition, sorted by run and then in order."""
    shard = Shard()
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("run_id", "digest", "chars"))
        for run, line, chars in zip(*columns, strict=True):
            yield from shard.add(run, line, chars)
    yield from shard.flush(False)


def _totals(index: pa.Table, values: pa.Table) -> pa.Table:
    """For each node of a shard segment, the sums of its runs' values."""
    saved, leaves = (np.zeros(RUNS + 8, dtype=np.int64) for _ in range(2))  # bytes end after the last run
    at = values.column("at").to_numpy()
    saved[at] = values.column("saved").to_numpy()
    leaves[at] = values.column("leaves").to_numpy()
    ending = sum(1 << int(k) for k in np.nonzero(leaves)[0])
    keys, out_saved, out_leaves = [], [], []
    for key, low, bits in zip(*(index.column(c).to_pylist() for c in ("key", "low", "bits")), strict=True):
        here = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        out_saved.append(int(saved[low : low + len(here)] @ here))
        out_leaves.append((int.from_bytes(bits, "little") << low & ending).bit_count())
        keys.append(key)
    return pa.table({"key": pa.array(keys, pa.binary()), "saved": pa.array(out_saved, pa.int64()), "leaves": pa.array(out_leaves, pa.int64())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined end lists of each key; rows sorted by key and shard, one held at a time."""
    last, digest = None, None
    for batch in batches:
        keys, out = [], []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                if digest:
                    keys.append(last)
                    out.append(digest.hexdigest())
                last, digest = key, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def marked(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """run_id, line, stream, digest, chars: every line by a digest of 128 bits, and a row without one for each run."""
    stream, text = F.coalesce("stream", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat_ws(":", F.length(stream).cast("string"), stream, text)
    digests = lines.where("run_id is not null").select(
        F.col("run_id").cast("bigint").alias("run_id"), F.lit(1).alias("kind"), "line", stream.alias("stream"),
        F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"), F.length(text).cast("bigint").alias("chars"),
    )
    heads = runs.where("run_id is not null").select(F.col("run_id").cast("bigint").alias("run_id"), F.lit(0).alias("kind"))
    return digests.unionByName(heads, allowMissingColumns=True)


def log_trie(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """run_id, depth, parent_run_id, n_runs, n_children, n_leaves, saved_chars, ends_sha256: one row per node.

    ``runs``: run_id bigint, the runs whose log may be empty. ``lines``: run_id bigint, line (its place,
    null first), stream, text: the lines of the logs; other columns are not read. A node of depth d is a
    distinct sequence of first d (stream, text); the root has depth 0. ``run_id`` is the smallest of the
    ``n_runs`` runs that start so, ``parent_run_id`` that of the node above (root: null). ``n_leaves``
    counts nodes without children in the subtree, itself included. ``saved_chars`` sums over the subtree
    what a line costs again: (n_runs - 1) times the characters of a node's last text. ``ends_sha256`` is
    the digest of the runs that have no more lines, decimal, ascending and comma-joined.

    Null stream or text counts as empty; rows without run_id are left out; a run given twice is one run,
    a line given twice two lines. Lines of equal place are ordered by stream and digest. No runs, no nodes.
    A run's own lines are read by one task, in segments, never held at once.
    """
    lined = kept(marked(runs, lines))
    ordered = lined.repartitionByRange("run_id").sortWithinPartitions(
        "run_id", "kind", F.col("line").asc_nulls_first(), "stream", "digest"
    )
    rows = kept(ordered.select("run_id", "digest", "chars").mapInArrow(_indexed, _INDEX))
    index = rows.where("key is not null")

    merged = kept(index.groupBy("key", "parent", "depth", "chars").agg(F.sum("n").alias("n"), F.min("run_id").alias("run_id")))
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    own = Window.partitionBy("run_id").orderBy("depth")
    ranked = kept(
        merged.join(shuffled(children), "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("again", (F.col("n") - 1) * F.col("chars"))
        .withColumn("first", F.row_number().over(own) == 1)
        .withColumn("before", F.sum("again").over(own) - F.col("again"))
    )
    values = ranked.groupBy("run_id").agg(F.sum("again").alias("saved"), F.sum((F.col("n_children") == 0).cast("int")).alias("leaves"))

    # only the first node of a run hangs from a node of another run
    above = merged.select(F.col("key").alias("parent"), F.col("run_id").alias("parent_run_id")).repartition(F.xxhash64("parent"))
    parents = ranked.where("first and parent is not null").select("key", "parent").join(shuffled(above), "parent").select("key", "parent_run_id")

    segments = rows.where("runs is not null").select(F.col("shard").alias("of"), F.col("segment").alias("part"), F.posexplode(_longs("runs")).alias("at", "run_id"))
    placed = segments.repartition(F.xxhash64("run_id")).join(shuffled(values.repartition(F.xxhash64("run_id"))), "run_id")
    sums = (
        index.select("shard", "segment", "key", "low", "bits")
        .groupBy("shard", "segment")
        .cogroup(placed.select("of", "part", "at", "saved", "leaves").groupBy("of", "part"))
        .applyInArrow(_totals, "key binary, saved bigint, leaves bigint")
        .groupBy("key")
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    )
    ends = (
        index.where("ends is not null")
        .select("key", "ends", "shard", "segment")
        .repartition("key")
        .sortWithinPartitions("key", "shard", "segment")
        .select("key", "ends")
        .mapInArrow(_hashed, "key binary, ends_sha256 string")
    )
    return (
        ranked.join(shuffled(sums), "key")
        .join(shuffled(parents), "key", "left")
        .join(shuffled(ends), "key", "left")
        .select(
            "run_id", "depth",
            F.when(F.col("parent").isNotNull(), F.coalesce("parent_run_id", "run_id")).alias("parent_run_id"),
            F.col("n").alias("n_runs"), "n_children", "n_leaves", (F.col("saved") - F.col("before")).alias("saved_chars"),
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )


def _longs(name: str):
    """The 64-bit numbers of a binary column, as numpy wrote them."""

    @F.arrow_udf(returnType="array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        order = "<i8" if sys.byteorder == "little" else ">i8"
        return pa.array([np.frombuffer(x.as_py(), dtype=order) for x in column], pa.list_(pa.int64()))

    return run.asNondeterministic()(F.col(name))
