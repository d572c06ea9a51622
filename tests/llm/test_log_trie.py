import hashlib
import random
from collections import defaultdict

import pytest
from evimill.llm import log_trie, queries
from evimill.sources.views import table
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

RUNS = "run_id bigint, depth string, key string, n string, saved string"
LINES = "run_id bigint, line bigint, stream string, text string, kind string, chars string, digest string, shard string"


def frames(spark, logs):
    """``logs``: run_id to (stream, text) in order."""
    lines = [(i, k, *said, *["x"] * 4) for i, log in logs.items() for k, said in enumerate(log)]
    random.Random(1).shuffle(lines)
    return spark.createDataFrame([(i, *["x"] * 4) for i in logs], RUNS), spark.createDataFrame(lines, LINES)


def slow(logs):
    """All nodes, prefix by prefix."""
    logs = {i: [(s or "", t or "") for s, t in log] for i, log in logs.items()}
    members = defaultdict(list)
    for i in sorted(logs):
        for d in range(len(logs[i]) + 1):
            members[tuple(logs[i][:d])].append(i)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, runs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(runs) - 1) * len(node[-1][1]) if node else 0
    rows = set()
    for node, runs in members.items():
        ends = ",".join(str(i) for i in runs if len(logs[i]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.add((min(runs), len(node), parent, len(runs), children[node], leaves[node], saved[node], digest))
    return rows


def found(frame):
    return [
        tuple(r[c] for c in ("run_id", "depth", "parent_run_id", "n_runs", "n_children", "n_leaves", "saved_chars", "ends_sha256"))
        for r in frame.collect()
    ]


def compare(spark, logs):
    rows = found(log_trie.log_trie(*frames(spark, logs)))
    wanted = slow(logs)
    assert len(rows) == len(wanted) and set(rows) == wanted


def drawn(seed, n):
    draw = random.Random(seed)
    said = [(s, t) for s in ("stdout", "stderr") for t in ("running 1 test", "é\U0001f600", "", "error")]
    logs = {draw.randrange(10**12) - 10**6: [draw.choice(said) for _ in range(draw.randrange(7))] for _ in range(n)}
    first = list(logs.values())[0]
    return logs | {k: list(first) for k in range(40)} | {1000: [("stdout", "long")] * 90, 1001: [("stdout", "long")] * 89}


def test_matches_brute_force(spark):
    compare(spark, drawn(1, 300))


@pytest.mark.parametrize(("runs", "lines"), [(7, 1 << 16), (5, 13), (1024, 1)])
def test_shards_of_any_size(runs, lines, monkeypatch):
    """Nodes, members and ends of all shards together, and runs that go on over segments."""
    monkeypatch.setattr(log_trie, "RUNS", runs)
    monkeypatch.setattr(log_trie, "LINES", lines)
    logs = drawn(2, 60)
    shard, rows = log_trie.Shard(), []
    for run in sorted(logs):
        for line in [None, *(f"{s}:{t}".encode() for s, t in logs[run])]:
            for batch in shard.add(run, line, 1):
                rows += batch.to_pylist()
    for batch in shard.flush(False):
        rows += batch.to_pylist()
    count, ends, of = defaultdict(int), defaultdict(list), {}
    for r in rows:
        if r["key"] is None:
            of[r["shard"], r["segment"]] = len(r["runs"]) // 8
        else:
            count[r["depth"], r["key"]] += r["n"]
            ends[r["depth"], r["key"]] += [int(x) for x in r["ends"].split(",")] if r["ends"] else []
    assert max(of.values()) <= runs
    wanted = [(depth, n) for _, depth, _, n, *_ in slow(logs)]
    assert sorted((d, n) for (d, _), n in count.items()) == sorted(wanted)
    assert sorted(i for e in ends.values() for i in e) == sorted(logs) and all(e == sorted(e) for e in ends.values())


def test_small_shards_give_the_same_trie(spark):
    """One shard per partition at least; the sums of subtrees go over all of them."""
    logs = drawn(3, 200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        compare(spark, logs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_logs_of_the_project(spark):
    """The logs of tool runs, cut into lines."""
    logs = table(spark, "/root/testdata/sf0.001", "events").select(
        F.col("event_id").alias("run_id"), F.concat_ws("\n", "event_type", "props").alias("combined_output")
    )
    lines = logs.select("run_id", F.posexplode(F.split("combined_output", "\n")).alias("line", "text")).withColumn("stream", F.lit("stdout"))
    wanted = slow({r["run_id"]: [("stdout", t) for t in r["combined_output"].split("\n")] for r in logs.collect()})
    assert set(found(log_trie.log_trie(logs, lines))) == wanted


def test_edges(spark):
    runs = spark.createDataFrame([(5,), (5,), (None,), (-3,)], "run_id bigint")
    lines = spark.createDataFrame(
        [(7, None, None, "b"), (7, 2, "", "a"), (8, None, "", "b"), (8, 0, None, "a"), (8, 0, None, "a"), (None, 1, "x", "y"), (9, 1, "x" * 99, "y" * 300_000)],
        "run_id bigint, line bigint, stream string, text string",
    )
    same = {5: [], -3: [], 7: [("", "b"), ("", "a")], 8: [("", "b"), ("", "a"), ("", "a")], 9: [("x" * 99, "y" * 300_000)]}
    assert set(found(log_trie.log_trie(runs, lines))) == slow(same)
    assert not log_trie.log_trie(runs.limit(0), lines.limit(0)).collect()
    assert set(found(log_trie.log_trie(runs, lines.limit(0)))) == slow({5: [], -3: []})


def test_conversations_as_runs(spark):
    """The mapping of the query, against one conversation at a time."""
    draw = random.Random(4)
    turns = {c: [(t, draw.choice(["user", None]), draw.choice(["a", "bc", None])) for t in range(draw.randrange(1, 9))] for c in [*range(0, 9), *range(100, 130), 250, 251]}
    rows = [(c, None if t == 0 else t, role, text) for c, log in turns.items() for t, role, text in log]
    frame = spark.createDataFrame([*rows, (None, 1, "a", "b")], "conv_id bigint, turn bigint, role string, text string")
    import zlib

    wanted = {}
    for c, log in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        wanted[c] = [(r, x) for _, r, x in turns.get(c - c % 100, [])[:h] + log[h:]]
    runs, lines = queries.rebuilt(frame)
    assert runs.schema["run_id"].dataType == LongType()
    assert set(found(log_trie.log_trie(runs, lines))) == slow(wanted)
