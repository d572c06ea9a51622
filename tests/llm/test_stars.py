import random

import pyarrow as pa
from evimill.llm import stars


def slow_roots(links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {(x, root(x)) for x in parent if root(x) != x}


def graphs():
    draw = random.Random(2)
    path = list(range(70))
    draw.shuffle(path)
    yield list(zip(path, path[1:], strict=False))
    yield [(500, k) for k in range(200)] + [(k, 1000) for k in range(150, 260)]
    yield [(draw.randrange(10**12), draw.randrange(10**12)) for _ in range(50)] + [(7, 7)]
    yield [(draw.randrange(120), draw.randrange(120)) for _ in range(90)]
    yield []


def test_roots_match_brute_force(spark):
    for links in graphs():
        frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
        found = [(r["node"], r["root"]) for r in stars.roots(frame).collect()]
        assert len(found) == len(set(found)) and set(found) == slow_roots(links)


def test_few_links_take_few_tasks(spark, monkeypatch):
    """Also where the session puts no partitions together: a task for each ``FEW`` links."""
    held, kept = [], stars.kept
    monkeypatch.setattr(stars, "kept", lambda frame: held.append(kept(frame)) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for links, most in (([(k, k + 1) for k in range(40)], 1), ([(k, k + 1) for k in range(3 * stars.FEW)], 3)):
            held.clear()
            found = stars.roots(spark.createDataFrame(links, "a bigint, b bigint").repartition(9))
            assert {(r["node"], r["root"]) for r in found.collect()} == {(b, 0) for _, b in links}
            assert len(held) > 2 and all(x.rdd.getNumPartitions() <= most for x in [*held[1:], found])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chunks_keep_what_is_connected(monkeypatch):
    monkeypatch.setattr(stars, "CHUNK", 3)
    for links in graphs():
        pieces = [links[k : k + 3] for k in range(0, len(links), 3)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*p, strict=True)], names=["a", "b"]) for p in pieces)
        found = [tuple(r.values()) for batch in stars._stars(batches) for r in batch.to_pylist()]
        assert slow_roots(found) == slow_roots(links) and all(a > b for a, b in found)


def test_local_stars():
    assert set(stars.local_stars([(5, 3), (3, 9), (1, 2), (9, 0)])) == {(5, 0), (3, 0), (9, 0), (2, 1)}
