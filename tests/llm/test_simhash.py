import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from cases import EDGES, files
from evimill.llm import components, simhash


def slow_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fingerprints):
    parent = {f: f for f in fingerprints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    known = sorted(parent)
    for k, a in enumerate(known):
        for b in known[:k]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in known}


def flipped(draw, value, most):
    for bit in draw.sample(range(64), draw.randint(0, most)):
        value ^= 1 << bit
    return value


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprint_matches_the_definition():
    draw = random.Random(3)
    words = ["fn", "Unsafe", "É", "x y", "ptr", "\U0001f600", "*mut"]
    for n in [0, 1, 2, 3, 4, 50, 700]:
        text = "".join(w + draw.choice([" ", "\n", "\t ", "\x0b"]) for w in draw.choices(words, k=n))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_anchors_cover():
    draw = np.random.default_rng(5)
    half = draw.integers(0, 1 << 32, 500, dtype=np.uint32)
    rows, found, home = simhash.anchors(half)
    distance = np.bitwise_count(half[rows] & np.uint32(0x7FFFFFFF) ^ found)
    assert (distance <= 2).all() and (distance[home] <= 1).all() and (np.bincount(rows[home]) == 1).all()
    homes = dict(zip(rows[home].tolist(), found[home].tolist()))
    for bit in range(32):  # whoever is one bit away is a guest at home
        rows2, found2, _ = simhash.anchors(half ^ np.uint32(1 << bit))
        met = set(zip(rows2.tolist(), found2.tolist()))
        assert all((row, home_of) in met for row, home_of in homes.items())


def brute(spark, values, **settings):
    classes = spark.createDataFrame([(signed(v),) for v in set(values)], "fp bigint")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(classes, **settings)).collect()}
    groups = defaultdict(set)
    for v in set(values):
        groups[roots.get(signed(v), signed(v))].add(v)
    want = defaultdict(set)
    for v, r in slow_components(set(values)).items():
        want[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_connect_what_brute_force_connects(spark):
    draw = random.Random(7)
    centres = [draw.getrandbits(64) for _ in range(60)]
    brute(spark, [flipped(draw, c, 5) for c in centres for _ in range(8)])


def test_crowd_at_one_anchor_is_split(spark):
    draw = random.Random(8)
    centre = draw.getrandbits(64)
    values = [flipped(draw, centre, 4) for _ in range(600)]
    brute(spark, values, crowd=16)
    classes = spark.createDataFrame([(signed(v),) for v in set(values)], "fp bigint")
    assert simhash.links(classes).count() < 40 * len(set(values))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(-5, 7), (200, 200)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: -5 for k in range(41)}, **{k: 100 for k in range(101, 160)}}
    assert not components.components(spark.createDataFrame([], "a bigint, b bigint")).collect()


def test_edges(spark):
    rows = simhash.near_copies(files(spark, EDGES)).collect()
    by_id = {r["file_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert len(rows) == len(EDGES)
    assert by_id[1] == by_id[2] and by_id[1][1] == 1
    assert {by_id[k] for k in (3, 4, 5)} == {("0" * 16, 3)}
    assert by_id[None][1] is None and by_id[7][1] == 7
    assert by_id[6][0] == f"{slow_fingerprint(EDGES[5][2][:45_000]):016x}" or by_id[6][1] == 6
    assert not simhash.near_copies(files(spark, [])).collect()
