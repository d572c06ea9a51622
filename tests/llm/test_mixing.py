import math
import random

import numpy as np
import pytest
from cases import EDGES, files
from evimill.llm import mixing


def corpus(seed=1):
    draw = random.Random(seed)
    crates = {"a": 900, "b": 300, "c": 100, None: 40, "é": 200}
    return [(k, crate, " ".join(["w"] * draw.randint(0, 60))) for crate, n in crates.items() for k in range(n)]


@pytest.mark.parametrize("sizes, weights, want", [
    ([100, 100, 100], [5, 2, 1], [187.5, 75, 37.5]),
    ([10, 100, 100], [5, 2, 1], [30, 120, 60]),
    ([0, 10], [5, 2], [0, 10]),
    ([], [], []),
    ([1, 1, 1000], [5, 2, 1], [3, 3, 996]),
])
def test_targets(sizes, weights, want):
    assert mixing.targets(sizes, weights, 3) == pytest.approx(want)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_permutations_are_permutations(size):
    seen = set()
    for key in range(5):
        p = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, dtype=np.uint64))
        assert sorted(p.tolist()) == list(range(size))
        seen.add(tuple(p.tolist()))
    assert size < 4 or len(seen) > 1


def test_shards_add_up():
    slots = np.array([1000, 50, 0, 333])
    shards = [mixing.shard_counts(s, 22, slots, 64, 9) for s in range(22)]
    assert sum(c.sum() for _, c in shards) == slots.sum() and all(c.sum() <= 64 for _, c in shards)
    before = np.zeros(4, dtype=int)
    for first, counts in shards:
        assert (first == before).all()
        before += counts
    assert (before == slots).all()


def test_draws_of_any_size(monkeypatch):
    """The sampler for large ranges against exact probabilities, then moments beyond numpy's limit."""
    monkeypatch.setattr(mixing, "_NUMPY_DRAWS", 0)
    rng = np.random.default_rng(4)
    for good, bad, share in [(5, 7, 6), (300, 20, 40), (50, 5000, 700), (0, 9, 4), (9, 0, 4), (6, 3, 0), (6, 3, 9), (2000, 3000, 2500)]:
        n = 6000
        seen = np.bincount([mixing.hypergeometric(rng, good, bad, share) for _ in range(n)], minlength=min(good, share) + 1)
        whole = math.comb(good + bad, share)
        want = np.array([math.comb(good, x) * math.comb(bad, share - x) * n / whole if share >= x else 0 for x in range(len(seen))])
        assert (seen[want == 0] == 0).all()
        often = want >= 5
        chi = ((seen - want)[often] ** 2 / want[often]).sum()
        assert chi < often.sum() + 5 * np.sqrt(2 * often.sum()) + 5
    monkeypatch.undo()
    for good, bad, share in [(10**12, 3 * 10**12, 10**12), (5, 10**11, 10**10), (10**15, 10**15, 10**15), (10**10, 10**4, 5 * 10**9)]:
        total = good + bad
        drawn = np.array([mixing.hypergeometric(rng, good, bad, share) for _ in range(3000)], dtype=float)
        mean = share * good / total
        sd = np.sqrt(share * (good / total) * (bad / total) * ((total - share) / (total - 1)))
        assert abs(drawn.mean() - mean) < 5 * sd / np.sqrt(3000) + 1e-3
        assert drawn.std() == pytest.approx(sd, rel=0.1)


def test_shards_beyond_a_billion_slots_are_drawn():
    slots, shards, shard_slots = np.array([3 * 10**11, 10**11, 7]), 1 << 17, 4 * 10**11 // (1 << 17) + 1
    found = [mixing.shard_counts(s, shards, slots, shard_slots, 5) for s in range(64)]
    before = np.zeros(3, dtype=np.int64)
    for first, counts in found:
        assert (first == before).all() and (counts >= 0).all() and counts.sum() == shard_slots
        before += counts
    shares = np.array([c[0] / c.sum() for _, c in found])
    assert shares.mean() == pytest.approx(0.75, abs=1e-3)
    # drawn, not dealt in proportion: the shares differ as draws do
    assert shares.std() == pytest.approx(np.sqrt(0.75 * 0.25 / shard_slots), rel=0.4)


def test_mix(spark):
    rows = corpus()
    mix = mixing.Mix(files(spark, rows), block_words=16, shard_slots=128)
    drawn = mix.drawn.collect()
    assert len({(r["shard"], r["slot"]) for r in drawn}) == len(drawn)
    times = {}
    for r in drawn:
        times[r["source_no"], r["block"]] = times.get((r["source_no"], r["block"]), 0) + 1
    parts = mix.parts().collect()
    want = {}
    for p in parts:
        want[p["row"]] = want.get(p["row"], 0) + p["words"] * times.get((p["source_no"], p["block"]), 0)
    sizes = {}
    for p in parts:
        sizes[p["source_no"], p["block"]] = sizes.get((p["source_no"], p["block"]), 0) + p["words"]
    assert max(sizes.values()) == 16 and sum(n < 16 for n in sizes.values()) <= 5
    placed = {r["row"]: r for r in mix.placed.collect()}
    assert len(placed) == len(rows)
    taken = mix.taken().collect()
    assert sum(r["taken"] for r in taken) == sum(want.values())
    assert all(r["taken"] <= 3 * r["size"] for r in taken)
    for size, target in {(r["source_size"], r["target"]) for r in taken}:
        got = sum(r["taken"] for r in taken if r["source_size"] == size)
        assert got == pytest.approx(target, abs=40)
    again = mixing.Mix(files(spark, rows), block_words=16, shard_slots=128).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, taken))


def test_the_mix_does_not_depend_on_the_layout(spark):
    rows = [(k, *r[1:]) for k, r in enumerate(corpus(3))]
    draws = []
    for n in (1, 7):
        taken = mixing.Mix(files(spark, rows[:: 1 if n == 1 else -1]).repartition(n), block_words=16).taken()
        draws.append(sorted((r["file_id"], r["size"], r["taken"]) for r in taken.collect()))
    assert draws[0] == draws[1]


def test_copies_come_near_the_target(spark):
    rows = corpus(2)
    taken = mixing.Mix(files(spark, [(k, *r[1:]) for k, r in enumerate(rows)]), block_words=16).taken()
    copies = {r["file_id"]: r["copies"] for r in mixing.copies(taken).collect()}
    for size, target in {(r["source_size"], r["target"]) for r in taken.collect()}:
        got = sum(r["size"] * copies[r["file_id"]] for r in taken.collect() if r["source_size"] == size)
        assert got == pytest.approx(target, rel=0.25)
    assert all(0 <= n <= 3 for n in copies.values())


def test_edges(spark):
    taken = mixing.Mix(files(spark, EDGES)).taken().collect()
    assert len(taken) == len(EDGES) and all(r["taken"] <= 3 * r["size"] for r in taken)
    assert [r["size"] for r in taken if r["file_id"] in (3, 4, 5)] == [0, 0, 0]
    assert [r["size"] for r in taken if r["file_id"] == 6] == [270_000]
    for rows in ([], [(1, None, None)]):
        found = mixing.Mix(files(spark, rows)).taken().collect()
        assert [(r["size"], r["target"], r["taken"]) for r in found] == [(0, 0.0, 0)] * len(rows)
    assert [r["copies"] for r in mixing.copies(mixing.Mix(files(spark, [(1, None, None)])).taken()).collect()] == [1]
