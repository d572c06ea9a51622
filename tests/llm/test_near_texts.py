import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
from cases import EDGES, documents, files
from evimill.llm import near_texts
from test_simhash import slow_fingerprint

SEED = 11
WORDS = [f"word{k}" for k in range(4000)]


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    sets, parent = [slow_set(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(set)
    for k in range(len(texts)):
        groups[root(k)].add(k)
    return sorted(map(sorted, groups.values()))


def changed(draw, words, n):
    words = list(words)
    for k in draw.sample(range(len(words)), n):
        words[k] = draw.choice(WORDS)
    return " ".join(words)


def found_groups(spark, texts):
    groups = defaultdict(set)
    for r in near_texts.near_texts(files(spark, [(k, "a", t) for k, t in enumerate(texts)])).collect():
        groups[r["component"]].add(r["file_id"])
    return sorted(map(sorted, groups.values()))


def test_groups_match_brute_force(spark):
    draw = random.Random(SEED)
    texts = ["", None, " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = draw.choices(WORDS, k=draw.randint(60, 300))
        texts += [changed(draw, base, max(1, len(base) * share // 1000)) for share in (0, 5, 10, 15, 20, 25, 40)]
    assert found_groups(spark, texts) == slow_groups(texts)


def test_crowd_takes_few_pairs(spark, monkeypatch):
    """Texts of any number of edits on one base, in blocks much smaller than the crowd."""
    draw = random.Random(SEED)
    base = draw.choices(WORDS, k=150)
    texts = [changed(draw, base, 1) for _ in range(120)] + [changed(draw, base, k) for k in range(2, 12) for _ in range(8)]
    compared, whole, all_links = [], near_texts.confirmed, near_texts.links

    def counted(pairs, sets):
        compared.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(near_texts, "confirmed", counted)
    monkeypatch.setattr(near_texts, "links", lambda buckets, sets: all_links(buckets, sets, crowd=30))
    assert found_groups(spark, texts) == slow_groups(texts)
    assert len(compared) == 3 and sum(compared) < 6 * len(texts)


def test_sketches_never_lose_a_similar_pair():
    draw = random.Random(SEED)
    texts = []
    for n in (5, 6, 30, 150, 900, 4000):
        base = draw.choices(WORDS, k=n)
        texts += [changed(draw, base, max(0, n * share // 200)) for share in range(0, 12, 2)]
        texts += [" ".join([*base, *draw.choices(WORDS, k=n // 8)]), " ".join(base[n // 10 :])]
    sets = [near_texts.shingles(t) for t in texts]
    n, bits = np.array([len(s) for s in sets]), [near_texts.sketch(s) for s in sets]
    everything = np.arange(len(sets))
    near = near_texts.sifted(n, bits, everything, everything)
    similar = np.array([[near_texts.similar(a, b) for b in sets] for a in sets])
    assert not (similar & ~near).any() and similar.sum() > 100 and (near & ~similar).sum() < 60


def test_stage_drops_copies_that_three_bits_miss(spark):
    draw = random.Random(SEED)
    rows, missed = [], 0
    for k in range(40):
        base = draw.choices(WORDS, k=300)
        near = changed(draw, base, 4)
        missed += (slow_fingerprint(" ".join(base)) ^ slow_fingerprint(near)).bit_count() > 3
        rows += [(2 * k, " ".join(base), "en", "a"), (2 * k + 1, near, "en", "a")]
    assert missed > 10
    left = corpus_pipeline.near_copies_out(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [2 * k for k in range(40)]


def test_stage_drops_what_fingerprints_link(spark):
    """A phrase repeated in two texts: fingerprints within three bits, sets of shingles mostly apart."""
    draw = random.Random(SEED)
    said = "one phrase again and over " * 200
    texts = [said + " ".join(draw.choices(WORDS, k=12)) for _ in range(2)]
    texts += [" ".join(draw.choices(WORDS, k=60)) for _ in range(3)]
    prints = [slow_fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and len(slow_groups(texts)) == 5
    assert len(found_groups(spark, texts)) == 5
    left = corpus_pipeline.near_copies_out(spark, documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3, 4]


def test_edges(spark):
    rows = near_texts.near_texts(files(spark, EDGES)).collect()
    by_id = {r["file_id"]: r["component"] for r in rows}
    assert len(rows) == len(EDGES) and by_id[1] == by_id[2] and by_id[3] == by_id[4] == by_id[5]
    assert len({by_id[k] for k in (1, 3, 6, 7, None)}) == 5
    assert not near_texts.near_texts(files(spark, [])).collect()
    assert not len(near_texts.shingles("")) and near_texts.bands(np.zeros(0, np.uint64)) == []
