import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import EDGES, files
from evimill.llm import packing, tokens
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def defining():
    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_those_of_the_library(defining):
    draw = random.Random(5)
    pools = ["abc  \n\t.,'!?019", "é\x1c\x85\xa0'slm", "漢字 Ж١  ", "<|endoftext|> a", "\U0001f600 x"]
    for pool in pools:
        for _ in range(300):
            text = "".join(draw.choices(pool, k=draw.randint(0, 40))) + draw.choice(["", "<|endoftext|>b"])
            assert tokens.token_ids(VOCABULARY, text).tolist() == defining.encode(text, add_special_tokens=False).ids


def check(lengths, sequence, offset, tokens_, documents, attention):
    bins = defaultdict(list)
    for n, s, o in zip(lengths, sequence, offset):
        bins[s].append((o, n))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces[:-1]]]).tolist()
        assert sum(n for _, n in pieces) <= tokens_ and len(pieces) <= documents
        assert sum(n * n for _, n in pieces) <= attention
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(1000, 100**2), (3, 100**2), (1000, 5000)])
def test_every_capacity_holds(rule, documents, attention):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 70, 800)
    sequence, offset = packing.best_fit(lengths, 100, documents, attention, rule=rule)
    n = check(lengths, sequence, offset, 100, documents, attention)
    least = max(lengths.sum() / 100, len(lengths) / documents, (lengths**2).sum() / attention)
    assert n <= 1.25 * least + 1


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5]), 10, 1, 24)


def test_pieces():
    ids = np.arange(25, dtype=np.uint32)
    assert [(p["start"], p["length"]) for p in packing.pieces(ids, 10)] == [(0, 5), (5, 10), (15, 10)]
    assert [(p["start"], p["length"]) for p in packing.pieces(ids[:20], 10)] == [(0, 10), (10, 10)]
    assert [(p["start"], p["length"]) for p in packing.pieces(ids[:10], 10)] == [(0, 10)]


def test_packed_files(spark, defining):
    draw = random.Random(6)
    rows = [(k, "a", " ".join(draw.choices(["unsafe", "block", "pointer", "λx"], k=draw.randint(0, 150)))) for k in range(300)]
    rows += EDGES
    found = packing.pack_files(files(spark, rows), VOCABULARY, length=128, shard_tokens=8_000).collect()
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        check([p["length"] for p in pieces], [0] * len(pieces), [p["offset"] for p in pieces], 128, 1024, 128**2)
    want = []
    for k, _, text in rows:
        ids = [*defining.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 128 or 128
        cuts = [0, len(ids)] if len(ids) <= 128 else [0, *range(first, len(ids) + 1, 128)]
        want += [
            (k, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
            for n, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(want, key=key) == sorted((tuple(r)[:5] for r in found), key=key)
    assert len(by_sequence) <= 1.05 * sum(w[3] for w in want) / 128 + 8
    assert not packing.pack_files(files(spark, []), VOCABULARY).collect()


def test_tiny_files_fill_whole_sequences(spark):
    """4,096 empty texts of one end token are two full sequences; a smaller attention capacity binds."""
    rows = spark.range(4096).selectExpr("id AS file_id", "'' AS content")
    packed = packing.pack_files(rows, VOCABULARY)
    assert packed.select("sequence_id").distinct().count() == 2
    words = spark.range(40).selectExpr("id AS file_id", "repeat('word ', 100) AS content")
    free = packing.pack_files(words, VOCABULARY).select("sequence_id").distinct().count()
    tight = packing.pack_files(words, VOCABULARY, attention=2 * 102 * 102)
    assert {r["count"] for r in tight.groupBy("sequence_id").count().collect()} == {2} and free == 2
