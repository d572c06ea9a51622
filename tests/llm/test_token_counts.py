import random

import public_tokenizers
import pytest
from cases import EDGES, files
from evimill.llm import token_counts
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def defining():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("pool", [
    "abcdefghij  \n\t.,'!?0123", "etaoinshrdlu", "aab", "the ing tion of' re'll",
    "abc \x1c\x1f\x85\xa0\x0b\x0c'sldm", "éèñß çÉà ˚µª²½́ a1ΣσςİΑ ", "漢字 тест Ж١  　a'S",
    "<|endoftext|> a", "\U0001f600️x À̧",
])
def test_counts_are_those_of_the_library(defining, pool):
    draw, counter = random.Random(pool), token_counts.counter(VOCABULARY)
    for _ in range(500):
        text = "".join(draw.choices(pool, k=draw.randint(0, 60)))
        if draw.random() < 0.1:
            text += "<|endoftext|>" + text[:5] + "<|startoftext|>"
        want = len(defining.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == want
        assert counter.count(text, draw.choice([1, 2, 7])) == want  # however it is cut


def test_maps_compose_associatively():
    draw, counter = random.Random(2), token_counts.counter(VOCABULARY)
    for _ in range(200):
        a, b, c = (counter.chunk("".join(draw.choices("ab'c d", k=draw.randint(0, 9)))) for _ in range(3))
        assert counter.composed(counter.composed(a, b), c) == counter.composed(a, counter.composed(b, c))


def test_transducer_starts_anew_when_full(monkeypatch, defining):
    monkeypatch.setattr(token_counts, "MOST_STATES", 20)
    monkeypatch.setattr(token_counts, "MOST_WORDS", 5)
    counter = token_counts.Counter(VOCABULARY)
    draw = random.Random(3)
    for _ in range(60):
        text = " ".join("".join(draw.choices("etaoin", k=8)) for _ in range(5))
        assert counter.count(text) == len(defining.encode(text).ids)


def test_edges(spark, defining):
    rows = token_counts.count_tokens(files(spark, EDGES), VOCABULARY).collect()
    want = []
    for k, _, text in EDGES:
        n = len(defining.encode(text or "", add_special_tokens=False).ids)
        want.append((k, len((text or "").encode()), n, n > 2048))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert not token_counts.count_tokens(files(spark, []), VOCABULARY).collect()
