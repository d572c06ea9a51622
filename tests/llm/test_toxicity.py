import random

import pytest
from cases import EDGES, files
from evimill.llm import toxicity


def corpus(n, seed=1):
    draw, rows, labels = random.Random(seed), [], []
    words = ["build", "parser", "unsafe", "block", "pointer", "index", "slice", "buffer", "you", "are", "an", "a"]
    for k in range(n):
        toxic = k % 5 == 0
        sentences = [" ".join(draw.choices(words, k=6)) + "." for _ in range(draw.randint(1, 12))]
        if toxic:
            at = draw.randrange(len(sentences))
            sentences[at] = f"you are {draw.choice(['an idiot', 'a moron', 'scummy', 'scumbags'])} {sentences[at]}"
        rows.append((k, "a", " ".join(sentences)))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus(600)
    return toxicity.fit(files(spark, rows), spark.createDataFrame(labels, "file_id bigint, toxic int"), min_g=8.0)


def test_held_out_accuracy(spark, model):
    rows, labels = corpus(300, seed=2)
    found = {r["file_id"]: r for r in toxicity.score_files(files(spark, rows), model).collect()}
    assert sum(found[k]["predicted"] == toxic for k, toxic in labels) >= 290
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_locates_sentences(spark, model):
    text = "parser block slice. You are an IDIOT parser. buffer index."
    (row,) = toxicity.score_files(files(spark, [(1, "a", text)]), model).collect()
    assert [text[s["start"] : s["end"]] for s in row["sentences"]] == [" You are an IDIOT parser."]


def test_noisy_or_is_that_of_its_sentences(spark, model):
    one, two = "an idiot here.", "a moron there."
    rows = toxicity.score_files(files(spark, [(1, "a", one), (2, "a", two), (3, "a", one + two)]), model).collect()
    a, b, both = (r["score"] for r in sorted(rows, key=lambda r: r["file_id"]))
    assert 1 - both == pytest.approx((1 - a) * (1 - b) / (1 - model.leak))


def test_edges(spark, model):
    rows = toxicity.score_files(files(spark, EDGES), model).collect()
    assert len(rows) == len(EDGES)
    assert all(r["score"] == pytest.approx(model.leak) and r["predicted"] == 0 for r in rows)
    assert [r["held_out"] for r in rows if r["file_id"] is None] == [False]


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([], "file_id bigint, toxic int")
    empty = toxicity.fit(files(spark, []), labels)
    assert not empty.weights and not toxicity.score_files(files(spark, []), empty).collect()
    assert toxicity.fit(files(spark, [(1, "a", "x")]), spark.createDataFrame([(1, None)], "file_id bigint, toxic int")) == empty


def test_sample_is_bounded_and_labels_may_conflict(spark):
    rows, labels = corpus(200)
    labels = spark.createDataFrame([*labels, (0, 0), (None, 1)], "file_id bigint, toxic int")
    sample, totals = toxicity.labelled_sample(files(spark, rows + rows), labels, 10)
    assert sorted(r["toxic"] for r in sample.collect()) == [0] * 10 + [1] * 10 and totals == {0: 160, 1: 40}


def test_every_associated_term_is_kept(spark):
    """However many there are: 400 words that only toxic files hold, none that all hold."""
    words = [f"slur{chr(97 + k // 26)}{chr(97 + k % 26)}q" for k in range(400)]
    toxic = [(k, 1, "you are " + " ".join(words) + ".") for k in range(30)]
    clean = [(100 + k, 0, "you are reading a parser.") for k in range(60)]
    sample = spark.createDataFrame([*toxic, *clean], "file_id bigint, toxic int, content string")
    found = toxicity.associated_terms(sample, [60, 30], 3, 20.0)
    assert set(words) <= set(found) and "you" not in found
