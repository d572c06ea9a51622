import random
import re
from collections import Counter

import numpy as np
from cases import EDGES, files
from evimill.llm import decision_lists
from pyspark.sql import functions as F


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(line in lines[:k] for k, line in enumerate(lines)),
        "n_repeat_words": len(repeated),
    }


def test_counts_match_the_definition():
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choices(["a", "b", "é ", " ", "\n", "\t", "# ", "x y", "||", "a b\n", "\U0001f600"], k=draw.randint(0, 60)))
        found = decision_lists.counts(text)
        assert {k: found[k] for k in slow(text)} == slow(text)


def corpus(n, seed=1):
    draw, rows, labels = random.Random(seed), [], []
    words = ["parse", "block", "pointer", "slice", "index", "buffer", "unsafe", "trait", "match", "macro"]
    for k in range(n):
        text = draw.choices(words, k=draw.randint(60, 200))
        good = k % 3 != 0
        if not good:
            text = [w + "###" for w in text] if draw.random() < 0.5 else text[:2] + [f"n{x}" for x in range(len(text))]
        rows.append((k, "a", " ".join(text)))
        labels.append((k, int(good)))
    return rows, labels


def test_learns_thresholds_that_hold_on_other_files(spark):
    rows, labels = corpus(600)
    rules = decision_lists.learn(files(spark, rows), spark.createDataFrame([*labels, (None, 0)], "file_id bigint, quality int"))
    assert rules and all(r.precision >= 0.9 and len(r.conditions) <= 4 for r in rules)
    rows, labels = corpus(200, seed=2)
    found = {r["file_id"]: r for r in decision_lists.judge_files(files(spark, rows), rules, max_repeated=100).collect()}
    right = [found[k]["kept"] == bool(good) for k, good in labels]
    assert sum(right) >= 0.95 * len(right)


def test_the_expression_is_the_list(spark):
    x = np.random.default_rng(1).random((300, len(decision_lists.FEATURES)))
    x[:, 0] = np.floor(x[:, 0] * 100)
    rules = decision_lists.covering(x, (x[:, 0] > 70) | ((x[:, 2] > 0.8) & (x[:, 3] < 0.5)), min_precision=0.6)
    assert rules
    names = dict.fromkeys(unit for _, unit in decision_lists.FEATURES.values() if unit)
    rows = [[float(v) for v in row] for row in x]
    frame = spark.createDataFrame(rows, ", ".join(f"f{k} double" for k in range(x.shape[1])))
    index = {name: k for k, name in enumerate(decision_lists.FEATURES)}
    assert names
    held = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        condition = F.lit(True)
        for c in rule.conditions:
            value = F.col(f"f{index[c.feature]}")
            condition &= value > c.threshold if c.above else value <= c.threshold
        held = F.when(condition, k).otherwise(held)
    spark_says = [r["v"] for r in frame.select(held.alias("v")).collect()]
    first = [next((k for k, rule in enumerate(rules, 1) if rule.holds(row[None])[0]), None) for row in x]
    assert spark_says == first


def test_edges(spark):
    labels = spark.createDataFrame([], "file_id bigint, quality int")
    assert decision_lists.learn(files(spark, EDGES), labels) == []
    only_good = spark.createDataFrame([(1, 1), (2, 1)], "file_id bigint, quality int")
    assert decision_lists.learn(files(spark, EDGES), only_good) == []
    rows = decision_lists.judge_files(files(spark, EDGES), []).collect()
    assert len(rows) == len(EDGES) and all(r["base_failed"] and not r["kept"] for r in rows)
    by_id = {r["file_id"]: r for r in rows}
    assert by_id[6]["n_words"] == 270_000 == by_id[6]["n_repeat_words"]
    assert [by_id[k]["n_words"] for k in (3, 4, 5)] == [0, 0, 0]
    assert not decision_lists.judge_files(files(spark, []), []).collect()
