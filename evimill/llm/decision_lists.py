"""Quality of files by learnt decision lists.

Rules are conjunctions of thresholds on counts and shares of a text. Sequential covering learns
them from labelled files: a rule is grown on part of the files still uncovered, one threshold at a
time, by information gain; conditions are pruned from its end while that helps on the other part;
the files it covers are taken out, and the next rule follows. What is learnt is an ordered list of
Spark expressions, the first that holds decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.texts import per_text

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes above which a word is long.
LONG = 24
COUNTED = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_distinct bigint, n_upper bigint, n_digits bigint, n_stops bigint, n_long bigint"
)
#: What rules may test: a count, or a count per unit.
FEATURES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_words": ("n_distinct", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"),
    "long_words": ("n_long", "n_words"),
}
WINDOW = 3


def counts(text: str) -> dict[str, int]:
    """All of COUNTED. Words end at ASCII white space, lines at line feeds; places do not matter."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeated = 0

    def without(kinds: bytes) -> int:
        return len(raw) - len(raw.translate(None, kinds))

    if n >= WINDOW:
        size = len(number)
        windows = ids[:-2] * size + ids[1:-1]
        if size < 1 << 20:
            windows = windows * size + ids[2:]
        else:  # three numbers no longer fit, so pairs are numbered first
            windows = np.unique(windows, return_inverse=True)[1] * size + ids[2:]
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(WINDOW):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "n_lines": len(lines),
        "n_distinct": len(number),
        "n_upper": without(CAPITALS),
        "n_digits": without(b"0123456789"),
        "n_stops": without(b".!?"),
        "n_long": sum(len(word) > LONG for word in words),
    }


def counted(content: Column) -> Column:
    """struct of COUNTED for each whole text; null counts as empty."""
    return per_text(counts, f"struct<{COUNTED}>", content)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, features: np.ndarray) -> np.ndarray:
        values = features[:, list(FEATURES).index(self.feature)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, counts: Column) -> Column:
        value = feature(counts, self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``precision`` as seen on the files it was not grown on."""

    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, features: np.ndarray) -> np.ndarray:
        held = np.ones(len(features), dtype=bool)
        for condition in self.conditions:
            held &= condition.holds(features)
        return held

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


def feature(counts: Column, name: str) -> Column:
    """A feature from the struct of counts; a share of nothing is 0."""
    top, unit = FEATURES[name]
    if unit is None:
        return counts[top].cast("double")
    return F.when(counts[unit] > 0, counts[top] / counts[unit]).otherwise(0.0)


def _grown(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> list[Condition]:
    """Conditions added one at a time by information gain, until all covered files are bad."""
    conditions: list[Condition] = []
    covered = np.ones(len(x), dtype=bool)
    while len(conditions) < most and (covered & ~bad).any():
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        best, chosen = 0.0, None
        for k, name in enumerate(FEATURES):
            values = x[covered, k]
            is_bad = bad[covered]
            for threshold in np.unique(np.quantile(values[is_bad], np.linspace(0, 1, cuts), method="nearest")):
                high = values > threshold
                for above in (True, False):
                    inside = high if above else ~high
                    p1 = int((inside & is_bad).sum())
                    if not p1:
                        continue
                    n1 = int((inside & ~is_bad).sum())
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                    if gain > best + 1e-9:
                        best, chosen = gain, Condition(name, above, float(threshold))
        if chosen is None:
            break
        values = x[covered, list(FEATURES).index(chosen.feature)]
        below, over = values[values <= chosen.threshold], values[values > chosen.threshold]
        if len(below) and len(over):  # midway in the gap, as far from either side as the sample allows
            chosen = Condition(chosen.feature, chosen.above, float(below.max() + over.min()) / 2)
        conditions.append(chosen)
        covered &= chosen.holds(x)
    return conditions


def _pruned(conditions: list[Condition], x: np.ndarray, bad: np.ndarray) -> Rule | None:
    """The beginning of the conditions that does best on files it was not grown on."""
    best, chosen = -2.0, None
    for n in range(1, len(conditions) + 1):
        rule = Rule(tuple(conditions[:n]), 0.0)
        held = rule.holds(x)
        p, m = int((held & bad).sum()), int(held.sum())
        worth = (2 * p - m) / m if m else -1.0
        if worth > best:
            best, chosen = worth, Rule(rule.conditions, p / m if m else 0.0)
    return chosen


def covering(
    x: np.ndarray, bad: np.ndarray, cuts: int = 48, most: int = 4, min_precision: float = 0.9, min_files: int = 3
) -> list[Rule]:
    """Rules in order, each learnt on what those before it leave uncovered.

    Of three rows two grow and one prunes. Learning ends when a rule covers fewer than ``min_files``
    bad rows, or is right in less than ``min_precision`` of the rows that pruned it.
    """
    grow = np.arange(len(x)) % 3 != 0
    left, rules = np.ones(len(x), dtype=bool), []
    while (left & grow & bad).sum() >= min_files:
        conditions = _grown(x[left & grow], bad[left & grow], cuts, most)
        rule = _pruned(conditions, x[left & ~grow], bad[left & ~grow]) if conditions else None
        if rule is None or rule.precision < min_precision:
            break
        held = rule.holds(x) & left
        if (held & bad).sum() < min_files:
            break
        rules.append(rule)
        left &= ~held
    return rules


def learn(files: DataFrame, labels: DataFrame, max_rows: int = 20_000, **settings) -> list[Rule]:
    """Rules from ``files`` (file_id, content) and ``labels`` (file_id, quality 0/1).

    Fitted on at most ``max_rows`` labelled files, drawn by hash of file_id, which bounds what
    reaches the driver: one row of counts each. Of labels of one file the lower counts, of files
    that share an id the smallest text. Without bad files there are no rules.
    """
    known = (
        labels.where("file_id is not null and quality is not null")
        .groupBy("file_id")
        .agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality"))
        .orderBy(F.xxhash64("file_id"), "file_id")
        .limit(max_rows)
    )
    sample = (
        files.select("file_id", "content")
        .join(F.broadcast(known), "file_id")  # max_rows rows of an id and a flag at most
        .groupBy("file_id")
        .agg(F.min("content").alias("content"), F.min("quality").alias("quality"))
        .select("file_id", "quality", counted(F.col("content")).alias("counts"))
        .select(
            F.xxhash64("file_id").alias("order"), "file_id", "quality",
            *(feature(F.col("counts"), name).alias(name) for name in FEATURES),
        )
    )
    # by hash, so that what grows and what prunes does not hang on how ids were given
    rows = sorted(sample.collect(), key=lambda row: (row["order"], row["file_id"]))
    if not rows:
        return []
    x = np.array([[row[name] for name in FEATURES] for row in rows], dtype=float)
    return covering(x, np.array([row["quality"] == 0 for row in rows]), **settings)


def decision(rules: list[Rule], counts: Column) -> Column:
    """The list as one conditional expression: number of the first rule that rejects from 1, or null."""
    expression = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        held = rule.conditions[0].column(counts)
        for condition in rule.conditions[1:]:
            held = held & condition.column(counts)
        expression = F.when(held, F.lit(k)).otherwise(expression)
    return expression


def judge_files(files: DataFrame, rules: list[Rule], min_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """One row per file: file_id, all counts, base_failed, rule, kept.

    ``files``: file_id, content; other columns are not read. base_failed: fewer than ``min_words``
    words, or more than ``max_repeated`` percent of them in repeated windows. ``rule`` is the number
    of the learnt rule that rejects, or null; ``kept`` needs neither. Null and empty texts fail.
    """
    found = files.select("file_id", counted(F.col("content")).alias("counts"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return (
        found.select("file_id", "counts.*", decision(rules, F.col("counts")).alias("rule"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
