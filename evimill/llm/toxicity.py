"""Toxic files by multiple-instance learning.

A file is a bag of sentences and only the file is labelled. Each sentence that holds a term of the
vocabulary is toxic with probability ``sigmoid(bias + sum of its terms' weights)``; the file is
toxic unless none of its sentences is (noisy-or), with a small leak for what no term shows::

    P(file) = 1 - (1 - leak) * product over sentences of (1 - p)

Terms are words and, marked by a star, beginnings of words, since inflected languages build many
forms on one stem. Weights are fitted to the labels of files alone, and afterwards say which
sentences offend.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.texts import per_text

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
SCORED = "score double, sentences array<struct<start: int, end: int, p: double>>"


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` by term, lower case; ``leak`` is the score of a file without any term."""

    weights: dict[str, float]
    bias: float
    leak: float


def terms_of(text: str) -> set[str]:
    """The distinct words in lower case, and their beginnings of each length in STEMS with a star."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({f"{word[:n]}*" for word in words if len(word) > n} for n in STEMS))


def sentence_terms(text: str, vocabulary) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct terms) of the sentences that hold a term; places in code points."""
    if vocabulary.keys().isdisjoint(terms_of(text)):
        return []
    found = []
    for sentence in SENTENCE.finditer(text):
        terms = sorted(vocabulary.keys() & terms_of(sentence.group()))
        if terms:
            found.append((sentence.start(), sentence.end(), terms))
    return found


def labelled_sample(files: DataFrame, labels: DataFrame, max_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``max_per_class`` files of either label, by hash of ``file_id``; counts of all labels.

    A file_id labelled twice counts as toxic if any label says so; of files that share an id the
    smallest text is taken.
    """
    known = (
        labels.where("file_id is not null and toxic is not null")
        .groupBy("file_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    totals = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("file_id"), "file_id").limit(max_per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    # 2 * max_per_class rows of an id and a flag at most
    sample = (
        files.select("file_id", "content")
        .join(F.broadcast(drawn), "file_id")
        .groupBy("file_id")
        .agg(F.min("content").alias("content"), F.max("toxic").alias("toxic"))
    )
    return sample, totals


def associated_terms(sample: DataFrame, totals: list[int], min_files: int, min_g: float) -> list[str]:
    """Terms that toxic files of the sample hold more often, by the likelihood ratio statistic."""
    words = per_text(lambda text: sorted(terms_of(text)), "array<string>", F.col("content"))
    counts = (
        sample.select("toxic", words.alias("words"))
        .select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"))
        .where(F.col("hit") >= min_files)
    )
    clean, toxic = (float(max(total, 1)) for total in totals)
    n, hit = F.col("n").cast("double"), F.col("hit").cast("double")
    miss = n - hit
    g = 2 * (
        hit * F.log(hit * (toxic + clean) / (n * toxic))
        + F.when(miss > 0, miss * F.log(miss * (toxic + clean) / (n * clean))).otherwise(0.0)
    )
    chosen = counts.where(hit / toxic > 2 * miss / clean).select("word", g.alias("g")).where(F.col("g") >= min_g)
    return [row["word"] for row in chosen.orderBy(F.desc("g"), "word").collect()]


def fit(
    files: DataFrame,
    labels: DataFrame,
    max_per_class: int = 4096,
    min_files: int = 3,
    min_g: float = 20.0,
    rounds: int = 400,
) -> ToxicityModel:
    """A model from ``files`` (file_id, content) and ``labels`` (file_id, toxic 0/1).

    Fitted on a bounded sample: ``max_per_class`` files of either label, which also bounds what
    reaches the driver (all terms with a statistic of ``min_g``, and those of each sentence); the classes are weighted back to their share
    of all labels. Without toxic labels the model knows no term and its leak is 0.
    """
    sample, totals = labelled_sample(files, labels, max_per_class)
    sample = sample.persist()
    try:
        drawn = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not drawn.get(1):
            return ToxicityModel({}, 0.0, 0.0)
        terms = associated_terms(sample, [drawn.get(0, 0), drawn[1]], min_files, min_g)
        places = {term: k for k, term in enumerate(terms)}

        def sentences(text: str) -> list[list[int]]:
            distinct = {tuple(places[t] for t in terms) for _, _, terms in sentence_terms(text, places)}
            return [list(x) for x in sorted(distinct)]

        bags = sample.select("file_id", "toxic", per_text(sentences, "array<array<int>>", F.col("content")).alias("bag"))
        rows = sorted((row["file_id"], row["toxic"], row["bag"]) for row in bags.collect())
    finally:
        sample.unpersist()
    share = {label: totals[label] / n for label, n in drawn.items()}
    weights, bias, leak = noisy_or([(bag, toxic, share[toxic]) for _, toxic, bag in rows], len(terms), rounds)
    return ToxicityModel(dict(zip(terms, weights.tolist(), strict=True)), bias, leak)


def noisy_or(bags, n_terms: int, rounds: int, rate: float = 0.1, ridge: float = 1e-3):
    """Weights, bias and leak that maximise the likelihood of the labels of bags, by full gradients."""
    y = np.array([toxic for _, toxic, _ in bags], dtype=float)
    weight = np.array([w for _, _, w in bags], dtype=float)
    silent = np.array([not bag for bag, _, _ in bags])
    leak = (weight @ (y * silent)) / max(weight @ silent, 1e-9) if silent.any() else 0.0
    leak = float(np.clip(leak, 0.0, 0.5))
    owner = np.array([k for k, (bag, _, _) in enumerate(bags) for _ in bag], dtype=int)
    pairs = [(s, t) for s, terms in enumerate(x for bag, _, _ in bags for x in bag) for t in terms]
    row, term = (np.array(x, dtype=int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    beta = np.concatenate([np.zeros(n_terms), [-1.0]])
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    weight = weight / max(weight.sum(), 1e-9)
    for step in range(1, rounds + 1):
        z = beta[-1] + np.bincount(row, beta[term], minlength=len(owner))
        none = np.log1p(-leak) + np.bincount(owner, -np.logaddexp(0, z), minlength=len(y))
        p = np.clip(-np.expm1(none), 1e-9, 1.0)
        pull = np.where(y > 0, -np.exp(none) / p, 1.0) * weight
        slope = pull[owner] / (1 + np.exp(-z))
        gradient = np.concatenate([np.bincount(term, slope[row], minlength=n_terms), [slope.sum()]])
        gradient[:-1] += ridge * beta[:-1] / max(n_terms, 1)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        beta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return beta[:-1], float(beta[-1]), leak


def toxicity(model: ToxicityModel, content: Column, offending: float = 0.5) -> Column:
    """struct(score, sentences): noisy-or over all sentences, and those of probability ``offending`` or more.

    A null or empty text scores the leak. Sentences give start and end in code points.
    """

    def score(text: str):
        none, offenders = 1.0 - model.leak, []
        for start, end, terms in sentence_terms(text, model.weights):
            p = 1.0 / (1.0 + float(np.exp(-(model.bias + sum(model.weights[t] for t in terms)))))
            none *= 1.0 - p
            if p >= offending:
                offenders.append({"start": start, "end": end, "p": p})
        return {"score": 1.0 - none, "sentences": offenders}

    return per_text(score, SCORED, content)


def held_out(file_id: Column) -> Column:
    """Every third file by crc32 of its id, never learnt from; a file without id is not held out."""
    return F.coalesce(F.crc32(file_id.cast("string")) % 3 == 1, F.lit(False))


def score_files(files: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """file_id, held_out, score, predicted (1 from ``threshold`` on), sentences; one row per row of ``files``.

    Reads file_id and content only, other columns do not matter. Repeated rows are scored alike.
    """
    scored = files.select("file_id", toxicity(model, F.col("content")).alias("found"))
    return scored.select(
        "file_id",
        held_out(F.col("file_id")).alias("held_out"),
        F.col("found.score").alias("score"),
        F.when(F.col("found.score") >= threshold, 1).otherwise(0).alias("predicted"),
        F.col("found.sentences").alias("sentences"),
    )
