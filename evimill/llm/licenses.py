"""Licenses named in files, by ordered signature rules.

A text is reduced to its words. Only where it holds the keyword of some rule are the rules looked
at, and of these only those whose keyword occurs. What they match are intervals of words; an
interval inside another one that ranks the same or higher is suppressed, which leaves "CC BY-NC-SA"
and drops the "CC BY" in it. All of it is built-in column functions within the row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.license_rules import SignatureRule, signature_rules

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of either case; they become lower case later.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DETECTION = "struct<start: int, end: int, priority: int, rule: int, label: string, confidence: double, base: boolean>"
PRIORITIES = 5


def signal(rules: list[SignatureRule]) -> str:
    """The gate of ``rules``: any of their keywords at the start of a word, so whatever a rule can match passes.

    Most places of a text fall to the word start or the first letter, before a keyword is tried.
    """
    keywords = sorted({start for rule in rules for start in rule.starts()})
    letters = sorted({c for k in keywords for c in (k[0], k[0].upper())})
    tried = "|".join(re.escape(k).replace(r"\ ", GAP) for k in keywords)
    return f"(?<!{WORD[:-1]})(?=[{''.join(letters)}])(?i:{tried})"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Detections of one rule: what lies between its matches says how many words come before each."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    matches = F.regexp_extract_all(words, pattern, F.lit(0))
    between = F.split(words, pattern, -1)

    def add(state: Column, match: Column) -> Column:
        start = state["spaces"] + _spaces(F.element_at(between, F.size(state["found"]) + 1)) - 1
        end = start + _spaces(match) + 1
        detection = F.struct(
            start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base"),
        )
        return F.struct(end.alias("spaces"), F.concat(state["found"], F.array(detection)).alias("found"))

    start = F.struct(F.lit(0).alias("spaces"), F.array().cast(f"array<{DETECTION}>").alias("found"))
    return F.aggregate(matches, start, add, lambda state: state["found"])


def _unsuppressed(detections: Column) -> Column:
    """Without those inside an earlier or longer one of the same or a higher rank, in one pass.

    By start, longest first: an interval is inside an earlier one exactly if that one's end is not
    before its own, so the furthest end of each rank is all there is to remember.
    """
    ordered = F.array_sort(
        detections,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .when(a["priority"] != b["priority"], a["priority"] - b["priority"])
        .otherwise(a["rule"] - b["rule"]),
    )

    def add(state: Column, x: Column) -> Column:
        ranked = F.slice(state["ends"], 1, x["priority"] + 1)
        inside = (F.array_max(ranked) >= x["end"]) & ~x["base"]
        ends = F.transform(
            state["ends"], lambda end, k: F.when(k == x["priority"], F.greatest(end, x["end"])).otherwise(end)
        )
        kept = F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(x)))
        return F.struct(ends.alias("ends"), kept.alias("kept"))

    start = F.struct(
        F.array_repeat(F.lit(-1), PRIORITIES).alias("ends"), F.array().cast(f"array<{DETECTION}>").alias("kept")
    )
    return F.aggregate(ordered, start, add, lambda state: state["kept"])


def detections(content: Column, rules: list[SignatureRule]) -> Column:
    """array of DETECTION by start; null where no keyword occurs. Places are numbers of words, end exclusive."""
    table = json.dumps([{"rule": k, **rule._asdict()} for k, rule in enumerate(rules)])
    kind = "array<struct<rule: int, label: string, keyword: string, pattern: string, priority: int, confidence: double, base: boolean>>"
    all_rules = F.from_json(F.lit(table), kind)
    lower = F.translate(content, CAPITALS, SMALL)
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), " "), F.lit(" "))

    def tried(words: Column) -> Column:
        gated = F.filter(all_rules, lambda rule: F.contains(words, rule["keyword"]))
        return _unsuppressed(F.flatten(F.transform(gated, lambda rule: _places(words, rule))))

    # an array of one text, so that the words are put together once and named in the functions above
    found = F.element_at(F.transform(F.array(words), tried), 1)
    return F.when(content.rlike(signal(rules)), found)


def scan_licenses(files: DataFrame, rules: list[SignatureRule] | None = None) -> DataFrame:
    """One row per file: file_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``files``: file_id, content; other columns are not read. n_base counts the places of base rules,
    first_word and last_word are their smallest and largest start or null; the labels are distinct,
    sorted and joined by commas; score is the highest confidence of what was not suppressed, or 0.
    Null texts are empty; rows do not depend on each other.
    """
    text = F.coalesce("content", F.lit(""))
    found = files.select(
        "file_id",
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint").alias("n_words"),
        F.coalesce(detections(text, rules or signature_rules()), F.array().cast(f"array<{DETECTION}>")).alias("found"),
    )
    base = F.filter("found", lambda x: x["base"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")

    return found.select(
        "file_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
        F.col("found").alias("detections"),
    )
