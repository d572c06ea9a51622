"""Scan of a text corpus with rules that are rows of a table.

A rule set of the code is one alternation. With thousands of rules such an alternation tries all of
them at every place, so here an index decides first which rules a file can match at all: a rule names
a literal that each of its matches holds, literals are found in the words of the corpus by their
rarest three letters, and each file is then searched with an alternation of its own few rules. What
a line costs depends on the rules that its file calls for, not on their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.operators.rows import explode_once
from evimill.operators.site_scan import SITES
from evimill.operators.skew import unique_keys

#: What an anchor consists of, and what the words of a text are.
_WORD = r"[\p{L}\p{N}_]++"
_GRAM = 3


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def _grams(word: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(word) - _GRAM + 1)
    return F.when(
        F.length(word) >= _GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(_GRAM))))
    ).otherwise(F.array().cast("array<string>"))


def _indexable(rules: DataFrame) -> Column:
    return F.coalesce(F.col("anchor").rlike(rf"^{_WORD}$") & (F.length("anchor") >= _GRAM), F.lit(False))


def words_of_rules(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(word, rule_id): which of the distinct ``words`` hold the anchor of which rule.

    Only words that have the rarest three letters of an anchor are compared with it.
    """
    grams = words.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    of_rules = rules.select("rule_id", "anchor", F.explode(_grams(F.col("anchor"))).alias("gram"))
    # three letters that no word has rule the anchor out, which is the rarest of all
    rarest = (
        of_rules.join(counts, "gram", "left")
        .groupBy("rule_id", "anchor")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .select("rule_id", "anchor", F.col("rarest.gram").alias("gram"))
    )
    return grams.join(unique_keys(rarest, ["rule_id", "anchor", "gram"]), "gram").filter(
        F.contains("word", "anchor")
    ).select("word", "rule_id")


def candidate_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(crate, file, rules): the rules with an anchor that a file can match, as (rule_id, rx)."""
    of_files = explode_once(files, ["crate", "file"], _words(F.col("content")), "pos", "word").drop("pos")
    anchored = rules.filter(_indexable(rules))
    hits = words_of_rules(of_files.select("word").distinct(), anchored)
    named = hits.join(anchored.select("rule_id", "rx"), "rule_id")
    return (
        of_files.join(unique_keys(named, ["word", "rule_id", "rx"]), "word")
        .groupBy("crate", "file")
        .agg(F.collect_set(F.struct("rule_id", "rx")).alias("rules"))
    )


def _sites(text: Column, rules: Column) -> Column:
    """Sites of a text under its own rules, the first of them that fits where several do."""
    alternation = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("(?:"), r["rx"], F.lit(")"))), "|")

    def rule_of(match: Column) -> Column:
        fits = F.filter(rules, lambda r: F.rlike(match, F.concat(F.lit("^(?:"), r["rx"], F.lit(")$"))))
        return F.try_element_at(fits, F.lit(1))["rule_id"]

    def line_sites(line: Column, at: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(line, alternation, F.lit(0)),
            lambda match, i: F.struct((at + 1).alias("line"), (i + 1).alias("seq"), rule_of(match).alias("rule_id")),
        )

    return F.filter(F.flatten(F.transform(F.split(text, "\n"), line_sites)), lambda site: site["rule_id"].isNotNull())


def scan_with_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(crate, file, sites) of ``files``: (crate, file, content), as :func:`site_scan.scan_files` gives them.

    ``rules``: rule_id int, kind, pattern, rx, anchor. ``rx`` finds the sites of a rule within a line,
    of several rules that match at one place the smallest rule_id counts; it captures no groups.
    ``anchor`` is a run of letters, digits and underscores, three at least, that every match holds. A
    rule without such an anchor is tried on every file, so their number is what lines pay for. A null
    text has no sites; the empty match of a rule is none.
    """
    found = candidate_rules(files, rules)
    everywhere = (
        rules.filter(~_indexable(rules)).agg(F.collect_list(F.struct("rule_id", "rx")).alias("rules")).select("rules").scalar()
    )
    none = F.array().cast("array<struct<rule_id: int, rx: string>>")
    joined = files.join(unique_keys(found, ["crate", "file", "rules"]), ["crate", "file"], "left").withColumn("everywhere", everywhere)
    called = F.array_sort(F.concat(F.coalesce("rules", none), "everywhere"))
    matched = joined.select("crate", "file", "content", called.alias("called"))
    sites = F.when(F.size("called") > 0, F.element_at(F.transform(F.array("called"), lambda c: _sites(F.col("content"), c)), 1))
    return matched.select("crate", "file", F.coalesce(sites, F.array().cast(SITES)).alias("sites"))


def table_site_rows(scanned: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per site: (crate, file, pos, line, seq, rule_id, kind, pattern)."""
    sites = explode_once(scanned, ["crate", "file"], F.col("sites"), "pos", "site").select("crate", "file", "pos", "site.*")
    return sites.join(unique_keys(rules, ["rule_id", "kind", "pattern"]), "rule_id")
