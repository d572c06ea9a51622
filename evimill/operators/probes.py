"""Probes: one test run over every item of a corpus.

A probe is a column expression ``struct(verdict, n)`` with verdict ``ok``, ``error`` or
``skipped``; all probes of an item are computed in one pass over its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.functions.text import NON_SPACE, json_valid, trim_space
from evimill.operators.rows import explode_once

# Verdicts from least to most severe.
VERDICTS = ["skipped", "ok", "error"]

# Leading bytes of binary formats, in hex.
MAGIC_BYTES = [
    ("elf", ["7F454C46"]),
    ("pe", ["4D5A"]),
    ("mach", ["FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"]),
    ("archive", ["213C617263683E0A"]),
    ("te", ["565A"]),
]


def verdict(passed: Column, n: Column, skipped: Column | None = None) -> Column:
    label = F.when(passed, F.lit("ok")).otherwise(F.lit("error"))
    if skipped is not None:
        label = F.when(skipped, F.lit("skipped")).otherwise(label)
    return F.struct(label.alias("verdict"), n.cast("bigint").alias("n"))


# ---- bytes and text ---------------------------------------------------------------------


def utf8_ok(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _byte_offset(text: Column, position: Column) -> Column:
    """0-based byte offset of a 1-based character position, null for position 0."""
    return F.when(position > 0, F.octet_length(F.left(text, position - 1)))


def first_offset(text: Column, needle: str) -> Column:
    return F.lit(0) if needle == "" else _byte_offset(text, F.instr(text, needle))


def last_offset(text: Column, needle: str) -> Column:
    from_end = F.instr(F.reverse(text), needle[::-1])
    position = F.length(text) - from_end - (len(needle) - 2)
    return _byte_offset(text, F.when(from_end > 0, position).otherwise(F.lit(0)))


def any_offset(text: Column, characters: str) -> Column:
    """Offset of the first occurrence of any of the characters."""
    before = F.regexp_extract(text, f"^[^{re.escape(characters)}]*", 0)
    return F.when(before != text, F.octet_length(before))


def occurrences(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    shorter = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return F.floor((F.length(text) - shorter) / len(needle)).cast("bigint")


def line_count(text: Column) -> Column:
    """Lines; a newline at the very end starts no further one."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    unfinished = (text != "") & ~F.endswith(text, F.lit("\n"))
    return newlines + unfinished.cast("int")


def field_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.size(F.regexp_extract_all(text, F.lit(f"{NON_SPACE}+"), F.lit(0)))


def word_count(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def grapheme_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0)))


def binary_kind(content: Column) -> Column:
    """Kind of a binary file by its leading bytes."""
    head = F.hex(F.substring(content, 1, 8))
    ladder = F.when(_starts(head, MAGIC_BYTES[0][1]), F.lit(MAGIC_BYTES[0][0]))
    for kind, magics in MAGIC_BYTES[1:]:
        ladder = ladder.when(_starts(head, magics), F.lit(kind))
    return ladder.otherwise(F.lit("unknown"))


def _starts(head: Column, magics: list[str]) -> Column:
    return head.rlike("^(?:" + "|".join(magics) + ")")


# ---- prefixes ---------------------------------------------------------------------------


def prefixes(text: Column) -> dict[str, Column]:
    """What can be read off the start of a text; null where it does not begin that way."""

    def extract(pattern: str, group: int) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))

    return {
        "leading_int": extract(r"^[0-9]+", 0).try_cast("bigint"),
        "leading_space": F.length(F.regexp_extract(text, r"^[ \t\r\n]*", 0)),
        "until_dash": F.regexp_extract(text, r"^[^-]*", 0),
        "bracketed": extract(r"^\[([^\]]*)\]", 1),
        "pair_key": extract(r"^([A-Za-z]*):[^\n]*", 1),
        "pair_value": extract(r"^[A-Za-z]*:([^\n]*)", 1),
    }


# ---- JSON -------------------------------------------------------------------------------


def json_mutations(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, variant, candidate): the text, its first half, and the text with a stray brace."""
    whole = F.col(text)
    half = F.left(whole, F.floor(F.length(whole) / 2).cast("int"))
    variants = [("whole", whole), ("half", half), ("trailing", F.concat(whole, F.lit("\n{")))]
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("candidate")) for n, c in variants])
    return items.select(key, F.inline(pairs))


def leading_json_lines(text: Column) -> Column:
    """Number of valid values at the start of newline-delimited JSON."""
    lines = F.filter(F.split(text, "\n"), lambda s: trim_space(s) != "")
    first_bad = F.array_position(F.transform(lines, json_valid), False)
    return F.when(first_bad > 0, first_bad - 1).otherwise(F.size(lines)).cast("bigint")


# ---- markup -----------------------------------------------------------------------------


_MARKUP_NAME = r"[A-Za-z_:][-A-Za-z0-9_:.]*+"
#: What follows the name in a start tag: values in either kind of quotes may hold any sign.
_INSIDE_TAG = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++))?+"""
#: Elements whose content is text up to their own end tag, whatever it looks like.
_RAW = "(?i:(script|style))"
#: Tokens in the order they are tried; what is open at the end of the text runs to the end.
_TOKENS = {
    "comment": r"<!--[\s\S]*?(?:-->|\z)",
    "cdata": r"<!\[CDATA\[[\s\S]*?(?:\]\]>|\z)",
    "declaration": rf"<[!?][A-Za-z]{_INSIDE_TAG}>",
    "raw": rf"<{_RAW}(?=[\s/>]){_INSIDE_TAG}(?<!/)>[\s\S]*?(?=</(?i:\1)[\s/>]|\z)",
    "end": rf"</{_MARKUP_NAME}[^<>]*+>",
    "start": rf"<{_MARKUP_NAME}(?=[\s/>]){_INSIDE_TAG}>",
    "text": r"(?:[^<]++|<(?![A-Za-z_:/!?]))++",
    "stray": "<",
}
_START = rf"^<({_MARKUP_NAME})(?=[\s/>])({_INSIDE_TAG})>"


def markup_tokens(html: Column) -> Column:
    """The tokens of a text in order, found in one pass; together they are the whole text."""
    return F.regexp_extract_all(html, F.lit("|".join(_TOKENS.values())), F.lit(0))


def _is_start(token: Column) -> Column:
    """Start tags, those of raw elements with what they hold included."""
    return token.rlike(_START)


def token_kind(token: Column) -> Column:
    """What a token of ``markup_tokens`` is; an element with raw text is a start tag here."""
    return (
        F.when(F.startswith(token, F.lit("<!--")), F.lit("comment"))
        .when(F.startswith(token, F.lit("<![")), F.lit("cdata"))
        .when(token.rlike(r"^<[!?]."), F.lit("declaration"))
        .when(token.rlike(r"^</."), F.lit("end"))
        .when(_is_start(token), F.lit("start"))
        .when(token != "<", F.when(token.rlike(r"[^ \t\r\n]"), F.lit("text")).otherwise(F.lit("blank")))
        .otherwise(F.lit("stray"))
    )


def tag_counts(pages: DataFrame, html: str) -> DataFrame:
    """Start tags by their full name."""
    starts = F.filter(markup_tokens(F.col(html)), _is_start)
    names = F.transform(starts, lambda token: F.regexp_extract(token, _START, 1))
    return explode_once(pages, [], names, "pos", "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def attribute_counts(pages: DataFrame, html: str) -> DataFrame:
    """Attributes of start tags by name: quoted either way, unquoted, or without a value."""

    def attributes(token: Column) -> Column:
        return F.regexp_extract_all(F.regexp_extract(token, _START, 2), F.lit(_ATTRIBUTE), F.lit(1))

    starts = F.filter(markup_tokens(F.col(html)), _is_start)
    found = explode_once(pages, [], F.flatten(F.transform(starts, attributes)), "pos", "attribute")
    return found.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))


def event_counts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Events a reader of the markup would see, per item; ``raw_texts`` are those of scripts and styles."""
    tokens = pages.select(key, markup_tokens(F.col(html)).alias("tokens"))
    kinds = tokens.select(
        key,
        F.transform("tokens", token_kind).alias("kinds"),
        F.filter("tokens", lambda t: t.rlike(rf"^<{_RAW}[\s/>]") & (trim_space(F.regexp_replace(t, _START, "")) != "")).alias("raw"),
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")

    return kinds.select(
        key,
        count("start").alias("start_tags"),
        count("end").alias("end_tags"),
        count("comment").alias("comments"),
        count("cdata").alias("cdata"),
        count("declaration").alias("declarations"),
        count("text").alias("texts"),
        F.size("raw").cast("bigint").alias("raw_texts"),
    )


# ---- running and rolling up ---------------------------------------------------------------


def run_probes(items: DataFrame, key: str, probes: dict[str, Column]) -> DataFrame:
    """(item_id, probe, verdict, n), every item read once whatever the number of probes."""
    results = F.array(
        *[
            F.struct(F.lit(name).alias("probe"), result["verdict"].alias("verdict"), result["n"].alias("n"))
            for name, result in probes.items()
        ]
    )
    return items.select(F.col(key).alias("item_id"), F.inline(results))


def probe_rollup(results: DataFrame) -> DataFrame:
    """Counts per probe, and its status: the most severe verdict of any item."""
    severity = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    worst = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.col("worst").cast("int"))
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS]
    rolled = results.groupBy("probe").agg(
        F.max(severity).alias("worst"), *counts, F.sum("n").alias("total")
    )
    return rolled.select("probe", worst.alias("status"), *[f"n_{v}" for v in VERDICTS], "total")


def probe_texts(items: DataFrame, key: str, text: Column) -> DataFrame:
    """Probes of plain text; what more than one of them needs is computed once per item."""
    looks_like_json = F.startswith(text, F.lit("{"))
    measured = items.select(
        key,
        first_offset(text, "the").alias("at"),
        occurrences(text, "the").alias("occurrences"),
        field_count(text).alias("fields"),
        line_count(text).alias("lines"),
        F.when(looks_like_json, json_valid(text)).alias("json"),
        F.length(text).alias("length"),
    )
    return run_probes(
        measured,
        key,
        {
            "find": verdict(F.col("at").isNotNull(), F.coalesce("at", F.lit(0))),
            "count": verdict(F.lit(True), F.col("occurrences")),
            "fields": verdict(F.col("fields") > 0, F.col("fields")),
            "lines": verdict(F.lit(True), F.col("lines")),
            "json": verdict(F.col("json"), F.col("length"), skipped=F.col("json").isNull()),
        },
    )


def probe_json_texts(items: DataFrame, key: str, text: Column) -> DataFrame:
    """Probes of texts that should be JSON."""
    measured = items.select(
        key,
        json_valid(text).alias("valid"),
        F.get_json_object(text, "$.k").isNotNull().alias("has_field"),
        F.length(text).alias("length"),
    )
    return run_probes(
        measured,
        key,
        {
            "json_whole": verdict(F.col("valid"), F.col("length"), skipped=F.col("length") == 0),
            "json_field": verdict(F.col("has_field"), F.col("length"), skipped=~F.col("valid")),
        },
    )
