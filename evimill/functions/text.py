"""Text functions shared by scans, logs and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimill.functions.vocabulary import EXCERPT_LIMIT, WHITESPACE


def _all_but(characters: str) -> str:
    """Regex class of every character but these, written as ranges.

    Much faster than a negated class: ``!-~`` comes first and settles most characters.
    """
    codes = sorted(ord(c) for c in characters)
    starts, ends = [0, *[c + 1 for c in codes]], [*[c - 1 for c in codes], 0x10FFFF]
    ranges = [f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends) if a <= b]
    return "[!-~" + "".join(ranges) + "]"


NON_SPACE = _all_but(WHITESPACE)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_any(text: Column, markers: list[str]) -> Column:
    """True if one of the markers occurs, ignoring the case of ASCII letters only.

    Java's ``(?i)`` folds ASCII alone, so no lower-cased copy of the text is made.
    """
    return text.rlike("(?i)" + "|".join(re.escape(m) for m in markers))


def contains_all(text: Column, markers: list[str]) -> Column:
    """True if every marker occurs, ignoring the case of ASCII letters only."""
    test = F.lit(True)
    for marker in markers:
        test = test & contains_any(text, [marker])
    return test


def trim_space(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def trim_space_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def trim_space_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def excerpt(text: Column) -> Column:
    """Trimmed text; beyond the byte limit only its last characters; null when blank."""
    trimmed = trim_space(text)
    return (
        F.when(trimmed == "", F.lit(None))
        .when(F.octet_length(trimmed) <= EXCERPT_LIMIT, trimmed)
        .otherwise(F.concat(F.lit("..."), F.right(trimmed, F.lit(EXCERPT_LIMIT))))
    )


def duration_label(ms: Column) -> Column:
    """``532ms``, ``1.5s`` or ``2m05s``.

    Seconds are the double ``ms / 1000`` printed with one decimal. When the tenths are
    in the balance (``ms`` ends in 50) the outcome hangs on whether the double lies above
    or below the decimal value. That is the remainder of ``ms * 2^s`` by 1000, where ``s``
    is the number of fraction bits of the double, and all of it is integer arithmetic.
    """
    floor_tenths = F.floor(ms / 100)
    bits = F.when(ms < 2000, F.lit(pow(2, 52, 1000)))
    for fraction_bits, limit in ((51, 4000), (50, 8000), (49, 16000), (48, 32000)):
        bits = bits.when(ms < limit, F.lit(pow(2, fraction_bits, 1000)))
    remainder = (ms % 1000) * bits.otherwise(F.lit(pow(2, 47, 1000))) % 1000
    on_tie = (
        F.when(remainder == 0, floor_tenths % 2).when(remainder > 500, F.lit(1)).otherwise(F.lit(0))
    )
    round_up = F.when(ms % 100 > 50, F.lit(1)).when(ms % 100 < 50, F.lit(0)).otherwise(on_tie)
    tenths = (floor_tenths + round_up).cast("bigint")
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(
            ms < 60000,
            F.concat(
                F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")
            ),
        )
        .otherwise(
            F.concat(
                F.floor(seconds / 60).cast("string"),
                F.lit("m"),
                F.lpad((seconds % 60).cast("string"), 2, "0"),
                F.lit("s"),
            )
        )
    )


def file_safe(name: Column) -> Column:
    """Every character outside ``[A-Za-z0-9_-]`` becomes ``_``."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_")


def package_key(name: Column) -> Column:
    """Name under which two package spellings are the same."""
    return F.translate(name, "_", "-")


def log_path(crate: Column, phase: Column, name: Column) -> Column:
    """Where the log of one run lies below the output root."""
    return F.concat(
        F.lit("crates/"), file_safe(crate), F.lit("/logs/"),
        file_safe(phase), F.lit("."), file_safe(name), F.lit(".log"),
    )


def file_url_path(url: Column) -> Column:
    """Path of a ``file://`` URL: percent-decoded, cut at the first ``#``; null if it is none.

    ``+`` stays a plus sign, and a ``%`` too close to the end for two digits stays as it is.
    """
    encoded = F.regexp_replace(F.substring(url, F.lit(8), F.length(url)), r"%(?=[\x00-\x7F]?$)", "%25")
    decoded = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return F.when(F.startswith(url, F.lit("file://")), F.substring_index(decoded, "#", 1))


def env_pair(text: Column) -> Column:
    """``struct(key, value)`` split at the first ``=``; null when there is none."""
    at = F.instr(text, "=")
    return F.when(
        at > 0,
        F.struct(
            F.substring(text, F.lit(1), at - 1).alias("key"),
            F.substring(text, at + 1, F.length(text)).alias("value"),
        ),
    )


def env_overlay(*layers: Column) -> Column:
    """Merge string maps; where a key occurs in more than one, the later layer wins.

    Works under every setting of ``spark.sql.mapKeyDedupPolicy``: keys are disjoint
    before they are concatenated.
    """
    empty = F.create_map().cast("map<string,string>")
    merged = F.coalesce(layers[0], empty)

    def put_over(lower: Column, upper: Column) -> Column:
        kept = F.map_filter(lower, lambda key, _: ~F.map_contains_key(upper, key))
        return F.map_concat(kept, upper)

    for layer in layers[1:]:
        merged = put_over(merged, F.coalesce(layer, empty))
    return merged


def env_text(env: Column) -> Column:
    """``k=v, k=v`` sorted by key, ``-`` when empty."""
    pairs = F.transform(
        F.array_sort(F.map_entries(env)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.coalesce(F.nullif(F.array_join(pairs, ", "), F.lit("")), F.lit("-"))


def argv_text(program: Column, args: Column) -> Column:
    """A command line for display."""
    return F.array_join(F.concat(F.array(program), args), " ")


def lossy_text(content: Column) -> Column:
    """Bytes as text, every invalid UTF-8 sequence replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def escape_bars(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def table_cell(text: Column) -> Column:
    """Text that fits one Markdown table cell."""
    return F.replace(escape_bars(text), F.lit("\n"), F.lit(" "))


#: Options under which Spark's JSON reader takes no more than the standard allows.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_valid(text: Column) -> Column:
    """True if the whole text is one JSON value.

    A JSON reader stops after the first value, so trailing text is caught by wrapping: the
    text must be the only element of an array and the only value of an object.
    """
    as_element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT_JSON)
    as_value = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", STRICT_JSON)
    # Only a bracket in the text can close the array early.
    stays_inside = ~F.contains(text, F.lit("]")) | as_value.isNotNull()
    return F.coalesce((F.size(as_element) == 1) & stays_inside, F.lit(False))
