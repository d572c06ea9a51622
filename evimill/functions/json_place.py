"""Where a text stops being JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "[0-9]"
_EXPONENT = rf"[eE][+-]?+{_DIGITS}*+"
_BEHIND_INTEGER = rf"(?:\.(?:{_DIGITS}++(?:{_EXPONENT})?+)?+|{_EXPONENT})?+"
_INTEGER = rf"(?:0|[1-9]{_DIGITS}*+)"
_IN_STRING = r"""(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*+"""
#: Each token as far as it can be one: what is cut off or goes wrong inside ends before that sign.
_TOKEN = "|".join(
    [
        r"[ \t\n\r]++",
        r"[{}\[\],:]",
        rf'"{_IN_STRING}(?:"|\\(?:u[0-9A-Fa-f]{{0,3}}+)?+)?+',
        rf"-(?:{_INTEGER}{_BEHIND_INTEGER})?+",
        rf"{_INTEGER}{_BEHIND_INTEGER}",
        "t(?:r(?:ue?+)?+)?+",
        "f(?:a(?:l(?:se?+)?+)?+)?+",
        "n(?:u(?:ll?+)?+)?+",
        r"[\s\S]",
    ]
)
_WHOLE = rf"""^(?:[ \t\n\r]++|[{{}}\[\],:]|"{_IN_STRING}"|-?+{_INTEGER}(?:\.{_DIGITS}++)?+(?:[eE][+-]?+{_DIGITS}++)?+|true|false|null)$"""

# What may come next.
_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY, _COLON, _AFTER_VALUE = range(6)
#: Open brackets whose kinds fit one number.
_LEVELS = 60
_FIELDS = ("at", "bad", "expect", "top", "count", "rest")


def json_error_place(text: Column) -> Column:
    """(valid, line_no, column_no): whether the whole text is one JSON value, and if not where it ends to be one.

    The place is that of the first sign with which no JSON can begin any more, as a reader gives it that
    has just taken the first byte of that sign: lines count from 1, columns are bytes of the line
    including it, so a line feed inside a string is column 0 of the next line. A text that ends too early
    has the place of its last byte. Valid texts have no place; null gives null in all fields. Neither
    depth nor the size of numbers is limited, and any four hexadecimal digits make an escape.

    One fold over the tokens. Kinds of open brackets are a stack of bits, the innermost ``_LEVELS`` in
    one number and those further out in an array, so no step copies more than a sixtieth of the depth.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(-1).alias("bad"), F.lit(_VALUE).alias("expect"),
        F.lit(0).cast("bigint").alias("top"), F.lit(0).alias("count"), F.array().cast("array<bigint>").alias("rest"),
    )
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    error = F.aggregate(tokens, start, _step, _first_error)

    def place(bad: Column) -> Column:
        before, sign = F.left(text, bad), F.substring(text, bad + 1, F.lit(1))
        feed = sign == "\n"
        lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
        line_no = lines + 1 + feed.cast("int")
        column_no = F.octet_length(F.substring_index(before, "\n", -1)) + (sign != "").cast("int")
        return F.struct(
            bad.isNull().alias("valid"),
            line_no.cast("int").alias("line_no"),
            F.when(feed, F.lit(0)).otherwise(column_no).cast("int").alias("column_no"),
        )

    # one element, so that the fold is computed once; a null of the fold is a valid text
    found = F.element_at(F.transform(F.array(error), place), 1)
    return F.when(text.isNotNull(), found)


def _first_error(state: Column) -> Column:
    ended = (state["expect"] == _AFTER_VALUE) & (state["count"] == 0)
    return F.when(state["bad"] >= 0, state["bad"]).when(~ended, state["at"])


def _step(state: Column, token: Column) -> Column:
    """Take one token; behind an error nothing changes."""
    sign, expect = F.left(token, F.lit(1)), state["expect"]
    in_object = (state["count"] > 0) & (state["top"].bitwiseAND(F.lit(1)) == 1)
    in_array = (state["count"] > 0) & (state["top"].bitwiseAND(F.lit(1)) == 0)
    takes_value = expect.isin(_VALUE, _VALUE_OR_END)
    allowed = (
        F.when(sign == '"', expect.isin(_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY))
        .when(sign == "}", (expect == _KEY_OR_END) | ((expect == _AFTER_VALUE) & in_object))
        .when(sign == "]", (expect == _VALUE_OR_END) | ((expect == _AFTER_VALUE) & in_array))
        .when(sign == ",", (expect == _AFTER_VALUE) & (state["count"] > 0))
        .when(sign == ":", expect == _COLON)
        .otherwise(takes_value & sign.rlike(r"[{\[\-0-9tfn]"))
    )
    after = (
        F.when(sign == '"', F.when(takes_value, _AFTER_VALUE).otherwise(_COLON))
        .when(sign == "{", _KEY_OR_END)
        .when(sign == "[", _VALUE_OR_END)
        .when(sign == ",", F.when(in_object, _KEY).otherwise(_VALUE))
        .when(sign == ":", _VALUE)
        .otherwise(_AFTER_VALUE)
    )
    end = state["at"] + F.length(token)

    def with_(**changed: Column) -> Column:
        return F.struct(*(changed.get(name, state[name]).alias(name) for name in _FIELDS))

    kind = (sign == "{").cast("bigint")
    filled = F.concat(state["rest"], F.array(state["top"]))
    outer = F.slice(state["rest"], F.lit(1), F.size(state["rest"]) - 1)
    refill = (state["count"] == 1) & (F.size(state["rest"]) > 0)
    opens, closes = sign.isin("{", "["), sign.isin("}", "]")
    return (
        F.when(state["bad"] >= 0, state)
        .when(sign.isin(" ", "\t", "\n", "\r"), with_(at=end))
        .when(~allowed, with_(bad=state["at"]))
        .when(~token.rlike(_WHOLE), with_(bad=end))
        .when(opens & (state["count"] == _LEVELS), with_(at=end, expect=after, top=kind, count=F.lit(1), rest=filled))
        .when(opens, with_(at=end, expect=after, top=F.shiftleft(state["top"], 1) + kind, count=state["count"] + 1))
        .when(closes & refill, with_(at=end, expect=after, top=F.element_at(state["rest"], -1), count=F.lit(_LEVELS), rest=outer))
        .when(closes, with_(at=end, expect=after, top=F.shiftright(state["top"], 1), count=state["count"] - 1))
        .otherwise(with_(at=end, expect=after))
    )
