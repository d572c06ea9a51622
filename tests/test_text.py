"""Text functions against golden values and plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from evimill.functions import text as T
from evimill.functions.vocabulary import WHITESPACE

C = F.col


def one(rows):
    return [(r,) for r in rows]


def test_duration_label_golden(evaluate):
    got = evaluate(one([532, 1530, 125000, 0, 999, 59999, 60000]), "ms bigint", T.duration_label(C("ms")))
    assert got == ["532ms", "1.5s", "2m05s", "0ms", "999ms", "60.0s", "1m00s"]


def test_duration_label_is_the_printed_double_for_every_value(spark):
    rows = spark.range(1000, 60000).select("id", T.duration_label(C("id")).alias("v")).collect()
    assert [r["v"] for r in rows] == [f"{r['id'] / 1000:.1f}s" for r in rows]


def test_excerpt(evaluate):
    long_text = "a" * 800 + "─" * 10
    bytes_over = "é" * 400
    rows = ["", " \n\t", "  x y ", "a" * 700, long_text, bytes_over, "\u3000x\x85"]
    got = evaluate(one(rows), "t string", T.excerpt(C("t")))
    assert got == [None, None, "x y", "a" * 700, "..." + long_text[-700:], "..." + bytes_over, "x"]


def test_trim_takes_all_white_space_and_nothing_else(evaluate):
    rows = [c + "x" + c for c in WHITESPACE] + ["\u200bx\u200b"]
    got = evaluate(one(rows), "t string", T.trim_space(C("t")))
    assert got == ["x"] * len(WHITESPACE) + ["\u200bx\u200b"]


def test_contains_any_folds_ascii_only(evaluate):
    rows = ["STACKED Borrow", "stac\u212aed borrow", "stub:", "x"]
    got = evaluate(one(rows), "t string", T.contains_any(C("t"), ["stacked borrow", "ub:"]))
    assert got == [True, False, True, False]


def test_non_space_class_is_the_complement(evaluate):
    text = "".join(chr(i) for i in [*range(1, 0x300), *range(0x1670, 0x1690), *range(0x2000, 0x2070), 0x3000, 0x3001, 0x1F600])
    got = evaluate([(text,)], "t string", F.regexp_replace("t", T.NON_SPACE, ""))
    assert sorted(got[0]) == sorted(c for c in text if c in WHITESPACE)


def test_names_and_paths(evaluate):
    assert evaluate(one(["a/b:c", "é-_9"]), "t string", T.file_safe(C("t"))) == ["a_b_c", "_-_9"]
    got = evaluate([("serde_json", "fuzz", "g.t")], "c string, p string, n string", T.log_path(C("c"), C("p"), C("n")))
    assert got == ["crates/serde_json/logs/fuzz.g_t.log"]


def test_file_url_path(evaluate):
    rows = {
        "file:///w/demo%230.1.0": "/w/demo",
        "file:///a+b%20c": "/a+b c",
        "http://x": None,
        "file:///x%zz": None,
        "file:///x%4": "/x%4",
        "file:///x%": "/x%",
        "file:///s%C3%A9#v": "/sé",
    }
    assert evaluate(one(rows), "u string", T.file_url_path(C("u"))) == list(rows.values())


def test_env_overlay_later_layer_wins_whatever_the_session_says(spark, evaluate):
    layers = [({"A": "study", "B": "study"}, {"B": "group", "C": "group"}, {"C": "cli", "D": "cli"}), ({}, None, None)]
    for policy in ("EXCEPTION", "LAST_WIN"):
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        got = evaluate(
            layers,
            "s map<string,string>, g map<string,string>, c map<string,string>",
            T.env_text(T.env_overlay(C("s"), C("g"), C("c"))),
        )
        assert got == ["A=study, B=group, C=cli, D=cli", "-"]
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_env_pair(evaluate):
    got = evaluate(one(["A=1=2", "=x", "A=", "none"]), "t string", T.env_pair(C("t")))
    assert [tuple(r) if r else None for r in got] == [("A", "1=2"), ("", "x"), ("A", ""), None]


def test_argv_and_cells(evaluate):
    assert evaluate([("cargo", ["test", "--all"])], "p string, a array<string>", T.argv_text(C("p"), C("a"))) == ["cargo test --all"]
    assert evaluate(one(["a|b\nc"]), "t string", T.table_cell(C("t"))) == ["a\\|b c"]


def test_lossy_text(evaluate):
    rows = [(bytearray(b"a\xffb"),), (bytearray("é".encode()),)]
    assert evaluate(rows, "b binary", T.lossy_text(C("b"))) == ["a�b", "é"]


JSON_TEXTS = [
    "1", "null", "[]", "{}", '{"a":1}', ' {"a": [1, {"b": null}]} ', '"x"', '"]"', "", " ", "{", "}", "]", "[1", "1,2",
    "1],[2", "1}{", '{"x":1} {"x":2}', '{"a":1}}', "{'a':1}", "NaN", "01", "tru", '{"a":1,"a":2}', "[1,]", '{"a":}',
    "[1],", ",1", '{"k": 69}\n{', "-1.5e3", '"\\u00e9"', '"a\nb"',
]


def test_json_valid_agrees_with_a_strict_parser(evaluate):
    def strict(text):
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    got = evaluate(one(JSON_TEXTS), "t string", T.json_valid(C("t")))
    assert dict(zip(JSON_TEXTS, got)) == {t: strict(t) for t in JSON_TEXTS}


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_env_overlay_is_dict_update(evaluate, layers):
    maps = [{str(k): f"{layer}{k}" for k in range(layer, 6, layer + 1)} for layer in range(layers)]
    schema = ", ".join(f"m{i} map<string,string>" for i in range(layers))
    expected = {k: v for m in maps for k, v in m.items()}
    assert evaluate([tuple(maps)], schema, T.env_overlay(*[C(f"m{i}") for i in range(layers)])) == [expected]
