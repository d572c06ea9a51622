"""Probes against plain Python."""

import random

import pytest

from pyspark.sql import functions as F

from evimill.operators import probes as P

C = F.col


def test_byte_search_agrees_with_bytes(evaluate):
    rng = random.Random(2)
    texts = ["".join(rng.choices("fobar:é─\n ", k=rng.randint(0, 30))) for _ in range(800)]
    rows = [(t,) for t in texts]

    def find(i):
        return None if i < 0 else i

    for needle in ("foo", "o", "é", "oo"):
        raw, coded = needle, needle.encode()
        assert evaluate(rows, "t string", P.first_offset(C("t"), raw)) == [find(t.encode().find(coded)) for t in texts]
        assert evaluate(rows, "t string", P.last_offset(C("t"), raw)) == [find(t.encode().rfind(coded)) for t in texts]
        assert evaluate(rows, "t string", P.occurrences(C("t"), raw)) == [t.count(raw) for t in texts]
    any_of = [min((i for i in (t.encode().find(c.encode()) for c in ":─") if i >= 0), default=None) for t in texts]
    assert evaluate(rows, "t string", P.any_offset(C("t"), ":─")) == any_of
    assert set(evaluate(rows[:3], "t string", P.first_offset(C("t"), ""))) == {0}


def test_counts(evaluate):
    texts = ["", "a", "a\n", "a\n\nb", "\n", " a\tb　c ", "x_1 é y"]
    rows = [(t,) for t in texts]
    assert evaluate(rows, "t string", P.line_count(C("t"))) == [0, 1, 1, 3, 1, 1, 1]
    assert evaluate(rows, "t string", P.field_count(C("t"))) == [len(t.split()) for t in texts]
    assert evaluate(rows, "t string", P.word_count(C("t"))) == [0, 1, 1, 2, 0, 3, 3]
    assert evaluate([("éx\r\n",)], "t string", P.grapheme_count(C("t"))) == [3]


def test_binary_kinds(evaluate):
    heads = {b"\x7fELF\x02": "elf", b"MZ\x90": "pe", b"\xcf\xfa\xed\xfe": "mach", b"!<arch>\n1": "archive", b"VZ": "te", b"": "unknown", b"\x7fEL": "unknown"}
    assert evaluate([(bytearray(h),) for h in heads], "b binary", P.binary_kind(C("b"))) == list(heads.values())
    assert evaluate([(bytearray(b"a\xff"),), (bytearray(b"a"),)], "b binary", P.utf8_ok(C("b"))) == [False, True]


def test_prefixes(evaluate):
    rows = [("12345 rest",), (" \t\nalpha",), ("abc-rest",), ("[alpha|beta] trailing",), ("key:value\nx",), ("[open",)]
    got = {k: evaluate(rows, "t string", c) for k, c in P.prefixes(C("t")).items()}
    assert got["leading_int"] == [12345, None, None, None, None, None]
    assert got["leading_space"] == [0, 3, 0, 0, 0, 0]
    assert got["until_dash"][2] == "abc"
    assert got["bracketed"] == [None, None, None, "alpha|beta", None, None]
    assert (got["pair_key"][4], got["pair_value"][4], got["pair_key"][0]) == ("key", "value", None)


def test_json_lines_stop_at_first_error(evaluate):
    texts = {"1\n2\n{": 2, "": 0, "\n\n{}": 1, "\n".join(["1"] * 12): 12, "x\n1": 0, "\n".join(['{"a": 1}'] * 1000): 1000}
    assert evaluate([(t,) for t in texts], "t string", P.leading_json_lines(C("t"))) == list(texts.values())


def test_markup(spark):
    html = '<?xml version="1.0"?><!DOCTYPE x><root><item k="v" flag="yes">text</item><empty/> <!-- c --></root>'
    df = spark.createDataFrame([(html,)], "html string")
    assert {r["tag"]: r["n"] for r in P.tag_counts(df, "html").collect()} == {"root": 1, "item": 1, "empty": 1}
    assert {r["attribute"]: r["n"] for r in P.attribute_counts(df, "html").collect()} == {"k": 1, "flag": 1}
    got = P.event_counts(df.withColumn("id", F.lit(1)), "id", "html").first().asDict()
    assert got == {"id": 1, "start_tags": 3, "end_tags": 2, "comments": 1, "cdata": 0, "declarations": 2, "texts": 1, "raw_texts": 0}


def test_markup_names_and_attributes_of_all_forms(spark):
    html = """<my-tag data-x1="a" xml:lang="b" c='d' e=f checked><p x="1"\ty="2 > 1"/><q z = '<b>' w></q>"""
    df = spark.createDataFrame([(html,), ("<a",), ("<b c='d>",), (None,)], "html string")
    assert {r["tag"]: r["n"] for r in P.tag_counts(df, "html").collect()} == {"my-tag": 1, "p": 1, "q": 1}
    names = ["data-x1", "xml:lang", "c", "e", "checked", "x", "y", "z", "w"]
    assert {r["attribute"]: r["n"] for r in P.attribute_counts(df, "html").collect()} == dict.fromkeys(names, 1)


@pytest.mark.parametrize("html, tokens", [
    ('<p a="<i>"><!-- <b> --></p><script>if (a<c)', [("start", '<p a="<i>">'), ("comment", "<!-- <b> -->"), ("end", "</p>"), ("start", "<script>if (a<c)")]),
    ("a < b<br/>c", [("text", "a < b"), ("start", "<br/>"), ("text", "c")]),
    ("<![CDATA[<x>]]> <?xml v='>'?>", [("cdata", "<![CDATA[<x>]]>"), ("blank", " "), ("declaration", "<?xml v='>'?>")]),
    ("<style>a<b</STYLE><style/><u", [("start", "<style>a<b"), ("end", "</STYLE>"), ("start", "<style/>"), ("stray", "<"), ("text", "u")]),
    ("<!-- open <a>", [("comment", "<!-- open <a>")]),
    ("<a 'x>y", [("stray", "<"), ("text", "a 'x>y")]),
    ("", []),
])
def test_markup_tokens(spark, html, tokens):
    df = spark.createDataFrame([(html,)], "html string")
    found = F.transform(P.markup_tokens(C("html")), lambda t: F.struct(P.token_kind(t).alias("k"), t.alias("t")))
    got = [tuple(r) for r in df.select(found.alias("x")).first()["x"]]
    assert got == tokens and "".join(t for _, t in got) == html


def test_markup_tokens_are_the_whole_text(spark):
    """Any text is cut without loss, in one search of the plan; a long one does not exhaust the matcher."""
    draw = random.Random(9)
    parts = ["<", ">", "a", "<!--", "-->", "<script>", "</script>", '"', "'", "<p x=", "]]>", "<![CDATA[", "/", " ", "<?x", "!"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(400)] + ["<p>" + "x<y " * 100_000 + "<!--" + "-" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, html string")
    for r in df.select("k", F.array_join(P.markup_tokens(C("html")), "").alias("t")).collect():
        assert r["t"] == texts[r["k"]]
    plan = P.event_counts(df, "k", "html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_rollup(spark):
    rows = [(1, "a", "ok", 2), (2, "a", "error", 3), (3, "b", "skipped", 0), (4, "c", "ok", 1), (5, "c", "skipped", None)]
    df = spark.createDataFrame(rows, "item_id int, probe string, verdict string, n bigint")
    got = {r["probe"]: tuple(r)[1:] for r in P.probe_rollup(df).collect()}
    assert got == {"a": ("error", 0, 1, 1, 5), "b": ("skipped", 1, 0, 0, 0), "c": ("ok", 1, 1, 0, 1)}
