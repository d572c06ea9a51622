"""Rules as rows of a table, against one alternation of all of them."""

import random
import re

from pyspark.sql import functions as F

from evimill.operators import rule_table as T


RULES = "rule_id int, kind string, pattern string, rx string, anchor string"
FILES = "crate string, file string, content string"


def frames(spark, texts, rules):
    files = spark.createDataFrame([("c", f"f{k}", t) for k, t in enumerate(texts)], FILES)
    return files, spark.createDataFrame([(k, "kind", f"p{k}", rx, anchor) for k, rx, anchor in rules], RULES)


def slow(text, rules):
    """(line, seq, rule_id) by one search with all rules, and all rules tried on every match."""
    ordered, out = sorted(rules), []
    whole = re.compile("|".join(f"(?:{rx})" for _, rx, _ in ordered))
    for at, line in enumerate((text or "").split("\n"), 1):
        for seq, m in enumerate(whole.finditer(line), 1):
            fits = [k for k, rx, _ in ordered if re.fullmatch(rx, m[0])]
            if fits:
                out.append((at, seq, fits[0]))
    return out


def found(spark, texts, rules):
    files, table = frames(spark, texts, rules)
    rows = T.scan_with_table(files, table).collect()
    assert len(rows) == len(texts)
    return {r["file"]: [(s["line"], s["seq"], s["rule_id"]) for s in r["sites"]] for r in rows}


def drawn_word(draw, n=(3, 9)):
    return "".join(draw.choices("abcdeé_9", k=draw.randint(*n)))


def test_table_equals_one_alternation(spark):
    draw = random.Random(7)
    words = [drawn_word(draw) for _ in range(120)]
    rules = [(k, re.escape(w) + draw.choice(["", "", "[a-z]*", r"\(?", "(?: x)?"]), w) for k, w in enumerate(words)]
    rules += [(500, r"[0-9]{3,}", None), (501, "ab", "ab"), (3000, r"!!", "!!"), (2, "-" + words[7], words[7][1:])]
    texts = [
        "\n".join(" ".join(draw.choices([*words, "x", "12345", "!!", "(", "", "-"], k=draw.randrange(12))) for _ in range(6))
        for _ in range(60)
    ]
    texts += ["", None, "".join(words), "nothing here"]
    got = found(spark, texts, rules)
    for k, text in enumerate(texts):
        assert got[f"f{k}"] == slow(text, rules), text


def test_ten_thousand_rules(spark):
    """A file is searched with its own rules only; others cost it nothing."""
    draw = random.Random(8)
    words = sorted({drawn_word(draw, (7, 9)) for _ in range(10_500)})[:10_000]
    rules = [(k, w + "[xyz]?", w) for k, w in enumerate(words)]
    texts = ["\n".join(" ".join(draw.choices(words, k=3) + ["thex", "abc"]) for _ in range(4)) for _ in range(40)]
    files, table = frames(spark, texts, rules)
    called = T.candidate_rules(files, table).select(F.size("rules").alias("n")).collect()
    assert max(r["n"] for r in called) <= 16 and len(called) == len(texts)
    got = {r["file"]: [tuple(s) for s in r["sites"]] for r in T.scan_with_table(files, table).collect()}
    whole = {w: k for k, w in enumerate(words)}
    for k, text in enumerate(texts):
        for line, seq, rule in got[f"f{k}"]:
            assert words[rule] in text.split("\n")[line - 1]
        named = {words[rule] for _, _, rule in got[f"f{k}"]}
        assert {w for w in re.findall(r"[a-z_é9]+", text) if w in whole} <= {w for n in named for w in (n,)} | {
            w for w in whole if any(w.startswith(n) or n in w for n in named)
        }
    pairs = T.words_of_rules(spark.createDataFrame([(w,) for w in ("abcabca", "zz")], "word string"), table)
    assert pairs.count() == sum(w in "abcabca" for w in words)


def test_kinds_come_from_the_table(spark):
    files, table = frames(spark, ["one\ntwo one", None], [(1, "one", "one"), (2, "two", "two")])
    rows = T.table_site_rows(T.scan_with_table(files, table), table).collect()
    got = sorted((r["file"], r["pos"], r["line"], r["seq"], r["rule_id"], r["kind"], r["pattern"]) for r in rows)
    assert got == [("f0", 0, 1, 1, 1, "kind", "p1"), ("f0", 1, 2, 1, 2, "kind", "p2"), ("f0", 2, 2, 2, 1, "kind", "p1")]


def test_no_rules_and_no_files(spark):
    files, table = frames(spark, ["a b", ""], [(1, "a", "a")])
    assert [r["sites"] for r in T.scan_with_table(files, table.limit(0)).collect()] == [[], []]
    assert not T.scan_with_table(files.limit(0), table).collect()
    hot = spark.range(3000).select(F.lit("c").alias("crate"), F.col("id").cast("string").alias("file"), F.lit("same words same").alias("content"))
    rule = spark.createDataFrame([(1, "k", "p", "same", "same")], RULES)
    assert T.scan_with_table(hot, rule).filter(F.size("sites") == 2).count() == 3000
