import random
import re
from re import _constants as op
from re import _parser

import pytest
from cases import EDGES, files
from evimill.llm import licenses
from evimill.llm.license_rules import PHRASES, SignatureRule, signature_rules

RULES = signature_rules()


def slow(text, rules=RULES):
    """Detections of all rules, keyword or not, and their suppression by comparing every pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    joined = " " + " ".join(words) + " "
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, rule.priority, k, rule.label, rule.base))
    order = sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3]))
    kept = [
        x for i, x in enumerate(order)
        if x[5] or not any(y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] for y in order[:i])
    ]
    return len(words), kept


TEXTS = [
    "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "see www.apache.org/licenses/LICENSE-2.0",
    "under the mit license under the MIT license", "All rights reserved.", "Apache License, Version 2.0",
    "distributed under the terms of the Mozilla Public License 2.0 or the zlib license",
    "BSD 3-Clause License", "uses BSD-3-Clause", "www.mozilla.org/MPL/2.0", "GPL v2 or later", "unlicense.org", "as is", "gplx",
    "LGPLv3 license", "creative commons attribution noncommercial 4.0", "cc by nc", "CC0 1.0",
]


def test_hundreds_of_rules():
    assert len(RULES) > 250 and {p.priority for p in RULES} == set(range(licenses.PRIORITIES))
    for rule in RULES:
        re.compile(rule.pattern)


@pytest.mark.parametrize("text, label", [
    ("uses BSD-3-Clause here", "bsd-3-clause"), ("www.mozilla.org/MPL/2.0", "mpl-2.0"), ("the GNU LGPLv3", "lgpl-3"), ("GPL v2 or later", "gpl-2"),
])
def test_names_without_the_word_license(spark, text, label):
    (row,) = licenses.scan_licenses(files(spark, [(1, "a", text)])).collect()
    assert row["labels"] == label and row["base_labels"] == ""


def test_detections_match_brute_force(spark):
    draw = random.Random(4)
    pieces = [*TEXTS, "some words", "license", "the", "é", "\n", "--", "MIT", "gpl", "version 2"]
    rows = [(k, "a", " ".join(draw.choices(pieces, k=draw.randint(1, 7)))) for k in range(150)]
    rows += [(1000 + k, "a", text) for k, text in enumerate(TEXTS)]
    found = {r["file_id"]: r for r in licenses.scan_licenses(files(spark, rows)).collect()}
    for k, _, text in rows:
        n, kept = slow(text)
        got = [(d["start"], d["end"], d["priority"], d["rule"], d["label"], d["base"]) for d in found[k]["detections"]]
        assert (found[k]["n_words"], got) == (n, kept), text
        base = [x for x in kept if x[5]]
        assert found[k]["n_base"] == len(base)
        assert found[k]["first_word"] == min((x[0] for x in base), default=None)
        assert found[k]["last_word"] == max((x[0] for x in base), default=None)
        assert found[k]["labels"] == ",".join(sorted({x[4] for x in kept}))


def test_base_phrases_are_never_suppressed(spark):
    wide = SignatureRule("wide", "license", "(?:[^ ]+ )*[^ ]+", 0, 0.5, False)
    rules = [SignatureRule(label, key, phrase, 0, 1.0, True) for label, key, phrase in PHRASES] + [wide]
    (row,) = licenses.scan_licenses(files(spark, [(1, "a", "x under the MIT license y")]), rules).collect()
    assert row["labels"] == "mit,wide" and row["base_labels"] == "mit" and row["n_base"] == 1


@pytest.mark.parametrize("text", ["", None, "no such thing", "lICENSE"])
def test_nothing_found(spark, text):
    (row,) = licenses.scan_licenses(files(spark, [(1, "a", text)])).collect()
    assert (row["n_base"], row["first_word"], row["labels"], row["score"], row["detections"]) == (0, None, "", 0.0, [])


def test_edges(spark):
    crowd = "Released under the MIT License. " * 500
    rows = {r["file_id"]: r for r in licenses.scan_licenses(files(spark, [*EDGES, (30, "a", crowd)])).collect()}
    assert rows[30]["n_base"] == 500 and rows[30]["last_word"] == 2496 and rows[30]["score"] == 1.0
    assert [rows[k]["n_words"] for k in (3, 4, 5, 6)] == [0, 0, 0, 270_000]
    assert not licenses.scan_licenses(files(spark, [])).collect()


def test_plan_is_native(spark):
    plan = licenses.scan_licenses(files(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("text, label", [
    ("Released under MIT.", "mit"), ("Distributed under the Apache 2.0 terms", "apache-2"), ("available under Apache-2.0", "apache-2"),
    ("released under the ISC", "isc"), ("published under zlib", "zlib"), ("shared under openssl", "openssl"),
    ("released under 0BSD", "0bsd"),
])
def test_grants_without_other_signals(spark, text, label):
    (row,) = licenses.scan_licenses(files(spark, [(1, "a", text)])).collect()
    assert label in row["labels"].split(",") and row["score"] >= 0.7


def written(draw, parsed):
    """A string that the parsed pattern matches."""
    out = ""
    for what, value in parsed:
        if what is op.LITERAL:
            out += chr(value)
        elif what is op.BRANCH:
            out += written(draw, draw.choice(value[1]))
        elif what is op.SUBPATTERN:
            out += written(draw, value[3])
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            out += "".join(written(draw, inner) for _ in range(draw.randint(low, min(high, low + 2))))
        elif what is op.IN and value[0][0] is op.NEGATE or what is op.NOT_LITERAL:
            out += "q"
        elif what is op.IN:
            kind, found = draw.choice(value)
            out += chr(found if kind is op.LITERAL else draw.randint(*found))
        else:
            raise ValueError(what)
    return out


def test_every_rule_fires_on_its_own_pattern(spark):
    """Strings drawn from each pattern pass the keyword and the gate, in any case and between other words."""
    draw, gate, rows = random.Random(5), re.compile(licenses.signal(RULES)), []
    for k, rule in enumerate(RULES):
        for _ in range(12):
            text = written(draw, _parser.parse(rule.pattern))
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text, (rule, text)
            assert gate.search(f"x, {text.upper()}") and gate.search(text), (rule, text)
        rows.append((k, "a", f"some ({text}) words"))
    found = {r["file_id"]: r for r in licenses.scan_licenses(files(spark, rows)).collect()}
    for k, _, text in rows:
        n, kept = slow(text)
        got = [(d["start"], d["end"], d["priority"], d["rule"], d["label"], d["base"]) for d in found[k]["detections"]]
        assert (found[k]["n_words"], got) == (n, kept) and got, text


def test_gate_needs_a_word_start():
    gate = re.compile(licenses.signal(RULES))
    assert all(gate.search(f"x {rule.keyword.upper()} y") for rule in RULES)
    assert not any(gate.search(text) for text in ("a b", "permitted", "limits", "confonts"))
