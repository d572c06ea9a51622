"""Places of JSON errors against a scanner that reads sign by sign."""

import json
import random

from pyspark.sql import functions as F

from evimill.functions.json_place import json_error_place

C = F.col
SPACES, DIGITS = " \t\n\r", "0123456789"


class Stop(Exception):
    pass


def scan(text):
    """Index of the first sign that cannot stand where it does; None if the text is JSON. Recursive descent."""
    at = 0

    def peek():
        return text[at] if at < len(text) else ""

    def need(signs):
        nonlocal at
        if not peek() or peek() not in signs:
            raise Stop
        at += 1
        return text[at - 1]

    def spaces():
        nonlocal at
        while peek() and peek() in SPACES:
            at += 1

    def digits():
        need(DIGITS)
        while peek() and peek() in DIGITS:
            need(DIGITS)

    def string():
        nonlocal at
        need('"')
        while True:
            if not peek() or peek() < " ":
                raise Stop
            at += 1
            if text[at - 1] == '"':
                return
            if text[at - 1] == "\\" and need('"\\/bfnrtu') == "u":
                for _ in range(4):
                    need("0123456789abcdefABCDEF")

    def value(ends=""):
        spaces()
        if peek() == '"':
            string()
        elif peek() and peek() in "tfn":
            for sign in {"t": "true", "f": "false", "n": "null"}[peek()]:
                need(sign)
        elif peek() == "[":
            need("[")
            spaces()
            if peek() == "]":
                need("]")
                return
            while True:
                value()
                spaces()
                if need(",]") == "]":
                    return
        elif peek() == "{":
            need("{")
            spaces()
            if peek() == "}":
                need("}")
                return
            while True:
                spaces()
                string()
                spaces()
                need(":")
                value()
                spaces()
                if need(",}") == "}":
                    return
        else:
            if need("-" + DIGITS) == "-":
                first = need(DIGITS)
            else:
                first = text[at - 1]
            while first != "0" and peek() and peek() in DIGITS:
                need(DIGITS)
            if peek() == ".":
                need(".")
                digits()
            if peek() and peek() in "eE":
                need("eE")
                if peek() and peek() in "+-":
                    need("+-")
                digits()

    try:
        value()
        spaces()
        if at < len(text):
            raise Stop
    except Stop:
        return at
    return None


def place(text):
    at = scan(text)
    if at is None:
        return (True, None, None)
    taken = text[: at].encode() + text[at : at + 1].encode()[:1]
    return (False, taken.count(b"\n") + 1, len(taken) - 1 - taken.rfind(b"\n"))


def test_known_places(evaluate):
    cases = {
        "": (1, 0), "nul": (1, 3), "nxl": (1, 2), "{]": (1, 2), "{}x": (1, 3), "01": (1, 2), "-x": (1, 2), "1.x": (1, 3),
        "[1,]": (1, 4), '{"k": 1}\n{': (2, 1), '["a\nb"]': (2, 0), '"é': (1, 3), '"é\\q"': (1, 5), "[\n\n 1 2": (3, 4), '{"a" 1}': (1, 6),
        "\n\n": (3, 0), "tru\n": (2, 0), "[1}": (1, 3), '{"a":1]': (1, 7), '"\\u12': (1, 5), "1e+": (1, 3), "﻿1": (1, 1),
    }
    assert [place(t) for t in cases] == [(False, *p) for p in cases.values()]
    assert [tuple(r) for r in evaluate([(t,) for t in cases], "t string", json_error_place(C("t")))] == [(False, *p) for p in cases.values()]
    assert evaluate([(None,)], "t string", json_error_place(C("t"))) == [None]


def made_up(draw, depth=0):
    kind = draw.randrange(8 if depth < 5 else 5)
    pad = draw.choice(["", "", " ", "\n", "\t\r\n"])
    if kind >= 5:
        items = [made_up(draw, depth + 1) for _ in range(draw.randrange(4))]
        if kind == 5:
            return pad + "[" + ",".join(items) + pad + "]"
        return pad + "{" + ",".join(f'{pad}"{draw.choice("aé😀")}"{pad}:{i}' for i in items) + "}"
    return pad + draw.choice(["0", "-1", "12.5e-3", "true", "null", "false", '"x\\n\\u00e9 ü"', '""', "1E9"]) + pad


def test_changed_texts(evaluate):
    draw = random.Random(8)
    texts = []
    for _ in range(1500):
        text = made_up(draw)
        for _ in range(draw.randrange(3)):
            i = draw.randrange(len(text) + 1)
            text = text[:i] + draw.choice(list('{}[],:"\\ \n-+.eE01tfnux😀é') + [""]) + text[i + draw.randrange(2) :]
        texts.append(text[: draw.randrange(len(text) + 1)] if draw.random() < 0.3 else text)
    got = [tuple(r) for r in evaluate([(t,) for t in texts], "t string", json_error_place(C("t")))]
    assert got == [place(t) for t in texts]
    assert 200 < sum(v for v, *_ in got) < 1300
    for text, (valid, *_) in zip(texts, got, strict=True):
        try:
            json.loads(text)
        except ValueError:
            assert not valid
        else:
            assert valid


def test_deep_and_long(evaluate):
    deep = '[{"a":' * 10_000 + "1" + "}]" * 10_000
    texts = [deep, deep[:-1], deep + "]", deep.replace("1", "1]"), '"' + "é\\n" * 200_000 + '"', "[" + "1," * 100_000 + "2]"]
    n = len(deep.encode())
    want = [(True, None, None), (False, 1, n - 1), (False, 1, n + 1), (False, 1, 60_002), (True, None, None), (True, None, None)]
    assert [tuple(r) for r in evaluate([(t,) for t in texts], "t string", json_error_place(C("t")))] == want
