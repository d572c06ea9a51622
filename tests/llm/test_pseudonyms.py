import random
import re

import pytest
from cases import EDGES, files
from evimill.llm import pseudonyms as P

KEY = "key of the tests"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000])
def test_permutation_and_inverse(size):
    key = b"k" * 32
    out = [P.permute(n, size, key) for n in range(size)]
    assert sorted(out) == list(range(size)) and [P.permute(n, size, key, True) for n in out] == list(range(size))


VALUES = {
    "card": ["4944339490429605", "4944-3394-9042-9605", "4111 1111 1111 1111"],
    "phone": ["+1 (386) 555-3733", "(386) 555-3733", "386-555-3733", "+44 20 7946 0958"],
    "address": ["25.86.162.211"],
    "date": ["2024-01-31", "31.01.2024", "01/31/2024", "29/02/2000"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "email": ["Hocc.rcif-96@mail8.example.com"],
}


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_keeps_format_links_and_reverses(kind, value):
    text = f"é see {value}, and {value} again"
    out = P.pseudonymised(text, KEY)
    first, second = (s["pseudonym"] for s in out["spans"])
    assert out[f"n_{kind}"] == 2 and first == second != value
    shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", x)))
    if kind != "address":
        assert shape(first) == shape(value)
    assert out["content"] == f"é see {first}, and {first} again"
    assert [text[s["start"] : s["end"]] for s in out["spans"]] == [value, value]
    assert P.pseudonymised(out["content"], KEY, back=True)["content"] == text
    assert P.pseudonymised(text, "another key")["content"] != out["content"]


def test_one_value_in_two_writings_stays_one():
    a, b = (P.pseudonymised(v, KEY)["content"] for v in ("4944339490429605", "4944-3394-9042-9605"))
    assert a == b.replace("-", "")
    iso, dotted = (P.pseudonymised(v, KEY)["content"] for v in ("2024-01-31", "31.01.2024"))
    assert iso.split("-") == dotted.split(".")[::-1]


@pytest.mark.parametrize("text", ["4944339490429606", "2024-13-45", "1.2.3.4.5", "300.1.2.3", "000-12-3456", "10.0.0.1", "v2024-01-311", "DE00370400440532013000", "", "no digits", "127.0.0.1", "1.2.3"])
def test_what_fails_validation_stays(text):
    assert P.pseudonymised(text, KEY)["content"] == text


def test_pseudonyms_are_distinct():
    draw = random.Random(1)
    values = {f"{draw.randrange(1, 223)}.{draw.randrange(256)}.{draw.randrange(256)}.{draw.randrange(1, 256)}" for _ in range(500)}
    assert len({P.pseudonymised(v, KEY)["content"] for v in values}) == len(values)


def test_many_values_in_one_text():
    text = " ".join(f"user{n}@mail.example.com 25.86.162.{n % 256}" for n in range(3000))
    out = P.pseudonymised(text, KEY)
    assert (out["n_email"], out["n_address"]) == (3000, 3000)
    assert P.pseudonymised(out["content"], KEY, back=True)["content"] == text


def test_edges(spark):
    rows = P.pseudonymise_files(files(spark, [*EDGES, (40, "a", "call 386-555-3733")]), KEY).collect()
    by_id = {r["file_id"]: r for r in rows}
    assert len(rows) == len(EDGES) + 1 and by_id[3]["content"] == "" and by_id[6]["content"] == EDGES[5][2]
    assert by_id[40]["content"] == P.pseudonymised("call 386-555-3733", KEY)["content"] and by_id[40]["n_phone"] == 1
    assert not P.pseudonymise_files(files(spark, []), KEY).collect()


@pytest.mark.parametrize("kind, value, text", [
    ("iban", "DE89370400440532013000", "DE89370400440532013000 BIC COBADEFFXXX"),
    ("iban", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX"),
    ("iban", "DE89370400440532013000", "AB12 DE89370400440532013000"),
    ("card", "4111 1111 1111 1111", "4111 1111 1111 1111 123"),
    ("card", "4111 1111 1111 1111", "123 4111 1111 1111 1111"),
])
def test_a_value_is_found_in_a_longer_run(kind, value, text):
    (span,) = P.pseudonymised(text, KEY)["spans"]
    assert (span["kind"], text[span["start"] : span["end"]]) == (kind, value)
    assert span["pseudonym"] == P.pseudonymised(value, KEY)["content"] != value


def test_two_values_in_one_run():
    out = P.pseudonymised("DE89370400440532013000 GB82WEST12345698765432", KEY)
    assert out["n_iban"] == 2 and P.pseudonymised(out["content"], KEY, back=True)["content"] == "DE89370400440532013000 GB82WEST12345698765432"


@pytest.mark.parametrize("value", ["3/14/2021", "14.3.2021", "3.4.2021", "2021-3-4", "2021-3-14", "1/02/2021"])
def test_dates_of_one_digit_keep_their_form(value):
    test_keeps_format_links_and_reverses("date", value)
