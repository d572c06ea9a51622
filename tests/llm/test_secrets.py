import hashlib
import random
import re

from cases import EDGES, files
from evimill.llm import secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEY = "AKIA" + "QW3RTY7ZUX9PLMK2"
TOKEN = "ghp_" + "a8Fk2LmQ9xZr4TnB7vCs1WdE6yHu"


def slow_base(text):
    text, found = text or "", []
    for m in re.finditer(ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    for kind, (name, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)], 1):
        found += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{name}:{start}:{end}" for start, _, end, name in sorted(found)]


def test_base_spans_match_the_definition(spark):
    draw = random.Random(4)
    bits = ["password", "PassWd", "ſecret", "token", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABC123XYZ9", "deadbeef", "0123456789abcdef", "é", "\n", "x" * 11, "y" * 12]
    rows = [(k, "a", "".join(draw.choices(bits, k=draw.randint(0, 14)))) for k in range(400)]
    found = {r["file_id"]: r for r in secrets.scan_secrets(files(spark, rows)).collect()}
    for k, _, text in rows:
        base = slow_base(text)
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[k]["spans"].split(",")) | {""}
        counts = [sum(s.startswith(kind) for s in base) for kind in ("assign:", "access:", "hex:")]
        assert [found[k][c] for c in ("n_assign", "n_access", "n_hex")] == counts


def test_ownership_decides(spark):
    shared = [(k, f"owner{k}", f"see {TOKEN}") for k in range(5)]
    own = [(10, "one", "mine " + TOKEN[::-1].replace("_phg", "")), (11, "one", f"key {KEY}"), (12, "one", "password = changeme-example")]
    found = {r["file_id"]: r for r in secrets.scan_secrets(files(spark, shared + own)).collect()}
    assert all(found[k]["spans"] == "" for k in range(5))  # five owners: a copied example
    assert found[11]["live_spans"] == "access:4:24" and found[11]["n_live"] == 1
    assert found[12]["n_assign"] == 1 and found[12]["n_live"] == 0  # reported, but not live
    few = {r["file_id"]: r for r in secrets.scan_secrets(files(spark, shared[:2])).collect()}
    assert all(few[k]["spans"].startswith("forge:4:") for k in range(2))


def test_counts_of_owners_and_repositories(spark):
    rows = [("s", "o1", "c1"), ("s", "o1", "c1"), ("s", "o1", "c2"), ("s", None, None), ("t", "o2", "c1")]
    spread = secrets.ownership(spark.createDataFrame(rows, "secret string, cohort string, crate string"))
    assert sorted(tuple(r) for r in spread.collect()) == [("s", 2, 3), ("t", 1, 1)]


def test_masking_keeps_rows_and_columns(spark):
    url = "git clone https://user:s3cr3tPa55w0rd@host/x"
    table = files(spark, [*EDGES, (20, "one", f"a {KEY} b {KEY}"), (21, "one", None), (22, "one", url)])
    masked = secrets.without_live_secrets(table)
    assert masked.columns == table.columns
    texts = {r["file_id"]: r["content"] for r in masked.collect()}
    assert texts[20] == "a [credential] b [credential]" and texts[21] is None and texts[1] == EDGES[0][2]
    assert texts[22] == "git clone https://user:[credential]@host/x"
    assert masked.count() == len(EDGES) + 3


def test_edges(spark):
    rows = secrets.scan_secrets(files(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r["spans"] == "" and r["n_live"] == 0 for r in rows)
    assert not secrets.scan_secrets(files(spark, [])).collect()
    assert not secrets.without_live_secrets(files(spark, [])).collect()


def test_a_key_in_many_documents_of_one_source_is_live(spark):
    rows = [(f"c{k}", "one", f"key {KEY} {k}") for k in range(3000)] + [("d", "two", f"key {TOKEN}")]
    schema = "crate string, cohort string, content string"
    table = spark.createDataFrame(rows, schema).selectExpr("monotonically_increasing_id() as file_id", "*")
    found = secrets.scan_secrets(table).where("crate <> 'd'").collect()
    assert len(found) == 3000 and all(r["live_spans"] == "access:4:24" for r in found)
    assert not secrets.without_live_secrets(table).where(f"contains(content, '{KEY}')").count()
