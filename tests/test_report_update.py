"""Reports brought up to date against reports made anew."""

from pyspark.sql import functions as F

from evimill.operators import report as R
from evimill.operators import report_update as RU
from evimill.operators.study_plan import RunSettings
from evimill.sources import reports as SR

SITES = "crate string, file string, line int, kind string, pattern string, number bigint, site_id string"
RUNS = "crate string, kind string, name string, status string, record_no bigint"


def sites(*crates):
    return [(c, "a.rs", i + 1, "operation", "ptr_op", i + 1, f"U{i + 1:04d}") for c, n in crates for i in range(n)]


def runs(*crates):
    return [(c, "fuzz", f"t{i}", "clean" if i else None, i) for c, n in crates for i in range(n)]


def maker(spark, site_rows, run_rows, seen):
    tables = {"sites": spark.createDataFrame(site_rows, SITES), "runs": spark.createDataFrame(run_rows, RUNS)}

    def make(stale):
        chosen = tables if stale is None else {k: df.join(stale, "crate", "left_semi") for k, df in tables.items()}
        seen.append({r["crate"] for df in chosen.values() for r in df.select("crate").distinct().collect()})
        found, ran = chosen["sites"], chosen["runs"]
        crates = found.select("crate").union(ran.select("crate")).distinct().join(
            found.groupBy("crate").agg(F.count(F.lit(1)).alias("n_sites")), "crate", "left"
        )
        review = found.filter("number <= 2").select("crate", F.col("number").cast("int").alias("rank"), "site_id", "file", "line", F.lit("r").alias("reason"))
        return R.nested_report(RunSettings(study_name="s"), crates, found, ran, review, ["record_no"], chunk_rows=3)

    return tables, make


def documents(spark, path):
    return sorted((r["section"], r["document"]) for r in SR.read_documents(spark, path).collect())


def test_only_changed_crates_are_made_again(spark, tmp_path):
    states = [
        (sites(("a", 4), ("b", 1), ("c", 7)), runs(("a", 3), ("b", 5), ("c", 1))),
        (sites(("a", 4), ("b", 1), ("c", 7)), runs(("a", 3), ("b", 6), ("c", 1), ("d", 8))),  # more runs, a new crate
        (sites(("a", 4), ("b", 1)), runs(("a", 3), ("b", 6), ("d", 8))),  # a crate gone
        (sites(("a", 4), ("b", 1)), runs(("a", 3), ("b", 6), ("d", 8))),  # nothing new
        ([*sites(("a", 4), ("b", 1)), sites(("a", 1))[0]], runs(("a", 3), ("b", 6), ("d", 8))),  # a row twice
    ]
    made, before = [], None
    for k, state in enumerate(states):
        tables, make = maker(spark, *state, made)
        path, anew = str(tmp_path / f"r{k}"), str(tmp_path / f"anew{k}")
        SR.update_report(spark, before, path, tables, make)
        SR.update_report(spark, None, anew, tables, maker(spark, *state, [])[1])
        assert documents(spark, path) == documents(spark, anew)
        before = path
    assert made == [{"a", "b", "c"}, {"b", "d"}, set(), set(), {"a"}]
    back = SR.read_report(spark, before)
    assert back["phases"].filter("crate = 'd'").count() == 8 and back["study"].count() == 1
    assert {r["crate"] for r in back["crates"].collect()} == {"a", "b", "d"}


def test_digests(spark):
    schema = "crate string, x string, y string"

    def digest(rows):
        got = RU.input_digests({"t": spark.createDataFrame(rows, schema)}).collect()
        return {(r["crate"], r["input"]): (r["n_rows"], r["digest"]) for r in got}

    base = digest([("a", "1", "2"), ("a", "3", None), ("b", None, None)])
    assert base == digest([("b", None, None), ("a", "3", None), ("a", "1", "2"), (None, "x", "y")])
    assert digest([("a", "1", None)]) != digest([("a", None, "1")])
    assert digest([("a", "1", "2")] * 2) != digest([("a", "1", "2")]) and digest([]) == {}
    assert set(base) == {("a", "t"), ("b", "t")} and base["a", "t"][0] == 2
