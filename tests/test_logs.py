"""Log classification against golden rows and a plain model."""

import random
import re

from pyspark.sql import functions as F

from evimill.functions import logs as L
from evimill.operators import evidence as E

C = F.col
PTRACE = "LeakSanitizer has encountered a fatal error. does not work under ptrace"


def status_of(evaluate, rows):
    return evaluate(rows, "ok boolean, t string", L.fuzz_status(C("ok"), L.marks(C("t"))))


def test_interpreter_verdicts(evaluate):
    ub, none = "undefined behavior: stacked borrow", "ok"
    cases = [
        (False, ub, none), (False, ub, ub), (False, ub, None), (True, ub, None), (True, none, None), (False, none, None),
    ]
    verdict = L.interpreter_verdict(C("ok"), L.has_ub(L.marks(C("s"))), L.has_ub(L.marks(C("b"))))
    got = evaluate(cases, "ok boolean, s string, b string", verdict)
    assert got == ["strict_only_ub", "ub_observed", "ub_observed", "ub_observed", "clean", "failed_no_ub"]
    assert evaluate([(v,) for v in got], "v string", L.verdict_status(C("v"))) == [
        "finding", "finding", "finding", "finding", "clean", "error",
    ]


def test_ub_categories_first_match_wins(evaluate):
    rows = {
        "Stacked Borrows, alignment": "provenance",
        "Stacked Borrow alignment": "provenance",
        "UB: unaligned and bounds": "alignment",
        "index out of bounds": "out_of_bounds",
        "using UNINITIALIZED data": "uninitialized",
        "stub: nothing": "other_ub",
        "fine": None,
    }
    assert evaluate([(t,) for t in rows], "t string", L.ub_category(L.marks(C("t")))) == list(rows.values())


def test_fuzz_status_golden(evaluate):
    rows = [
        (False, "panic occurred"), (True, "Done 19313761 runs in 31 second(s)"), (True, "nothing"), (False, PTRACE),
        (False, "failed to execute fuzz target"), (False, "no room"), (True, "  Done 1 runs in 2 second(s)\r"),
        (True, "xDone 1 runs in 2 second(s)"), (True, "Done runs in\n second(s)"),
    ]
    got = status_of(evaluate, rows)
    assert got == ["finding", "pass", "clean", "error", "error", "finding", "pass", "clean", "clean"]
    kinds = evaluate([(s, t) for s, (_, t) in zip(got, rows)], "s string, t string", L.fuzz_error_kind(C("s"), L.marks(C("t"))))
    assert kinds[:6] == ["finding", None, None, "environment_error", "tool_error", "finding"]


def test_fuzz_runs_golden(evaluate):
    rows = {
        "Done 19313761 runs in 31 second(s)": 19313761,
        "#1 runs: 123 cov: 4": 123,
        "runs:7": 7,
        "runs:  8": None,
        "runs: runs:5 runs:6": 6,
        "runs: x 5": None,
        "preruns:5": None,
        "runs:18446744073709551615": 18446744073709551615,
        "runs:18446744073709551616 runs:3": 3,
        "runs:x\nDone 4 runs": 4,
        "Done x\nDone +5 runs": 5,
        " Done 4 runs": None,
        "Done 6x runs": None,
        "": None,
    }
    got = evaluate([(t,) for t in rows], "t string", L.fuzz_runs(L.marks(C("t"))))
    assert [None if v is None else int(v) for v in got] == list(rows.values())


def model_runs(text):
    """The rule in plain words: numbers glued to or right after ``runs:``, then Done lines."""

    def number(token):
        return int(token) if re.fullmatch(r"[0-9]+", token) and int(token) < 1 << 64 else None

    awaited = False
    for token in re.split(r"[^0-9A-Za-z:]", text):
        candidate = token if awaited else token[5:] if token.startswith("runs:") else ""
        if number(candidate) is not None:
            return number(candidate)
        awaited = not awaited and token == "runs:"
    for line in text.split("\n"):
        match = re.match(r"Done \s*\+?([0-9]+)(?=\s|$)", line)
        if match and number(match[1]) is not None:
            return number(match[1])
    return None


def test_fuzz_runs_random(evaluate):
    rng = random.Random(7)
    parts = ["runs:", "runs:12", " ", " ", "5", "x", "\n", "Done ", "Done 3 ", ":", "runs", ",", "99999999999999999999"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(3000)]
    got = evaluate([(t,) for t in texts], "t string", L.fuzz_runs(L.marks(C("t"))))
    wrong = [(t, g) for t, g in zip(texts, got) if (None if g is None else int(g)) != model_runs(t)]
    assert not wrong


def test_fuzz_summary(evaluate):
    rows = [("error", 19313761, PTRACE), ("pass", 5, "Done 5 runs"), ("clean", None, "")]
    runs = C("r").cast("decimal(20,0)")
    got = evaluate(rows, "s string, r bigint, t string", L.fuzz_summary(F.lit("parse"), F.lit(30), C("s"), runs, L.marks(C("t"))))
    assert got == [
        "target parse, budget 30s, 19313761 runs, environment error: LeakSanitizer unsupported under ptrace",
        "target parse, budget 30s, 5 runs, pass (reached budget limit without findings)",
        "target parse, budget 30s, clean",
    ]


def test_build_failure(evaluate):
    missing = "error: can't find bin `t` at path `/tmp/x/fuzz_targets/t.rs`"
    got = evaluate([(missing,), ("boom",), (" \n",)], "t string", L.build_failure(F.lit("t"), F.lit(60), C("t"), L.marks(C("t"))))
    assert [tuple(r) for r in got] == [
        ("skipped", None, "target t, budget 60s, declared source missing at /tmp/x/fuzz_targets/t.rs", missing),
        ("error", "tool_error", "target t, budget 60s, build error", "boom"),
        ("error", "tool_error", "target t, budget 60s, build error", "cargo fuzz build failed for t"),
    ]


def package(name, count, path=None):
    source = f'{{"Path":"{path}"}}' if path else '{"Registry":{"name":"r"}}'
    return (
        f'{{"package":{{"id":{{"name":"{name}","source":{source}}}}},'
        f'"unsafety":{{"used":{{"functions":{{"unsafe_":1}},"exprs":{{"unsafe_":{count}}}}}}}}}'
    )


def report(*packages):
    return '{"packages":[' + ",".join(packages) + "]}"


def counts(evaluate, texts):
    report = L.last_report(L.marks(C("t")))["report"]
    got = evaluate([(t,) for t in texts], "t string", L.package_counts(report, F.lit("demo"), F.lit("/w/demo")))
    return [tuple(r) for r in got]


def test_package_counts(evaluate):
    own, dep = package("demo", 4, "file:///w/demo%230.1.0"), package("dep", 1)
    other = package("demo", 9, "file:///elsewhere")
    texts = [
        '{"$message_type":"artifact"}\n' + report(own, dep),
        report(dep, other, own),
        report(other, dep),
        report(dep),
        report(),
        report(own) + "\n" + report(package("demo", 7), dep) + "\nnot json",
        report(own) + '\n{"packages":[{"package":{}}]}',
        report(own) + '\n{"packages": broken',
        report(own) + '\n{"packages":[]} trailing',
        report(own) + "\n" + report(dep).replace("}]}", "}],'x':1}"),
        report(own) + '\n{"packages":5}',
        report(own) + "\n" + report(package("demo", '"7"')),
        "nothing",
    ]
    assert counts(evaluate, texts) == [
        (4, 1), (4, 10), (9, 1), (None, None), (None, None), (7, 1), (4, 0), (4, 0), (4, 0), (4, 0), (4, 0), (4, 0), (None, None),
    ]


def test_counter_status_and_summary(evaluate):
    panic = "thread 'main' panicked at x\nassertion failed: self.pending_ids.insert(id)"
    got = evaluate([(False, panic), (True, panic), (False, "x")], "ok boolean, t string", L.counter_status(C("ok"), L.marks(C("t"))))
    assert got == ["skipped", "clean", "error"]
    rows = [("clean", True, 4, 1), ("clean", True, 4, None), ("skipped", False, None, None), ("clean", True, None, None), ("error", False, None, None)]
    got = evaluate(rows, "s string, ok boolean, r bigint, d bigint", L.counter_summary(C("s"), C("ok"), C("r"), C("d")))
    assert got == [
        "root unsafe exprs 4, dependency unsafe exprs 1", "root unsafe exprs 4", "geiger tool failure, skipped",
        "geiger completed", "geiger failed",
    ]


def test_marks_are_all_that_occur(evaluate):
    """Overlapping words, any case, lines and fields, against one search for each of them."""
    draw = random.Random(12)
    words = [*L._FOLDED, "OOM", "Panic", "\u212aUB:", "thread 'main'", "Thread 'main'", "room", "unBounds", "leaksanitizer has", " ", "\n", "x"]
    texts = ["".join(draw.choices(words, k=draw.randrange(12))) for _ in range(300)]
    got = evaluate([(t,) for t in texts], "t string", L.marks(C("t")))
    for text, found in zip(texts, got, strict=True):
        lower = text.translate({c: c + 32 for c in range(65, 91)})
        assert {m.lower() for m in found if len(m) <= L._LONGEST and m.lower() in L._FOLDED} == {w for w in L._FOLDED if w in lower}
        assert ("thread 'main'" in found) == ("thread 'main'" in text)
    assert evaluate([(None,)], "t string", L.marks(C("t"))) == [None]


def test_marks_of_lines_and_fields(evaluate):
    text = "Done 1\n\tDone 2 runs in 3 second(s)\nnot Done 4\n {\"a\": 1}\nruns: runs: 7 xruns:8 runs:9"
    (found,) = evaluate([(text,)], "t string", L.marks(C("t")))

    assert [m for m in found if m.startswith("runs:")] == ["runs: runs:", "runs: 7", "runs:9"]
    assert found[:3] == ["Done 1", "\tDone 2 runs in 3 second(s)", ' {"a": 1}']


def test_records_search_a_log_once(spark):
    """Neither the records nor their statuses look into the text again for any classifier."""
    runs = spark.createDataFrame(
        [("c", "fuzz", "t", False, 5, "panic")], "crate string, kind string, name string, success boolean, duration_ms bigint, combined_output string"
    )
    for frame in (E.phase_records(runs, F.lit("/w/c")), E.run_statuses(runs)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and not re.search(r"combined_output#\d+[^,]*RLIKE", plan)


def test_undefined_behaviour_read_off_the_log_itself(evaluate):
    words = ["Undefined BEHAVIOR", "UB:", "ub", "stub:", "stacked borrow", "out-of-bounds", "bounds", "unaligned", "uninitializeD", "ſtacked borrow", "İ", " {", "\n", " ", "", "K", "Done 5", "runs: 7"]
    rows = [(a + b + c,) for a in words for b in words for c in ("", " x")] + [(None,)]
    got = evaluate(rows, "t string", L.text_has_ub(C("t")))
    assert got == evaluate(rows, "t string", L.has_ub(L.marks(C("t")))) and {True, False, None} == set(got)


def test_a_finding_is_searched_once(spark):
    runs = spark.createDataFrame([("c", "x", "targeted", False, 5, "UB: unaligned")], "crate string, case_name string, scope string, success boolean, duration_ms bigint, combined_output string")
    cases = E.case_records(runs, runs)
    assert cases.first()["ub_category"] == "alignment"
    plan = cases._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # once in either branch, or once behind both
