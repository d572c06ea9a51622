"""Corpus scan: source code, rule sets, site numbers."""

import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from evimill.operators import report as R
from evimill.operators import site_scan as S
from evimill.sources import files as SF


def scan(spark, *sources):
    rows = [("c", f"f{i}.rs", text) for i, text in enumerate(sources)]
    df = spark.createDataFrame(rows, "crate string, file string, content string")
    scanned = S.scan_files(df, S.CODE_RULES, S.code_text(F.col("content")))
    sites = S.numbered_sites(scanned, S.CODE_RULES).orderBy("site_id").collect()
    return [(r["file"], r["line"], r["kind"], r["pattern"]) for r in sites]


def kinds(spark, source):
    return [(line, kind, pattern) for _, line, kind, pattern in scan(spark, source)]


def test_core_shapes(spark):
    lines = [
        "mod raw {",
        "    pub(crate) unsafe fn first(base: *const u16) -> u16 {",
        "        unsafe { *base }",
        "    }",
        "    pub fn bits(v: f32) -> u32 { unsafe { core::mem::transmute::<f32, u32>(v) } }",
        "    pub fn pick(v: &Vec<u8>) -> &u8 { unsafe { v.get_unchecked(3) } }",
        "}",
        "struct Cell;",
        "unsafe impl Sync for Cell {}",
        'extern "system" { fn tick(); }',
    ]
    assert kinds(spark, "\n".join(lines)) == [
        (2, "unsafe_fn", None),
        (3, "unsafe_block", "ptr_op"), (3, "operation", "ptr_op"),
        (5, "unsafe_block", "transmute"), (5, "operation", "transmute"),
        (6, "unsafe_block", "unchecked_op"), (6, "operation", "unchecked_op"),
        (9, "unsafe_impl", None),
        (10, "extern_block", None),
    ]


def test_literals_hold_no_sites(spark):
    source = "\n".join(
        [
            "// unsafe { *p }",
            "/* unsafe impl X", " unsafe fn y() */",
            'const A: &str = "unsafe { *p } \\" unsafe {";',
            'const B: &str = r##"unsafe { "# *p }"##;',
            "const C: char = '\"'; const D: char = '\\''; fn g<'a>(x: &'a u8) { unsafe { x.read() } }",
            'const E: &[u8] = b"unsafe {"; const F: u8 = b\'"\'; fn h() { unsafe { asm!("nop") } }',
        ]
    )
    assert kinds(spark, source) == [
        (6, "unsafe_block", "ptr_op"), (6, "operation", "ptr_op"),
        (7, "unsafe_block", None), (7, "operation", "inline_asm"),
    ]


def test_long_literals_do_not_exhaust_the_matcher(spark):
    source = 'const A: &str = "' + "\\n x" * 50000 + '";\n/*' + "*x\n" * 50000 + "*/\n" + "a b;\n" * 50000 + "unsafe fn f() {}"
    assert kinds(spark, source) == [(100003, "unsafe_fn", None)]


def test_long_statements_do_not_exhaust_the_matcher(spark):
    chain = "a" + ".b(c)[0]" * 20000 + ".read()"
    comment = "/*" + " x" * 100000 + "*/"
    got = Counter(kinds(spark, f"fn f() {{ unsafe {{ {comment} {chain} {comment}; }} }}"))
    assert got == {
        (1, "unsafe_block", "ptr_op"): 1, (1, "operation", "unchecked_op"): 20000, (1, "operation", "ptr_op"): 1,
    }


def test_operations(spark):
    source = "\n".join(
        [
            "let a = *p + b * c;",
            "let t: *const u8 = q as *mut u8;",
            "v[0] = w[1][2];",
            "let s: &mut [u8] = &mut [0; 4];",
            "core::ptr::read(p); spread(x); ptr::write::<u8>(p, 1); read!(x);",
            "x.copy_to(y); x.read_exact(y); x.write(1); x.get_unchecked_mut::<u8>(1);",
            "unchecked::add(1); fn transmute(x: u8) {}",
            "std::arch::asm!(\"\"); global_asm!(\"\"); my::asm!(\"\");",
            "use foo::*; a *= 2; **r = 1;",
        ]
    )
    got = [(line, pattern) for line, kind, pattern in kinds(spark, source) if kind == "operation"]
    assert got == [
        (1, "ptr_op"),
        (3, "unchecked_op"), (3, "unchecked_op"), (3, "unchecked_op"),
        (5, "ptr_op"), (5, "ptr_op"), (5, "ptr_op"),
        (6, "ptr_op"), (6, "ptr_op"), (6, "unchecked_op"),
        (7, "unchecked_op"),
        (8, "inline_asm"),
        (9, "ptr_op"), (9, "ptr_op"),
    ]


def test_block_pattern_is_that_of_the_first_whole_statement(spark):
    blocks = {
        "unsafe { *p }": "ptr_op",
        "unsafe { *p = 1; }": None,
        "unsafe { *p + 1 }": None,
        "unsafe { let x = *p; x }": None,
        "unsafe { foo(*p); p.write(1); std::mem::transmute(x) }": "ptr_op",
        "unsafe { std::mem::transmute::<Vec<u8>, X>(y) }": "transmute",
        "unsafe { if *p { return; } xs.get_unchecked(f(1, g(2))) }": "unchecked_op",
        "unsafe { return *p; }": None,
        "unsafe { xs[i] }": "unchecked_op",
        "unsafe { p.read() as u8 }": None,
        "unsafe { { *p } }": None,
        "unsafe { a.b().c[0].read() }": "ptr_op",
        "unsafe {}": None,
        "unsafe { a\n    .b()\n    .read() }": "ptr_op",
        "unsafe { a // why\n ; c\n[0] }": None,
        "unsafe { { a { b } }; q::read(p) }": "ptr_op",
    }
    for source, pattern in blocks.items():
        got = [p for _, kind, p in kinds(spark, f"fn f() {{ {source} }}\n") if kind == "unsafe_block"]
        assert got == [pattern], source


def test_constructs_split_over_lines(spark):
    source = "unsafe\n{ f() }\npub unsafe\nfn g() {}\nextern\n{ fn h(); }\nunsafe\n  impl A for B {}\n"
    assert kinds(spark, source) == [
        (1, "unsafe_block", None), (4, "unsafe_fn", None), (5, "extern_block", None), (8, "unsafe_impl", None),
    ]


def test_function_pointer_types_are_no_functions(spark):
    assert kinds(spark, "type F = unsafe fn(u8); struct S { f: unsafe extern \"C\" fn() }") == []


def test_site_numbers_follow_file_line_and_text(spark):
    got = scan(spark, "unsafe fn a() {}\nunsafe fn b() {}\n", "fn c() {}", "unsafe impl A for B {} unsafe fn d() {}")
    assert [(f, line) for f, line, *_ in got] == [("f0.rs", 1), ("f0.rs", 2), ("f2.rs", 1), ("f2.rs", 1)]
    assert [kind for *_, kind, _ in got] == ["unsafe_fn", "unsafe_fn", "unsafe_impl", "unsafe_fn"]


def test_site_numbers_widen(spark):
    df = spark.range(3).selectExpr("'c' AS crate", "concat('f', id) AS file", "repeat('unsafe impl A {}\n', 4000) AS content")
    scanned = S.scan_files(df, S.CODE_RULES, S.code_text(F.col("content")))
    ids = [r["site_id"] for r in S.numbered_sites(scanned, S.CODE_RULES).orderBy("file", "line").select("site_id").collect()]
    assert ids == [f"U{i:04d}" for i in range(1, 12001)]


def test_rows_of_one_file_are_numbered_together(spark):
    """A page fetched twice: sites of both in one order of lines, as the window of the SQL has them."""
    rows = [
        ("c", "b", "<script\n\n<!-- <nav"), ("c", "a", "<!--"), ("c", "b", "<style\n<table\n<div &amp; <nav"), ("c", "b", "\n\n<div"), ("d", "b", "<nav"),
    ]
    df = spark.createDataFrame(rows, "crate string, file string, content string")
    sites = S.numbered_sites(S.scan_files(df, S.HTML_RULES), S.HTML_RULES)
    got = [tuple(r) for r in sites.orderBy("crate", "site_id").select("crate", "site_id", "file", "line", "seq", "rule_id").collect()]
    assert got == [
        ("c", "U0001", "a", 1, 1, 3), ("c", "U0002", "b", 1, 1, 1), ("c", "U0003", "b", 1, 1, 2), ("c", "U0004", "b", 2, 1, 6),
        ("c", "U0005", "b", 3, 1, 3), ("c", "U0006", "b", 3, 1, 6), ("c", "U0007", "b", 3, 1, 6), ("c", "U0008", "b", 3, 2, 5),
        ("c", "U0009", "b", 3, 2, 6), ("c", "U0010", "b", 3, 3, 6), ("d", "U0001", "b", 1, 1, 6),
    ]


def test_summary_counts_kind_before_pattern(spark):
    df = spark.createDataFrame(
        [("c", k, p) for k, p in [("unsafe_block", "ptr_op"), ("operation", "ptr_op"), ("operation", "inline_asm"), ("x", None), ("unsafe_fn", None)]],
        "crate string, kind string, pattern string",
    )
    got = R.pattern_summary(df).first().asDict()
    assert {k: v for k, v in got.items() if v and k != "crate"} == {
        "unsafe_blocks": 1, "unsafe_fns": 1, "ptr_ops": 1, "inline_asm": 1, "other": 1,
    }


def test_unbalanced_files_are_kept_apart(spark):
    rows = [("c", "good.rs", "fn a() { \"[\" }"), ("c", "bad.rs", "fn broken([) {}\n")]
    df = spark.createDataFrame(rows, "crate string, file string, content string")
    balanced = S.brackets_balance(S.blank_literals(F.col("content")))
    rejected = S.rejected_files(df, F.when(~balanced, F.lit("unbalanced")))
    assert [tuple(r) for r in rejected.collect()] == [("c", "bad.rs", "unbalanced")]
    assert [r["file"] for r in df.filter(balanced).collect()] == ["good.rs"]


def test_corpus_reader_prunes_below_the_crate_only(spark, tmp_path):
    root = tmp_path / "vendor" / "corpus"
    for path in ["one/src/lib.rs", "one/src/a b.rs", "one/target/gen/lib.rs", "one/fuzz/t.rs", "one/x.txt", "two/.git/a.rs", "two/main.rs"]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"unsafe fn f() {}\xff\n")
    got = SF.read_corpus(spark, str(root)).orderBy("crate", "file").collect()
    assert [(r["crate"], r["file"]) for r in got] == [("one", "src/a b.rs"), ("one", "src/lib.rs"), ("two", "main.rs")]
    assert got[0]["content"] == "unsafe fn f() {}�\n"


@pytest.mark.parametrize("root", ["plain", "my corpus +1%20é"])
def test_readers_name_files_however_the_root_is_written(spark, tmp_path, root):
    top = tmp_path / root
    for path in ["my crate/src/a%b +.rs", "two/main.rs", "crates/my crate/logs/fuzz.a b.log", "one/corpus/t 1/x/y"]:
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(b"x")
    for written in [str(top), str(top) + "/", "file:" + str(top), "file://" + str(top)] if root == "plain" else [str(top)]:
        got = {(r["crate"], r["file"]) for r in SF.read_corpus(spark, written).collect()}
        assert got == {("my crate", "src/a%b +.rs"), ("two", "main.rs")}
        assert [(r["crate"], r["name"]) for r in SF.read_tool_logs(spark, written).collect()] == [("my crate", "a b")]
        assert [(r["crate"], r["target"], r["file"]) for r in SF.read_seeds(spark, written).collect()] == [("one", "t 1", "x/y")]

def test_readers_refuse_patterns(spark, tmp_path):
    for read in (SF.read_corpus, SF.read_tool_logs, SF.read_seeds):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "*"))


@pytest.mark.parametrize("depth", [1, 5, 6, 20])
def test_block_patterns_at_any_depth(spark, depth):
    nested = "if a { " * depth + "} " * depth
    call = "f(" * depth + ")" * depth
    index = "g[" * depth + "0" + "]" * depth
    blocks = [f"{nested}*p;", f"{call};", f"{index};", f"{nested}", f"x({nested})"]
    text = "\n".join(f"fn a() {{ unsafe {{ {b} }} }}" for b in blocks)
    got = scan(spark, text)
    assert [p for _, _, k, p in got if k == "unsafe_block"] == ["ptr_op", None, "unchecked_op", None, None]


def test_functions_a_trait_declares_are_no_sites(spark):
    text = (
        "unsafe trait Q { unsafe fn m(&self); unsafe fn d(&self) { unsafe { *p } unsafe fn inner() {} } }\n"
        "unsafe fn x() {}\nimpl T for Y { unsafe fn z() {} }\n"
        "mod m { trait R {\n unsafe extern \"C\" fn q(); } unsafe fn w() {} }"
    )
    assert [line for _, line, k, _ in scan(spark, text) if k == "unsafe_fn"] == [1, 2, 3, 5]


def test_rejected_files_have_no_sites(spark):
    rows = [("c", "good.rs", "unsafe fn a() {}"), ("c", "bad.rs", "unsafe fn broken([) {}\n"), ("c", "text.rs", "unsafe fn b() { \"}\" }")]
    df = spark.createDataFrame(rows, "crate string, file string, content string")
    assert [(r["file"], r["reason"]) for r in S.code_rejects(df).collect()] == [("bad.rs", "unbalanced brackets")]
    assert {r["file"] for r in S.site_rows(S.scan_code(df), S.CODE_RULES).collect()} == {"good.rs", "text.rs"}


def _marks_in_traits(text):
    """For each ``unsafe fn``, whether the block around it is a trait's, with a plain stack."""
    out, stack, header = [], [], False
    for token in re.findall(r"trait\b|unsafe fn|[{};]", text):
        if token == "trait":
            header = True
        elif token == "{":
            stack.append(header)
            header = False
        elif token == "}":
            stack[-1:] = []
        elif token == ";":
            header = False
        else:
            out.append(bool(stack) and stack[-1])
    return out


def test_trait_blocks_at_any_depth(spark):
    """Deeper than one number of the stack holds, back and forth over its edge."""
    draw, texts = random.Random(3), []
    for _ in range(30):
        depth, parts = 0, []
        for _ in range(draw.choice([5, 200, 900])):
            grow = draw.random() < (0.7 if depth < 130 else 0.3)
            if grow or not depth:
                parts.append(draw.choice(["{ ", "trait T { ", "trait T<A> where A: B { "]))
                depth += 1
            else:
                parts.append("} ")
                depth -= 1
            parts.append(draw.choice(["", "", "unsafe fn a(); ", "trait X; ", "unsafe extern fn b() "]))
        texts.append("".join(parts) + "}" * depth)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4)
    got = {r["k"]: r["t"] for r in frame.select("k", S.without_trait_functions(F.col("t")).alias("t")).collect()}
    for k, text in enumerate(texts):
        wanted = iter(_marks_in_traits(text.replace("unsafe extern fn", "unsafe fn")))
        assert got[k] == re.sub(r"unsafe(?=\s+(?:extern\s+)?fn\b)", lambda m: "      " if next(wanted) else "unsafe", text)


def test_blocks_are_read_in_one_pass(spark):
    """Nesting far beyond what a pass for each level could take; the plan names each text once."""
    levels = 20_000
    deep = "fn a() { unsafe { " + "{" * levels + "}" * levels + "; *p } }"
    trait = "trait T { unsafe fn a(); fn b() { " + "{" * levels + " unsafe fn c() {}" + "}" * levels + " } }"
    parens = "fn a() { unsafe { f(" + "(" * levels + ")" * levels + "); transmute(x) } }"
    assert kinds(spark, deep)[0] == (1, "unsafe_block", "ptr_op")
    assert kinds(spark, trait) == [(1, "unsafe_fn", None)]
    assert kinds(spark, parens)[0] == (1, "unsafe_block", "transmute")
    frame = spark.createDataFrame([("c", "f", deep)], "crate string, file string, content string")
    plan = S.scan_code(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan


def test_long_literals_leave_little_to_search(spark):
    """At most eight spaces of a literal's line remain, and its sites are those of the text blanked in full."""
    gaps = ["", *[" " * n for n in (1, 2, 5, 9)], *[f"/*{'é' * n}*/" for n in (0, 1, 3, 4, 5, 40)], "/* a\n * b **/", '"' + "x" * 30 + '"']
    shapes = ["fn{}transmute(x);", "fn {}read::{}<u8>(x);", "unsafe{}{{ *p }}", "unsafe{}fn f() {{}}", "a{}.get_unchecked{}(1)", "x ={}*p;"]
    sources = [shape.replace("{{", "\0").replace("}}", "\1").replace("{}", gap).replace("\0", "{").replace("\1", "}") for shape in shapes for gap in gaps]
    sources += ['r##"a"# "b"##; *p', 'r"a"; *p', "/* open *p", "/***/ *p", "/**/*/ *p", "/* " + "* x " * 50_000 + "*/ *p", 'r#"' + '" ' * 50_000 + '"#; *p']
    df = spark.createDataFrame([("c", f"f{i:03}", s) for i, s in enumerate(sources)], "crate string, file string, content string")
    segment = r"""//[^\n]*+|/\*[\s\S]*?\*/|b?r(#*+)"[\s\S]*?"\1|b?\"""" + S._SEGMENT.split('|b?"', 1)[1]
    in_full = F.array_join(
        F.transform(
            F.regexp_extract_all("content", F.lit(segment), F.lit(0)),
            lambda s: F.when(s.rlike(S._OPAQUE), F.regexp_replace(s, r"[^\n]", " ")).otherwise(s),
        ),
        "",
    )
    expected = S.scan_files(df, S.CODE_RULES, S.marked_code(in_full))
    got = S.scan_files(df, S.CODE_RULES, S.code_text(F.col("content")))
    assert expected.exceptAll(got).isEmpty() and expected.count() == got.count()
    assert sum(len(r["sites"]) for r in got.collect()) > len(sources) / 2
    widest = df.filter("length(content) > 1000").select(F.max(F.length(S.blank_literals(F.col("content")))).alias("n")).first()["n"]
    assert widest <= 8 + len("; *p")
