"""Rule-table scan of a text corpus.

A rule set is compiled into one alternation, so each line is searched once whatever the
number of rules; matches never overlap and come in text order. Everything up to the list
of sites of a file happens inside its row: no join with the rules, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimill.operators.numbering import in_ranges, placed_rows
from evimill.operators.rows import explode_once


@dataclass(frozen=True)
class Rule:
    """A kind of site.

    ``rx`` finds candidates; ``tag``, tested on the text a candidate matched, tells apart
    rules that share it (default: ``rx`` matches the whole of that text). The first rule
    whose tag fits takes the match, a match no rule takes is no site.

    ``starts`` (the inside of a character class) says what a match begins with, and
    ``not_after`` what it never follows. They spare the matcher most positions, and a rule
    that begins with a run of characters is tried once per run, not once per character.
    """

    rule_id: int
    kind: str
    pattern: str | None
    rx: str
    tag: str | None = None
    starts: str | None = None
    not_after: str | None = None

    def takes(self, text: Column) -> Column:
        return text.rlike(self.tag or f"^(?:{self.rx})$")


HTML_RULES = [
    Rule(1, "block", "script", "<script", starts="<"),
    Rule(2, "block", "style", "<style", starts="<"),
    Rule(3, "comment", None, "<!--", starts="<"),
    Rule(4, "operation", "link", 'href="', starts="h"),
    Rule(5, "operation", "entity", "&[a-z]+;", starts="&"),
    Rule(6, "element", None, "<(?:div|nav|table)", starts="<"),
]

_NAME = "A-Za-z0-9._-"
TEXT_RULES = [
    Rule(1, "reference", "link", r"https?://[^ \t\n]+", starts="h"),
    Rule(2, "reference", "address", rf"[{_NAME}]+@[A-Za-z0-9-]+\.[A-Za-z.]+", starts=_NAME, not_after=_NAME),
    Rule(3, "number", "long", r"[0-9][0-9-]{6,}", starts="0-9"),
    Rule(4, "number", None, r"[0-9]+", starts="0-9"),
    Rule(5, "notice", "license", r"[Ll]icen[sc]e[ds]?", starts="Ll"),
    Rule(6, "markup", None, r"[*_#|]{2,}", starts="*_#|"),
]

# ---- source code ------------------------------------------------------------------------

# Comments, raw strings, strings, characters, then runs of anything else. Possessive
# throughout, so a long literal does not deepen the matcher's stack.
_SEGMENT = (
    r"//[^\n]*+"
    r"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
    r'|b?r(#*+)"[^"]*+(?:"(?!\1)[^"]*+)*+"\1'
    r'|b?"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
    r"|b?'(?:[^'\\\n]|\\[^\n']+|\\')'"
    r"""|(?:(?!b?r#*+"|b?["'])\w++|[^/"'\w])++"""
    r"|[\s\S]"
)
_OPAQUE = r"""^(?://|/\*|b?r?#*"|b?'[\s\S]+')"""

_GENERICS = r"(?:::\s?<[^(){};]*>)?"
_CALL = rf"(?<![\w.:!])(?<!\bfn\s{{1,4}})(?:::)?(?:\w++::(?!<))*+\w++{_GENERICS}\("
_METHOD = rf"\.\s*\w++\s*{_GENERICS}\("
_DEREF = r"(?<![\w)\]])\*(?!\s*(?:const|mut)\b)(?=[A-Za-z_(*])"
_INDEX = r"(?<=[\w\])?])\["
_BLOCK = r"\bunsafe\{#\w*#"

_UNCHECKED_METHOD = r"^\.\s*\w*unchecked"
_POINTER_METHOD = r"^\.\s*(?:read|write|copy_to|copy_from)\b"
_TRANSMUTE_CALL = rf"^(?!\.).*transmute{_GENERICS}\($"
_UNCHECKED_CALL = r"^(?!\.)[^<]*unchecked"
_POINTER_CALL = rf"^(?!\.).*(?:read|write){_GENERICS}\($"

_WORD = {"starts": r"\w", "not_after": r"\w"}

CODE_RULES = [
    Rule(1, "extern_block", None, r"\bextern\s*\{", **_WORD),
    Rule(2, "unsafe_fn", None, r"\bunsafe\s+(?:extern\s+)?fn\s+\w++", **_WORD),
    Rule(3, "unsafe_impl", None, r"\bunsafe\s+impl\b", **_WORD),
    Rule(4, "unsafe_block", "ptr_op", _BLOCK, r"^unsafe\{#ptr_op#", **_WORD),
    Rule(5, "unsafe_block", "transmute", _BLOCK, r"^unsafe\{#transmute#", **_WORD),
    Rule(6, "unsafe_block", "unchecked_op", _BLOCK, r"^unsafe\{#unchecked_op#", **_WORD),
    Rule(7, "unsafe_block", None, _BLOCK, r"^unsafe\{##", **_WORD),
    Rule(8, "operation", "ptr_op", _DEREF, r"^\*$", starts="*"),
    Rule(9, "operation", "unchecked_op", _METHOD, _UNCHECKED_METHOD, starts="."),
    Rule(10, "operation", "ptr_op", _METHOD, _POINTER_METHOD, starts="."),
    Rule(11, "operation", "unchecked_op", _INDEX, r"^\[$", starts=r"\["),
    Rule(12, "operation", "inline_asm", r"(?<![\w:])(?:(?:core|std)::arch::)?asm!", **_WORD),
    Rule(13, "operation", "transmute", _CALL, _TRANSMUTE_CALL, starts=r"\w:", not_after=r"\w:"),
    Rule(14, "operation", "unchecked_op", _CALL, _UNCHECKED_CALL, starts=r"\w:", not_after=r"\w:"),
    Rule(15, "operation", "ptr_op", _CALL, _POINTER_CALL, starts=r"\w:", not_after=r"\w:"),
]


#: No rule and no rewriting tells this many spaces of a line from more of them: they count one space
#: before the brackets of a generic call, and up to four behind ``fn``.
_WIDEST = 8


def blank_literals(source: Column) -> Column:
    """Source with comments, strings and characters overwritten by spaces, lines kept.

    A literal leaves a space for each character, at most ``_WIDEST`` on a line, so that what is searched
    afterwards is about the code alone, however long the texts in it are.
    """
    segments = F.regexp_extract_all(source, F.lit(_SEGMENT), F.lit(0))

    def spaces(literal: Column) -> Column:
        return F.array_join(F.transform(F.split(literal, "\n"), lambda line: F.left(F.lit(" " * _WIDEST), F.length(line))), "\n")

    return F.array_join(F.transform(segments, lambda s: F.when(s.rlike(_OPAQUE), spaces(s)).otherwise(s)), "")


def brackets_balance(blanked: Column) -> Column:
    """False for text no compiler would take: some kind of bracket does not even out."""
    test = F.lit(True)
    for opening, closing in ("()", "[]", "{}"):
        test = test & (_occurrences(blanked, opening) == _occurrences(blanked, closing))
    return test


def _occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


_PATH = rf"(?:::)?(?:\w++::(?!<))*+\w++{_GENERICS}"
_OPERAND = rf"(?:{_PATH}|\(\))(?:\(\)|\[\]|\?|\.\w++{_GENERICS})*+"


def _statement_pattern(statement: Column) -> Column:
    """Pattern of a statement that as a whole is one operation (brackets emptied)."""
    call = F.when(statement.rlike(rf"^{_PATH}\(\)$"), F.regexp_replace(statement, r"\)$", ""))
    is_operand = statement.rlike(rf"^{_OPERAND}$")
    method = F.when(is_operand, F.regexp_extract(statement, rf"(\.\w++{_GENERICS}\()\)$", 1))
    return (
        F.when(statement.rlike(rf"^\*[*&]*{_OPERAND}$"), F.lit("ptr_op"))
        .when(call.rlike(_TRANSMUTE_CALL), F.lit("transmute"))
        .when(call.rlike(_UNCHECKED_CALL), F.lit("unchecked_op"))
        .when(call.rlike(_POINTER_CALL), F.lit("ptr_op"))
        .when(method.rlike(_UNCHECKED_METHOD), F.lit("unchecked_op"))
        .when(method.rlike(_POINTER_METHOD), F.lit("ptr_op"))
        .when(is_operand & F.endswith(statement, F.lit("[]")), F.lit("unchecked_op"))
    )


_BRACKET_OR_TEXT = r"[{}()\[\];]|[^{}()\[\];]++"


def block_pattern(after_brace: Column) -> Column:
    """Pattern of the first statement at the top level of a block that has one, else ''.

    One pass over brackets, semicolons and the text between them. Only the depth and the statement
    being read are kept: what is inside brackets leaves them empty, a block ends its statement.
    """

    def step(state: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "(", "["), token.isin("}", ")", "]")
        outside = state["depth"] == 0
        ends = outside & token.isin(";", "{", "}", ")", "]")
        found = F.when(ends, _statement_pattern(_flat(state["statement"])))
        statement = (
            F.when(ends, F.lit(""))
            .when(outside, F.concat(state["statement"], token))
            .when((state["depth"] == 1) & token.isin(")", "]"), F.concat(state["statement"], token))
            .otherwise(state["statement"])
        )
        depth = F.when(opens, state["depth"] + 1).when(closes, state["depth"] - 1).otherwise(state["depth"])
        # below the top level the block is over, and so it is once a pattern is found
        return F.when(state["pattern"].isNotNull() | (state["depth"] < 0), state).otherwise(
            F.struct(depth.alias("depth"), statement.alias("statement"), found.alias("pattern"))
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("statement"), F.lit(None).cast("string").alias("pattern"))

    def last(state: Column) -> Column:
        rest = F.when(state["depth"] >= 0, _statement_pattern(_flat(state["statement"])))
        return F.coalesce(state["pattern"], rest, F.lit(""))

    return F.aggregate(F.regexp_extract_all(after_brace, F.lit(_BRACKET_OR_TEXT), F.lit(0)), start, step, last)


def _flat(statement: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(statement, r"\s++", " "), r" (?=\.)", ""))


_UNSAFE_FN = r"\bunsafe(?=\s+(?:extern\s+)?fn\b)"
_BLOCK_OR_FN = rf"\btrait\b[^{{}};]*+\{{|[{{}}]|{_UNSAFE_FN}"
#: Blocks whose kind fits one number of the stack.
_LEVELS = 60


def _declared_by_trait(blanked: Column) -> Column:
    """A character for each ``unsafe fn``: 1 if the block around it is a trait's.

    One pass over braces with a stack of block kinds, packed as bits: the innermost ``_LEVELS`` in a
    number, those further out in an array, so that no step copies more than a sixtieth of the depth.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("top"), F.lit(0).alias("count"), F.array().cast("array<bigint>").alias("rest"), F.lit("").alias("out")
    )

    def with_(state: Column, **changed: Column) -> Column:
        return F.struct(*(changed.get(name, state[name]).alias(name) for name in ("top", "count", "rest", "out")))

    def step(state: Column, token: Column) -> Column:
        kind = F.when(F.startswith(token, F.lit("trait")), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        filled, opened = F.concat(state["rest"], F.array(state["top"])), F.shiftleft(state["top"], 1) + kind
        refill = (state["count"] == 1) & (F.size(state["rest"]) > 0)
        outer = F.slice(state["rest"], F.lit(1), F.size(state["rest"]) - 1)
        return (
            F.when(token == "unsafe", with_(state, out=F.concat(state["out"], state["top"].bitwiseAND(F.lit(1)).cast("string"))))
            .when((token != "}") & (state["count"] == _LEVELS), with_(state, top=kind, count=F.lit(1), rest=filled))
            .when(token != "}", with_(state, top=opened, count=state["count"] + 1))
            .when(refill, with_(state, top=F.element_at(state["rest"], -1), count=F.lit(_LEVELS), rest=outer))
            .when(state["count"] > 0, with_(state, top=F.shiftright(state["top"], 1), count=state["count"] - 1))
            .otherwise(state)
        )

    return F.aggregate(F.regexp_extract_all(blanked, F.lit(_BLOCK_OR_FN), F.lit(0)), start, step, lambda state: state["out"])


def without_trait_functions(blanked: Column) -> Column:
    """Text in which functions a trait declares itself are no longer marked ``unsafe``. Places do not move."""

    def rewritten(declared: Column) -> Column:
        pieces = F.split(blanked, _UNSAFE_FN)
        mark = lambda i: F.when(F.substring(declared, i, F.lit(1)) == "1", F.lit("      ")).otherwise(F.lit("unsafe"))
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(mark(i), p))), "")

    plain = F.element_at(F.transform(F.array(_declared_by_trait(blanked)), rewritten), 1)
    return F.when(blanked.rlike(r"\btrait\b"), plain).otherwise(blanked)


def code_sites(source: Column, rules: list[Rule]) -> Column:
    """Sites of one source file; none where its brackets do not even out, as no compiler took it."""
    found = F.transform(
        F.array(blank_literals(source)),  # blanked once, for the test and for the scan
        lambda blanked: F.when(brackets_balance(blanked), sites_in(marked_code(blanked), rules)),
    )
    return F.coalesce(F.element_at(found, 1), F.array().cast(SITES))


def code_text(source: Column) -> Column:
    """Source in the form the code rules expect."""
    return marked_code(blank_literals(source))


def marked_code(blanked: Column) -> Column:
    """Blanked source in the form the code rules expect.

    A construct split over lines is drawn together on the line its site is reported for, and
    every block carries its pattern as ``unsafe{#pattern#``.
    """
    text = without_trait_functions(blanked)
    text = F.regexp_replace(text, r"\b(unsafe|extern)(\s++)\{", "$1{$2")
    text = F.regexp_replace(text, r"\bunsafe([^\S\n]*\n\s*)(?=(?:extern|fn|impl)\b)", "$1unsafe ")
    pieces = F.split(text, r"\bunsafe\{")
    return F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i == 0, piece).otherwise(
                F.concat(F.lit("unsafe{#"), block_pattern(piece), F.lit("#"), piece)
            ),
        ),
        "",
    )


# ---- the scan ---------------------------------------------------------------------------


def _candidates(rules: list[Rule]) -> str:
    """One pattern that finds the candidates of all rules."""
    alternatives = {}
    for rule in rules:
        guard = f"(?<![{rule.not_after}])" if rule.not_after else ""
        alternatives[f"{guard}(?:{rule.rx})"] = None
    found = "|".join(alternatives)
    if any(rule.starts is None for rule in rules):
        return found
    anywhere = "".join(dict.fromkeys(r.starts for r in rules if not r.not_after))
    after = dict.fromkeys(f"(?<![{r.not_after}])[{r.starts}]" for r in rules if r.not_after)
    positions = "|".join([*([f"[{anywhere}]"] if anywhere else []), *after])
    return f"(?={positions})(?:{found})"


def sites_in(text: Column, rules: list[Rule]) -> Column:
    """Array of ``struct(line, seq, rule_id)`` in text order; seq counts within the line."""
    candidates = F.lit(_candidates(rules))

    def rule_of(match: Column) -> Column:
        ladder = F.when(rules[0].takes(match), F.lit(rules[0].rule_id))
        for rule in rules[1:]:
            ladder = ladder.when(rule.takes(match), F.lit(rule.rule_id))
        return ladder

    def line_sites(line: Column, line_index: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(line, candidates, F.lit(0)),
            lambda match, i: F.struct(
                (line_index + 1).alias("line"), (i + 1).alias("seq"), rule_of(match).alias("rule_id")
            ),
        )

    found = F.flatten(F.transform(F.split(text, "\n"), line_sites))
    return F.filter(found, lambda site: site["rule_id"].isNotNull())


SITES = "array<struct<line: int, seq: int, rule_id: int>>"


def scan_code(files: DataFrame) -> DataFrame:
    """(crate, file, sites) of source files."""
    return files.select("crate", "file", code_sites(F.col("content"), CODE_RULES).alias("sites"))


def code_rejects(files: DataFrame) -> DataFrame:
    """Files the code scan leaves out, with the reason."""
    balanced = brackets_balance(blank_literals(F.col("content")))
    return rejected_files(files, F.when(~balanced, F.lit("unbalanced brackets")))


def scan_files(files: DataFrame, rules: list[Rule], text: Column | None = None) -> DataFrame:
    """(crate, file, sites) with all sites of a file in one array."""
    text = F.col("content") if text is None else text
    return files.select("crate", "file", sites_in(text, rules).alias("sites"))


def _rule_column(rules: list[Rule], attribute: str) -> Column:
    values = [(rule.rule_id, getattr(rule, attribute)) for rule in rules]
    ladder = F.when(F.col("rule_id") == values[0][0], F.lit(values[0][1]).cast("string"))
    for rule_id, value in values[1:]:
        ladder = ladder.when(F.col("rule_id") == rule_id, F.lit(value).cast("string"))
    return ladder


def site_rows(scanned: DataFrame, rules: list[Rule], *extra: str) -> DataFrame:
    """One row per site: (crate, file, pos, line, seq, rule_id, kind, pattern)."""
    return (
        explode_once(scanned, ["crate", "file", *extra], F.col("sites"), "pos", "site")
        .select("crate", "file", *extra, "pos", "site.*")
        .withColumn("kind", _rule_column(rules, "kind"))
        .withColumn("pattern", _rule_column(rules, "pattern"))
    )


def numbered_sites(scanned: DataFrame, rules: list[Rule]) -> DataFrame:
    """Sites with ``U0001``, ``U0002``, .. per crate in (file, line, text) order.

    A file may come in several rows, as a page fetched twice does: its sites are those of all of them
    in one order of lines, at one place of a line by rule. Ranges are cut between files only.
    """
    ranged = in_ranges(scanned, "crate", ["file"], F.size("sites"))
    nth = F.row_number().over(Window.partitionBy("_slot").orderBy("file", "line", "seq", "rule_id"))
    return (
        site_rows(ranged, rules, "_slot", "_start")
        .withColumn("site_id", F.format_string("U%04d", F.col("_start") + nth))
        .drop("_slot", "_start", "pos")
    )


def placed_sites(scanned: DataFrame, rules: list[Rule]) -> DataFrame:
    """Sites with ``_slot``, not numbered, out of the shuffle :func:`numbered_sites` reads."""
    return site_rows(placed_rows(scanned, "crate", ["file"]), rules, "_slot")


def rejected_files(files: DataFrame, reason: Column) -> DataFrame:
    """Files the scan leaves out, with the reason; ``reason`` is null for good files."""
    return files.select("crate", "file", reason.alias("reason")).filter("reason IS NOT NULL")
