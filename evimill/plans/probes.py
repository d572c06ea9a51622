"""Probes over whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimill.functions import text as T
from evimill.functions.json_place import json_error_place
from evimill.operators import probes as P
from evimill.operators.rows import explode_once
from evimill.plans.dialect import SPACE, literal, trim
from evimill.functions.vocabulary import WHITESPACE
from evimill.sources import views as V


def _documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def _events(spark, sf_dir):
    return V.table(spark, sf_dir, "events")


def _broken_json():
    """events.props, every fourth whole; the others cut, doubled or with a stray word."""
    return F.expr(
        """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN left(props, 4) WHEN 2 THEN concat(props, ' ', props)
        WHEN 3 THEN '' WHEN 4 THEN concat('[', props, ', null]') ELSE concat('x', props) END"""
    )


def probe_utf8(spark, sf_dir):
    """Document bytes, with an invalid byte added to every third."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode("text", "utf-8"), tail)
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"), P.utf8_ok(content).alias("valid")
    )


def probe_find(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        P.first_offset(text, "the").alias("first_at"),
        P.last_offset(text, "the").alias("last_at"),
        P.any_offset(text, "?!;").alias("any_at"),
        P.first_offset(text, "").alias("empty_at"),
    )


def probe_count(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", P.occurrences(text, "e").alias("n_e"), P.occurrences(text, "the").alias("n_the")
    )


def probe_tokens(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        P.line_count(text).alias("lines"),
        P.word_count(text).alias("words"),
        P.field_count(text).alias("fields"),
    )


def probe_trim(spark, sf_dir):
    """Every line of the documents, trimmed at both ends and at either."""
    lines = explode_once(_documents(spark, sf_dir), ["doc_id"], F.split("text", "\n"), "pos", "line")
    padded = F.concat(F.lit(" \t"), F.col("line"), F.lit("\u3000 "))
    return lines.select(
        "doc_id",
        "pos",
        T.trim_space(padded).alias("both"),
        F.length(T.trim_space_start(padded)).alias("start_length"),
        F.length(T.trim_space_end(padded)).alias("end_length"),
    )


def probe_graphemes(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", P.grapheme_count(F.col("text")).alias("graphemes"))


def probe_json(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", T.json_valid(_broken_json()).alias("valid"))


def probe_json_mutations(spark, sf_dir):
    variants = P.json_mutations(_events(spark, sf_dir), "event_id", "props")
    return variants.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(T.json_valid(F.col("candidate"))).alias("n_valid")
    )


def probe_json_error_place(spark, sf_dir):
    """Place of the first error of whole, half and extended texts, most of them broken already."""
    texts = _events(spark, sf_dir).select("event_id", _broken_json().alias("text"))
    places = P.json_mutations(texts, "event_id", "text").withColumn("place", json_error_place(F.col("candidate")))
    return places.select("event_id", "variant", "place.*")


def probe_json_fields(spark, sf_dir):
    text = _broken_json()
    return _events(spark, sf_dir).select(
        "event_id",
        F.get_json_object(F.when(T.json_valid(text), text), "$.k").try_cast("bigint").alias("k"),
        F.get_json_object(F.when(T.json_valid(text), text), "$.absent").alias("absent"),
    )


def probe_json_lines(spark, sf_dir):
    """Up to twelve values per event, one of them broken in most."""
    lines = F.transform(
        F.sequence(F.lit(1), (F.col("event_id") % 12 + 1).cast("int")),
        lambda i: F.when(i == F.col("event_id") % 7 + 2, F.lit('{"k":')).otherwise(F.col("props")),
    )
    return _events(spark, sf_dir).select(
        "event_id", P.leading_json_lines(F.array_join(lines, "\n")).alias("values")
    )


#: Markup that looks like other markup, put behind each page: by page_id % 4.
_TRICKY = [
    """<p a="<i>"><!-- <b> "x" --></p><script>if (a<c) { s = "<u>"; }</script>tail""",
    """<![CDATA[<z> & </z>]]><my-tag data-x='1 > 0'  y = "<!-- no -->" z/>text <!-- one --><!--> two <em>-->text""",
    """<STYLE media="a>b">q::after { content: "<!-- no -->" }</STYLE><?php echo "a > b" ?>""",
    """<script src="x.js"></script><style> </style><img alt='</p>'><!-- left open <b> <script> """,
]


def _pages(spark, sf_dir):
    behind = F.element_at(F.array(*map(F.lit, _TRICKY)), (F.col("page_id") % 4 + 1).cast("int"))
    return V.table(spark, sf_dir, "pages").withColumn("html", F.concat("html", behind))


def probe_markup_tags(spark, sf_dir):
    return P.tag_counts(_pages(spark, sf_dir), "html")


def probe_markup_attrs(spark, sf_dir):
    return P.attribute_counts(_pages(spark, sf_dir), "html")


def probe_markup_events(spark, sf_dir):
    return P.event_counts(_pages(spark, sf_dir), "page_id", "html")


def probe_prefix(spark, sf_dir):
    """Order fields put together so that every kind of prefix occurs."""
    source = F.expr(
        """CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN concat(repeat(' ', cast(o_orderkey % 5 AS int)), o_orderstatus)
        WHEN 2 THEN concat('[', o_orderpriority, '] ', o_orderstatus)
        ELSE concat('status:', o_orderstatus, chr(10), o_orderpriority) END"""
    )
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", source.alias("t"))
    return orders.select("o_orderkey", *[c.alias(n) for n, c in P.prefixes(F.col("t")).items()])


_MAGIC_CASES = ["7F454C46", "4D5A9000", "CFFAEDFE", "CAFEBABE", "213C617263683E0A", "565A", "00"]


def probe_magic(spark, sf_dir):
    """Documents as binaries, every one behind the leading bytes of some format."""
    lead = F.element_at(F.array(*[F.lit(h) for h in _MAGIC_CASES]), (F.col("doc_id") % 7 + 1).cast("int"))
    content = F.concat(F.unhex(lead), F.encode("text", "utf-8"))
    return _documents(spark, sf_dir).groupBy(P.binary_kind(content).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


def probe_verdicts(spark, sf_dir):
    """Verdicts of all probes, documents and events each read once."""
    documents = P.probe_texts(_documents(spark, sf_dir), "doc_id", F.col("text"))
    return documents.unionByName(
        P.probe_json_texts(_events(spark, sf_dir), "event_id", _broken_json())
    )


QUERIES = {
    "probe_utf8": probe_utf8,
    "probe_find": probe_find,
    "probe_count": probe_count,
    "probe_tokens": probe_tokens,
    "probe_trim": probe_trim,
    "probe_graphemes": probe_graphemes,
    "probe_json": probe_json,
    "probe_json_mutations": probe_json_mutations,
    "probe_json_error_place": probe_json_error_place,
    "probe_json_fields": probe_json_fields,
    "probe_json_lines": probe_json_lines,
    "probe_markup_tags": probe_markup_tags,
    "probe_markup_attrs": probe_markup_attrs,
    "probe_markup_events": probe_markup_events,
    "probe_prefix": probe_prefix,
    "probe_magic": probe_magic,
    "probe_verdicts": probe_verdicts,
    "probe_rollup": lambda spark, sf_dir: P.probe_rollup(probe_verdicts(spark, sf_dir)),
}

_BROKEN = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props[:4] WHEN 2 THEN concat(props, ' ', props)
  WHEN 3 THEN '' WHEN 4 THEN concat('[', props, ', null]') ELSE concat('x', props) END"""


def _first(needle: str) -> str:
    return f"CASE WHEN contains(text, '{needle}') THEN strlen(string_split(text, '{needle}')[1]) END"


def _last(needle: str) -> str:
    return (
        f"CASE WHEN contains(text, '{needle}') THEN strlen(text) - {len(needle)} "
        f"- strlen(list_last(string_split(text, '{needle}'))) END"
    )


def _lines(expr: str) -> str:
    return (
        f"len(string_split({expr}, chr(10))) - CASE WHEN {expr} = '' OR ends_with({expr}, chr(10)) THEN 1 ELSE 0 END"
    )


_SPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
_FIELDS = f"len(regexp_extract_all(text, '[^{_SPACE_CLASS}]+'))"


def _n_matches(column: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS BIGINT)"


_COMMENT = "<!--[\\s\\S]*?(-->|$)"
_RAW = '<(?:script|style|STYLE)(?:\\s[^<>"]*(?:"[^"]*"[^<>"]*)*)?>'
# Not one pass but one kind after the other: comments, character data, what scripts and styles hold,
# and quoted values give way to short marks; what is left is cut at every opening bracket.
_STRIPPED = f"""tricky AS (SELECT page_id, regexp_replace(concat(html, [{", ".join(map(literal, _TRICKY))}][page_id % 4 + 1]),
  '"<!--[^"<>]*-->"', '"x"', 'g') AS html FROM pages),
bare AS (SELECT page_id, regexp_replace(html, '{_COMMENT}', '<!>', 'g') AS h, {_n_matches('html', _COMMENT)} AS comments FROM tricky),
plain AS (SELECT page_id, comments, regexp_replace(h, '<!\\[CDATA\\[[\\s\\S]*?\\]\\]>', '<!>', 'g') AS h,
  {_n_matches('h', '<!.CDATA.')} AS cdata FROM bare),
emptied AS (SELECT page_id, comments, cdata, regexp_replace(h, '({_RAW})[\\s\\S]*?(</(?:script|style|STYLE)>)', '\\1\\2', 'g') AS h,
  {_n_matches('h', _RAW + '[ \\t\\r\\n]*[^< \\t\\r\\n]')} AS raw_texts FROM plain),
flat AS (SELECT page_id, comments, cdata, raw_texts,
  regexp_replace(regexp_replace(h, '=\\s*"[^"]*"|=\\s*''[^'']*''', '=""', 'g'), 'echo "[^"]*"', 'echo', 'g') AS h FROM emptied)"""
_PIECES = f"""{_STRIPPED},
pieces AS (SELECT piece, regexp_extract(piece, '^[A-Za-z_:][A-Za-z0-9_:.-]*') AS tag
  FROM (SELECT unnest(string_split(h, '<')[2:]) AS piece FROM flat))"""

_VERDICTS = f"""verdicts AS (
  SELECT doc_id AS item_id, 'find' AS probe, CASE WHEN contains(text, 'the') THEN 'ok' ELSE 'error' END AS verdict,
    CAST(coalesce({_first('the')}, 0) AS BIGINT) AS n FROM documents
  UNION ALL SELECT doc_id, 'count', 'ok', len(string_split(text, 'the')) - 1 FROM documents
  UNION ALL SELECT doc_id, 'fields', CASE WHEN {_FIELDS} > 0 THEN 'ok' ELSE 'error' END, {_FIELDS} FROM documents
  UNION ALL SELECT doc_id, 'lines', 'ok', {_lines('text')} FROM documents
  UNION ALL SELECT doc_id, 'json', CASE WHEN NOT starts_with(text, '{{') THEN 'skipped'
    WHEN json_valid(text) THEN 'ok' ELSE 'error' END, length(text) FROM documents
  UNION ALL SELECT event_id, 'json_whole', CASE WHEN c = '' THEN 'skipped' WHEN json_valid(c) THEN 'ok' ELSE 'error' END, length(c)
    FROM (SELECT event_id, {_BROKEN} AS c FROM events)
  UNION ALL SELECT event_id, 'json_field', CASE WHEN NOT json_valid(c) THEN 'skipped'
    WHEN json_extract_string(CASE WHEN json_valid(c) THEN c ELSE 'null' END, '$.k') IS NOT NULL THEN 'ok' ELSE 'error' END, length(c)
    FROM (SELECT event_id, {_BROKEN} AS c FROM events))"""

_PREFIX_SOURCE = """CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority
  WHEN 1 THEN concat(repeat(' ', CAST(o_orderkey % 5 AS INTEGER)), o_orderstatus)
  WHEN 2 THEN concat('[', o_orderpriority, '] ', o_orderstatus)
  ELSE concat('status:', o_orderstatus, chr(10), o_orderpriority) END"""

# A pushdown automaton over single signs. States: v value, a value or end of array, o key or end of object,
# k key, c colon, n after a value, q and Q inside a string or key (then b: escape, 1-4: digits to come),
# l and the rest of a word, and m z d . f e + x inside numbers. ``open`` holds the open brackets.
_PLACES = f"""texts AS (SELECT event_id, {_BROKEN} AS t FROM events),
variants AS (SELECT event_id, 'whole' AS variant, t AS c FROM texts
  UNION ALL SELECT event_id, 'half', t[:length(t) // 2] FROM texts
  UNION ALL SELECT event_id, 'trailing', concat(t, chr(10), '{{') FROM texts),
run AS (
  SELECT DISTINCT c, 0 AS i, 'v' AS s, '' AS open FROM variants
  UNION ALL
  SELECT c, i + 1, CASE
    WHEN s[1] IN ('q', 'Q') THEN CASE
      WHEN s[2] = '' THEN CASE WHEN ch = '"' THEN CASE s WHEN 'q' THEN 'n' ELSE 'c' END WHEN ch = chr(92) THEN s || 'b'
        WHEN unicode(ch) < 32 THEN 'bad' ELSE s END
      WHEN s[2] = 'b' THEN CASE WHEN contains('"/bfnrt', ch) OR ch = chr(92) THEN s[1] WHEN ch = 'u' THEN s[1] || '4' ELSE 'bad' END
      WHEN NOT contains('0123456789abcdefABCDEF', ch) THEN 'bad'
      WHEN s[2] = '1' THEN s[1] ELSE s[1] || (CAST(s[2] AS INTEGER) - 1) END
    WHEN s[1] = 'l' THEN CASE WHEN ch <> s[2] THEN 'bad' WHEN length(s) = 2 THEN 'n' ELSE 'l' || s[3:] END
    WHEN s IN ('m', 'z', 'd', '.', 'f', 'e', '+', 'x') THEN CASE
      WHEN ch = '0' AND s = 'm' THEN 'z' WHEN digit AND s IN ('m', 'd') THEN 'd' WHEN digit AND s IN ('.', 'f') THEN 'f'
      WHEN digit AND s IN ('e', '+', 'x') THEN 'x' WHEN ch = '.' AND s IN ('z', 'd') THEN '.'
      WHEN ch IN ('e', 'E') AND s IN ('z', 'd', 'f') THEN 'e' WHEN ch IN ('+', '-') AND s = 'e' THEN '+' ELSE 'bad' END
    WHEN ch IN (' ', chr(9), chr(10), chr(13)) THEN s
    WHEN s IN ('v', 'a') THEN CASE WHEN ch = '"' THEN 'q' WHEN ch = '{{' THEN 'o' WHEN ch = '[' THEN 'a' WHEN ch = '-' THEN 'm'
      WHEN ch = '0' THEN 'z' WHEN digit THEN 'd' WHEN ch = 't' THEN 'lrue' WHEN ch = 'f' THEN 'lalse' WHEN ch = 'n' THEN 'lull'
      WHEN ch = ']' AND s = 'a' THEN 'n' ELSE 'bad' END
    WHEN s IN ('o', 'k') THEN CASE WHEN ch = '"' THEN 'Q' WHEN ch = '}}' AND s = 'o' THEN 'n' ELSE 'bad' END
    WHEN s = 'c' THEN CASE WHEN ch = ':' THEN 'v' ELSE 'bad' END
    WHEN ch = ',' THEN CASE open[-1] WHEN '{{' THEN 'k' WHEN '[' THEN 'v' ELSE 'bad' END
    WHEN ch = '}}' AND open[-1] = '{{' OR ch = ']' AND open[-1] = '[' THEN 'n' ELSE 'bad' END,
    CASE WHEN s[1] IN ('q', 'Q') THEN open WHEN ch IN ('{{', '[') THEN open || ch WHEN ch IN ('}}', ']') THEN open[:-2] ELSE open END
  FROM (SELECT c, i, ch, open, contains('0123456789', ch) AS digit,
      -- a number ends where the next sign does not go on with it
      CASE WHEN s IN ('z', 'd', 'f', 'x') AND NOT (contains('0123456789', ch) AND s <> 'z' OR ch = '.' AND s IN ('z', 'd')
        OR ch IN ('e', 'E') AND s <> 'x') THEN 'n' ELSE s END AS s
    FROM (SELECT *, substr(c, i + 1, 1) AS ch FROM run WHERE s <> 'bad' AND i < length(c)))),
ends AS (SELECT c, max(i) AS i, arg_max(s, i) AS s, arg_max(open, i) AS open FROM run GROUP BY c),
places AS (SELECT *, s IN ('n', 'z', 'd', 'f', 'x') AND open = '' AS valid, c[:i] AS taken FROM ends)"""

ORACLES = {
    "probe_utf8": "SELECT doc_id AS item_id, doc_id % 3 <> 0 AS valid FROM documents",
    "probe_find": f"""SELECT doc_id, CAST({_first('the')} AS INTEGER) AS first_at, CAST({_last('the')} AS INTEGER) AS last_at,
  CAST(CASE WHEN regexp_matches(text, '[?!;]') THEN strlen(regexp_extract(text, '^[^?!;]*')) END AS INTEGER) AS any_at,
  CAST(0 AS INTEGER) AS empty_at FROM documents""",
    "probe_count": """SELECT doc_id, len(string_split(text, 'e')) - 1 AS n_e, len(string_split(text, 'the')) - 1 AS n_the
FROM documents""",
    "probe_tokens": f"""SELECT doc_id, CAST({_lines('text')} AS INTEGER) AS lines,
  CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS INTEGER) AS words, CAST({_FIELDS} AS INTEGER) AS fields
FROM documents""",
    "probe_trim": f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
padded AS (SELECT doc_id, pos, concat(' ', chr(9), line, chr(12288), ' ') AS p FROM lines)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, {trim('p')} AS "both", CAST(length(ltrim(p, {SPACE})) AS INTEGER) AS start_length,
  CAST(length(rtrim(p, {SPACE})) AS INTEGER) AS end_length FROM padded""",
    "probe_graphemes": "SELECT doc_id, CAST(length_grapheme(text) AS INTEGER) AS graphemes FROM documents",
    "probe_json": f"SELECT event_id, json_valid({_BROKEN}) AS valid FROM events",
    "probe_json_mutations": """WITH variants AS (
  SELECT 'whole' AS variant, props AS c FROM events
  UNION ALL SELECT 'half', props[:length(props) // 2] FROM events
  UNION ALL SELECT 'trailing', concat(props, chr(10), '{') FROM events)
SELECT variant, count(*) AS n, count(*) FILTER (json_valid(c)) AS n_valid FROM variants GROUP BY variant""",
    "probe_json_error_place": f"""WITH RECURSIVE {_PLACES}
SELECT event_id, variant, valid, CASE WHEN NOT valid THEN CAST(length(taken) - length(replace(taken, chr(10), '')) + 1 AS INTEGER) END AS line_no,
  CASE WHEN valid THEN NULL WHEN s = 'bad' AND taken[-1] = chr(10) THEN 0
    ELSE CAST(strlen(string_split(CASE s WHEN 'bad' THEN taken[:-2] ELSE taken END, chr(10))[-1]) + CAST(s = 'bad' AS INTEGER) AS INTEGER) END AS column_no
FROM variants JOIN places USING (c)""",
    "probe_json_fields": f"""WITH b AS (SELECT event_id, CASE WHEN json_valid({_BROKEN}) THEN {_BROKEN} ELSE 'null' END AS c FROM events)
SELECT event_id, TRY_CAST(json_extract_string(c, '$.k') AS BIGINT) AS k, json_extract_string(c, '$.absent') AS absent FROM b""",
    "probe_json_lines": """SELECT event_id,
  CAST(least(event_id % 12 + 1, event_id % 7 + 1) AS BIGINT) AS values FROM events""",
    "probe_markup_tags": f"""WITH {_PIECES}
SELECT tag, count(*) AS n FROM pieces WHERE tag <> '' GROUP BY tag""",
    "probe_markup_attrs": f"""WITH {_PIECES},
insides AS (SELECT split_part(substr(piece, length(tag) + 1), '>', 1) AS inside FROM pieces WHERE tag <> '' AND contains(piece, '>')),
names AS (SELECT unnest(string_split_regex(
  regexp_replace(inside, '\\s*=\\s*(""|[^\\s"<>=]+)', ' ', 'g'), '[\\s/]+')) AS attribute FROM insides)
SELECT attribute, count(*) AS n FROM names WHERE attribute <> '' GROUP BY attribute""",
    "probe_markup_events": f"""WITH {_STRIPPED}
SELECT page_id, {_n_matches('h', '<[A-Za-z]')} AS start_tags, {_n_matches('h', '</[A-Za-z]')} AS end_tags, comments, cdata,
  {_n_matches('h', '<![A-Za-z]|<[?][A-Za-z]')} AS declarations, {_n_matches('h', '>[ \\t\\r\\n]*[^<> \\t\\r\\n]')} AS texts, raw_texts FROM flat""",
    "probe_prefix": f"""WITH s AS (SELECT o_orderkey, {_PREFIX_SOURCE} AS t FROM orders)
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(t, '^[0-9]+'), '') AS BIGINT) AS leading_int,
  CAST(length(t) - length(ltrim(t, concat(' ', chr(9), chr(13), chr(10)))) AS INTEGER) AS leading_space,
  split_part(t, '-', 1) AS until_dash,
  CASE WHEN regexp_matches(t, '^\\[[^\\]]*\\]') THEN regexp_extract(t, '^\\[([^\\]]*)\\]', 1) END AS bracketed,
  CASE WHEN o_orderkey % 4 = 3 THEN 'status' END AS pair_key,
  CASE WHEN o_orderkey % 4 = 3 THEN split_part(split_part(t, chr(10), 1), ':', 2) END AS pair_value FROM s""",
    "probe_magic": """SELECT ['elf', 'pe', 'mach', 'mach', 'archive', 'te', 'unknown'][doc_id % 7 + 1] AS kind, count(*) AS n
FROM documents GROUP BY kind""",
    "probe_verdicts": f"WITH {_VERDICTS} SELECT item_id, probe, verdict, CAST(n AS BIGINT) AS n FROM verdicts",
    "probe_rollup": f"""WITH {_VERDICTS}
SELECT probe, CASE WHEN count(*) FILTER (verdict = 'error') > 0 THEN 'error'
    WHEN count(*) FILTER (verdict = 'ok') > 0 THEN 'ok' ELSE 'skipped' END AS status,
  count(*) FILTER (verdict = 'skipped') AS n_skipped, count(*) FILTER (verdict = 'ok') AS n_ok,
  count(*) FILTER (verdict = 'error') AS n_error, CAST(sum(n) AS BIGINT) AS total FROM verdicts GROUP BY probe""",
}
