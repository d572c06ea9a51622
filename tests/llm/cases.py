"""Small tables with what real ones hold at their edges."""

from __future__ import annotations

#: Columns that operators use for their own results; a table may bring them along.
CLASHING = "score string, row string, found string, size string, labels string, copies string, counts string, v string"


def files(spark, rows):
    """(file_id, crate, content) as files, with clashing extra columns."""
    schema = f"file_id bigint, crate string, cohort string, content string, {CLASHING}"
    extra = tuple("x" for _ in CLASHING.split(","))
    return spark.createDataFrame([(i, c, c, t, *extra) for i, c, t in rows], schema)


def documents(spark, rows):
    """(doc_id, text, lang, source) as documents, with clashing extra columns."""
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, crate string, content string, file_id string, doc string, {CLASHING}"
    extra = tuple("x" for _ in range(schema.count(",") - 4))
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], schema)


LONG = "The quick brown fox jumps over the lazy dog. " * 30_000
EDGES = [
    (1, "a", "one two three four five six seven"),
    (2, "a", "one two three four five six seven"),  # an exact copy
    (3, "b", None),
    (4, "b", ""),
    (5, None, " \n\t "),
    (6, "c", LONG),
    (None, "c", "a file without id"),
    (7, "c", "é漢字 \U0001f600 naïve"),
    (7, "c", "é漢字 \U0001f600 naïve"),  # a repeated row
]
