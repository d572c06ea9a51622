"""Whole texts as they arrive in Arrow batches, and Arrow functions over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


def texts(column: pa.Array) -> Iterator[str]:
    """One Python text at a time, so that a batch is never held twice; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def per_text(compute: Callable[[str], Any], returns: str, content: Column) -> Column:
    """``compute`` on each whole text. Not declared deterministic, so that no plan computes it twice."""
    kind: DataType = _parse_datatype_string(returns)

    @F.arrow_udf(returnType=kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([compute(text) for text in texts(column)], type=to_arrow_type(kind))

    return run.asNondeterministic()(content)
