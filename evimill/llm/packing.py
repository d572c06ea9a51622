"""Files packed into token sequences by vector best-fit.

Each sequence has three capacities: tokens, documents, and attention cost (the sum of the squared
lengths of its pieces). Pieces come by decreasing length; each goes to the open sequence in which
it fits by every capacity and that it leaves tightest, by the weighted norm of what would remain or
by the weighted dot product of remainder and demand. Pieces are dealt by hash into shards of a few
thousand sequences that are packed alone.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.storage import kept
from evimill.llm.texts import per_text
from evimill.llm.tokens import token_ids


def pieces(ids: np.ndarray, length: int) -> list[dict]:
    """Cuts of a document: whole if it fits, else a shorter first piece and full ones."""
    first = len(ids) % length or length
    cuts = [0, *range(first, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
    return [
        {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].astype("<u4").tobytes())}
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]


def cut_files(content: Column, vocabulary: str, length: int, end_id: int) -> Column:
    """array of pieces of each text's ids, ``end_id`` appended; a null text is the end alone."""

    def cut(text: str) -> list[dict]:
        return pieces(np.append(token_ids(vocabulary, text), np.uint32(end_id)), length)

    return per_text(cut, "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>", content)


def best_fit(
    lengths: np.ndarray,
    tokens: int,
    documents: int,
    attention: int,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    capacity = np.array([tokens, documents, attention], dtype=float)
    scale = np.array(weights) / capacity**2
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left = np.zeros((1024, 3))
    name = np.zeros(1024, dtype=np.int64)
    n = opened = 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        demand = np.array([lengths[at], 1.0, float(lengths[at]) ** 2])
        if (demand > capacity).any():
            raise ValueError("a piece is larger than a whole sequence")
        rest = left[:n] - demand
        fits = np.nonzero((rest >= 0).all(axis=1))[0]
        if len(fits):
            score = (rest[fits] ** 2) @ scale if rule == "norm" else left[:n][fits] @ (demand * scale)
            best = fits[np.argmin(score)]
        else:
            if n == len(left):
                left, name = np.concatenate([left, np.zeros_like(left)]), np.concatenate([name, np.zeros_like(name)])
            best, left[n], name[n] = n, capacity, opened
            n, opened = n + 1, opened + 1
        sequence[at], offset[at] = name[best], tokens - int(left[best, 0])
        left[best] -= demand
        if left[best, :2].min() < 1:  # nothing fits any more
            n -= 1
            left[best], name[best] = left[n], name[n]
    return sequence, offset


def pack_files(
    files: DataFrame,
    vocabulary: str,
    length: int = 2048,
    documents: int | None = None,
    attention: int | None = None,
    end_id: int = 0,
    rule: str = "norm",
    shard_tokens: int = 1 << 23,
    shard_rows: int = 1 << 16,
) -> DataFrame:
    """One row per piece: file_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``files``: file_id, content; other columns are not read. Sequences hold at most ``length``
    tokens, ``documents`` pieces (by default as many as tokens) and ``attention``, the sum of the
    squares of their lengths (by default that of one full piece, which tokens alone never exceed: pass
    less to bound it).
    Only files longer than a sequence are cut. Null and empty texts are one end token; repeated
    rows are packed each.
    """
    cut = files.select(
        F.monotonically_increasing_id().alias("row"), "file_id",
        F.explode(cut_files(F.col("content"), vocabulary, length, end_id)).alias("x"),
    )
    cut = kept(cut.select("row", "file_id", "x.*"))
    short = cut.where(F.col("length") < length)
    total = short.agg(F.sum("length").alias("tokens"), F.count("*").alias("rows")).first()
    shards = max(1, math.ceil((total["tokens"] or 0) / shard_tokens), math.ceil(total["rows"] / shard_rows))
    capacity, pieces = attention or length * length, documents or length

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(table.column("length").to_numpy(), length, pieces, capacity, rule=rule)
        shard = table.column("shard").to_numpy()
        return table.drop_columns(["row", "shard"]).append_column("sequence_id", [shard << 32 | sequence]).append_column(
            "offset", [offset]
        )

    columns = "file_id, piece, start, length, ids_crc32".split(", ")
    dealt = short.select(
        "row", *columns, F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard")
    )
    kind = dict(files.dtypes)["file_id"]
    schema = f"file_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    full = cut.where(F.col("length") >= length).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return dealt.groupBy("shard").applyInArrow(packed, schema).unionByName(full)
