"""Near copies of files by SimHash and anchor points.

Two files are linked if their 64-bit fingerprints differ in three bits or fewer. Of two such
fingerprints the upper or the lower half differs in one bit at most. Each half is looked up in a
covering code: the first 31 bits of the half go to the [31,26] Hamming code, whose words lie within
one bit (the covering radius) of every value. A fingerprint is at home at its nearest code word, the
anchor, and is a guest at every anchor within covering radius plus threshold, two bits: a guest in
reach of one bit of a fingerprint is then present at that one's home. So fingerprints meet at
anchors only, at most 16 rows for either half, and no anchor sees more than its surroundings.

Equal fingerprints are one class from the start. At an anchor only links that join two groups are
kept, so a crowd of near copies yields as many links as members and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.components import components
from evimill.llm.storage import kept, shuffled
from evimill.llm.texts import per_text

SEED = 42
SHINGLE = 3
MAX_BITS = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number; 0 without words.

    A-Z are lower-cased; words end at ASCII white space; shorter texts are one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        bits = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return bits - (1 << 64) if bits >> 63 else bits
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashed = b"".join([digest(joined[a:b], SEED) for (a, b), _ in zip(spans, range(min(BLOCK, n - at)))])
        counts += np.unpackbits(np.frombuffer(hashed, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(content: Column) -> Column:
    """A bigint per text; null counts as empty."""
    return per_text(fingerprint, "bigint", content)


# Code words are the 31-bit numbers whose syndrome, the exclusive or of the places (1 to 31) of
# their set bits, is zero.
_SYNDROME = np.zeros((4, 256), dtype=np.uint8)
for _byte in range(4):
    for _value in range(256):
        for _bit in range(8):
            if _value >> _bit & 1 and 8 * _byte + _bit < 31:
                _SYNDROME[_byte, _value] ^= 8 * _byte + _bit + 1
#: For each syndrome, the bits to flip to reach the code words within one and two bits.
_REACH = [
    [0] if s == 0 else [1 << (s - 1)] + [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if a < a ^ s]
    for s in range(32)
]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of 32-bit halves: their code words within covering radius plus one bit."""
    value = half.astype(np.uint32) & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros(len(value), dtype=np.uint8)
    for byte in range(4):
        syndrome ^= _SYNDROME[byte, value >> np.uint32(8 * byte) & np.uint32(255)]
    rows, found, home = [], [], []
    for s, flips in enumerate(_REACH):
        at = np.nonzero(syndrome == s)[0]
        if len(at):
            rows.append(np.repeat(at, len(flips)))
            found.append((value[at][:, None] ^ np.array(flips, dtype=np.uint32)).ravel())
            home.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    if not rows:
        return np.zeros(0, int), np.zeros(0, np.uint32), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for half in (0, 1):
            part = (values.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows, found, home = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.astype(np.int64) * 2 + half),
                    pa.array(home),
                    pa.array(values[rows]),
                ],
                names=["anchor", "home", "fp"],
            )


def forest(home: np.ndarray, guests: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links from ``home`` to ``guests`` or home within ``max_bits``, less those that join nothing new."""
    everyone = np.unique(np.concatenate([home, guests]))
    bits, group = everyone.view(np.uint64), np.arange(len(everyone))
    a, b = [], []
    for place in np.searchsorted(everyone, np.unique(home)).tolist():
        near = np.nonzero(np.bitwise_count(bits ^ bits[place]) <= max_bits)[0]
        joined, first = np.unique(group[near], return_index=True)
        if len(joined) == 1:
            continue
        mine = group[place]
        others = near[first[joined != mine]]
        a += [int(everyone[place])] * len(others)
        b += everyone[others].tolist()
        renamed = np.arange(len(everyone))
        renamed[joined] = mine
        group = renamed[group]
    return a, b


#: Pairs of an anchor up to which all are compared at once with those of other anchors.
FEW = 1024


def compared(keys: np.ndarray, home: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``keys``; the rows of a run are complete."""
    starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    pairs = homes * sizes
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    run = np.repeat(np.arange(len(starts)), sizes)
    small = np.nonzero(home & (pairs <= FEW)[run])[0]
    reach = sizes[run[small]]
    left = np.repeat(small, reach)
    offset = np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)
    right = starts[run[left]] + offset
    near = np.bitwise_count(fp[left].view(np.uint64) ^ fp[right].view(np.uint64)) <= max_bits
    near &= fp[left] != fp[right]
    found_a.append(fp[left[near]])
    found_b.append(fp[right[near]])
    for k in np.nonzero(pairs > FEW)[0].tolist():
        rows = slice(starts[k], starts[k] + sizes[k])
        a, b = forest(fp[rows][home[rows]], fp[rows], max_bits)
        found_a.append(np.array(a, dtype=np.int64))
        found_b.append(np.array(b, dtype=np.int64))
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(max_bits: int):
    """Links of rows sorted by anchor and part; only the visitors of one anchor and part are held."""

    def emitted(pieces: list[tuple]) -> pa.RecordBatch:
        keys, home, fp = (np.concatenate(x) for x in zip(*pieces, strict=True))
        a, b = compared(keys, home, fp, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, home, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            home = home.astype(bool)
            if keys[0] == keys[-1] and waiting and waiting[-1][0][-1] == keys[0]:
                waiting.append((keys, home, fp))
                continue
            cut = int(np.nonzero(keys != keys[-1])[0][-1]) + 1 if keys[0] != keys[-1] else 0
            if cut or waiting and waiting[-1][0][-1] != keys[0]:
                done = [*waiting, (keys[:cut], home[:cut], fp[:cut])]
                yield emitted(done)
                waiting = []
            waiting.append((keys[cut:], home[cut:], fp[cut:]))
        if waiting:
            yield emitted(waiting)

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS, crowd: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``max_bits`` of each other.

    Where more than ``crowd`` fingerprints are at home at one anchor they are split into parts, and
    each part meets all visitors of the anchor on its own.
    """
    if max_bits > 3:
        raise ValueError("halves within one bit cover three differing bits at most")
    visits = classes.select("fp").mapInArrow(_visits, "anchor bigint, home boolean, fp bigint")
    # where nobody is at home there is nothing to compare; guests, fifteen times as many, need no count
    met = (
        visits.where("home")
        .groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .select("anchor", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
        .repartition(F.xxhash64("anchor"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        visits.join(shuffled(met), "anchor")
        .select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "home", own.alias("own"), "fp")
        .select(
            (F.shiftleft("anchor", 31) + F.col("part")).alias("place"),  # 32 bits of anchor, 31 of part
            (F.col("home") & (F.col("part") == F.col("own"))).alias("home"),
            "fp",
        )
    )
    dealt = placed.repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(_compare(max_bits), "a bigint, b bigint").distinct()


def near_copies(files: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """file_id, fingerprint (16 hex digits), component_id: the smallest file_id linked directly or through others.

    ``files``: file_id bigint, content string; other columns are not read. One row per row. Null,
    empty and blank texts have fingerprint zero and are linked like any other. Rows without file_id
    take part; a component of nothing else has a null component_id.
    """
    marked = kept(files.select("file_id", fingerprints(F.col("content")).alias("fp")))
    classes = kept(marked.groupBy("fp").agg(F.min("file_id").alias("first")))
    roots = kept(
        classes.join(shuffled(components(links(classes, max_bits))), F.col("fp") == F.col("node"), "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id")).repartition(F.xxhash64("root"))
    named = kept(roots.join(shuffled(lowest), "root").select("fp", "component_id"))
    return marked.join(shuffled(named), "fp").select(
        "file_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
