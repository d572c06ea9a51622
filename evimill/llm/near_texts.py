"""Near copies of texts by exact Jaccard similarity of their word shingles.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. Candidates agree in all four minimum hashes of one of 24 bands, which two texts at 0.8 miss
with a chance of 3 in a million and more similar ones less often. Within a bucket candidates are
sifted by parity sketches: each shingle flips one bit, so two sketches differ in no more bits than the
sets have shingles apart, and a pair that differs in too many cannot be similar. What is left is
compared on the whole sets.

No bucket gives all its pairs. Buckets with the same members are one. A large bucket is dealt into
blocks that meet two by two; first each block on its own gives the links that connect all its
candidates, then all blocks those between different groups, and at last every candidate pair whose
texts are still apart. Sketches are as sharp as the sets are large, so those last pairs lie just below
the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm import simhash, stars
from evimill.llm.simhash import LOWER
from evimill.llm.storage import kept, shuffled
from evimill.llm.texts import per_text

SEED = 42
SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 4
_DRAW = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_OFFSETS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]
#: Shingles that are hashed into the minima at a time.
BLOCK = 1 << 12
#: Texts in a block of a bucket, about, and texts of a tile that are sifted at a time.
CROWD, STRIP = 2048, 64
#: Partners compared with one text in a row of tasks.
PARTNERS = 256


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words as in ``simhash.fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes; none for the empty set."""
    if not len(hashes):
        return []
    lowest = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        lowest = np.minimum(lowest, (hashes[None, at : at + BLOCK] * _FACTORS + _OFFSETS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(lowest[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _marked(text: str) -> dict:
    hashes = shingles(text)
    return {
        "shingles": hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(),
        "bands": bands(hashes),
    }


def _set(text: str) -> dict:
    hashes = shingles(text)
    return {"n": len(hashes), "bits": sketch(hashes), "hashes": hashes.tobytes()}


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each bit; over four bits for each shingle, 256 at least."""
    width = max(256, 1 << (4 * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches as they are at a smaller number of 64-bit words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def reaches(apart: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` shingles together, at least ``apart`` not in common, can be similar."""
    return LEAST[1] * (total - apart) >= LEAST[0] * (total + apart)


def sifted(n: np.ndarray, bits: list[bytes], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """(rows, columns): pairs that sizes and sketches leave."""
    near = np.zeros((len(rows), len(columns)), dtype=bool)
    words = np.array([len(b) // 8 for b in bits])
    for left in np.unique(words[rows]).tolist():
        i = np.nonzero(words[rows] == left)[0]
        x = np.frombuffer(b"".join(bits[k] for k in rows[i].tolist()), dtype=np.uint64).reshape(len(i), left)
        for right in np.unique(words[columns]).tolist():
            if not left <= 2 * right <= 4 * left:
                continue
            j = np.nonzero(words[columns] == right)[0]
            y = np.frombuffer(b"".join(bits[k] for k in columns[j].tolist()), dtype=np.uint64).reshape(len(j), right)
            width = min(left, right)
            fx, fy = folded(x, width), folded(y, width)
            apart = np.abs(n[rows[i]][:, None] - n[columns[j]][None, :])
            found = np.zeros(apart.shape, dtype=np.int64)
            for k in range(width):
                found += np.bitwise_count(fx[:, k, None] ^ fy[None, :, k])
            total = n[rows[i]][:, None] + n[columns[j]][None, :]
            near[np.ix_(i, j)] = reaches(np.maximum(apart, found), total)
    return near


def candidates(ids: np.ndarray, n: np.ndarray, roots: np.ndarray, bits: list[bytes], lows: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of a tile with different roots that may be similar: all, or enough to connect them.

    The first ``lows`` rows are one block and the rest the other, both in an order that is the same in
    all buckets, so that buckets with like members name the same pairs: the earlier row is named last.
    """
    columns = np.arange(len(ids)) if lows == len(ids) else np.arange(lows, len(ids))
    group, found = roots.copy(), []
    for at in range(0, lows, STRIP):
        rows = np.arange(at, min(at + STRIP, lows))
        near = sifted(n, bits, rows, columns) & (roots[rows][:, None] != roots[columns][None, :])
        if lows == len(ids):
            near &= rows[:, None] < columns[None, :]
        for i in np.nonzero(near.any(axis=1))[0].tolist():
            others = columns[np.nonzero(near[i])[0]]
            if every:
                found += [(int(ids[k]), int(ids[rows[i]])) for k in others]
                continue
            joined, first = np.unique(group[others], return_index=True)
            new = joined != group[rows[i]]
            if new.any():
                found += [(int(ids[k]), int(ids[rows[i]])) for k in others[first[new]]]
                group[np.isin(group, joined[new])] = group[rows[i]]
    return found


def _tiles(every: bool):
    """Candidates of rows sorted by place (key and blocks), upper block last; only the rows of one place are held."""

    def emitted(rows: list[tuple]) -> list[tuple[int, int]]:
        _, _, _, upper, ids, n, roots, bits = zip(*rows, strict=True)
        numbers = (np.array(x, dtype=np.int64) for x in (ids, n, roots))
        return candidates(*numbers, list(bits), len(upper) - sum(upper), every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if waiting and waiting[-1][:3] != row[:3]:
                    if len(waiting) > 1:
                        found += emitted(waiting)
                    waiting = []
                waiting.append(row)
            yield _pairs(found)
        if len(waiting) > 1:
            yield _pairs(emitted(waiting))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with similar sets, of rows (b, a, hashes) sorted so that the row of b without a comes first."""
    mine = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        found = []
        for b, a, hashes in zip(*(batch.column(k) for k in range(3)), strict=True):
            values = np.frombuffer(hashes.as_py(), dtype=np.uint64)
            if not a.is_valid:
                mine = values
            elif similar(mine, values):
                found.append((a.as_py(), b.as_py()))
        yield _pairs(found)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar; a set goes out once for ``PARTNERS`` others."""
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")).repartition(F.xxhash64("b"))
    mine = (
        sets.select(F.col("id").alias("b"), "hashes")
        .join(shuffled(counts), "b")
        .select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("a"), "hashes")
    )
    theirs = (
        pairs.join(shuffled(counts), "b")
        .select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
        .join(shuffled(sets.select(F.col("id").alias("a"), "hashes")), "a")
        .select("b", "part", "a", "hashes")
    )
    dealt = mine.unionByName(theirs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return dealt.select("b", "a", "hashes").mapInArrow(_compared, "a bigint, b bigint")


def links(buckets: DataFrame, sets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): similar pairs that connect all similar ones which share a bucket.

    ``buckets``: key, id; ``sets``: id, n, bits, hashes.
    """
    same = buckets.groupBy("key").agg(
        F.count("*").alias("c"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.pmod("id", F.lit(1 << 30))).alias("y")
    )
    one = same.groupBy("c", "least", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / crowd).cast("int").alias("blocks"))
    rooted = kept(buckets.join(shuffled(one.repartition(F.xxhash64("key"))), "key").withColumn("root", F.col("id")))
    found = None
    slim = sets.select("id", "n", "bits")
    for turn, (across, every) in enumerate(((False, False), (True, False), (True, True))):
        if found is not None:
            roots = stars.roots(found)
            rooted = rooted.drop("root").join(shuffled(roots), F.col("id") == F.col("node"), "left").select(
                "key", "id", "blocks", F.coalesce("root", "id").alias("root")
            )
            apart = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
            rooted = kept(rooted.join(shuffled(apart.repartition(F.xxhash64("key"))), "key"))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        others = F.sequence(F.lit(0), F.col("blocks") - 1) if across else F.array(own)
        dealt = rooted.withColumn("own", own).withColumn("other", F.explode(others))
        placed = (
            dealt.join(shuffled(slim), "id")
            .select(
                "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                (F.col("own") > F.col("other")).alias("upper"), "id", "n", "root", "bits",
            )
            .repartition("key", "low", "high")
            .sortWithinPartitions("key", "low", "high", "upper", F.xxhash64("id", F.lit(turn)), "id")
        )
        pairs = placed.mapInArrow(_tiles(every), "a bigint, b bigint").distinct()
        pairs = kept(pairs)
        tasks = -(-pairs.count() // stars.FEW) or 1
        more = confirmed(pairs.coalesce(tasks), sets).coalesce(tasks)
        found = kept(more if found is None else found.unionByName(more))
    return found


def digest(content: Column) -> Column:
    """What tells texts apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def fingerprint_links(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): ids of classes whose fingerprints are equal or within three bits, enough to connect them all.

    ``marked``: shingles, fp; ``classes``: shingles, id. Texts of one class may have several fingerprints.
    """
    of = kept(
        marked.select("shingles", "fp").distinct()
        .join(shuffled(classes.select("shingles", "id").repartition(F.xxhash64("shingles"))), "shingles")
        .select("id", "fp")
    )
    first = kept(of.groupBy("fp").agg(F.min("id").alias("first")))
    lowest = [first.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")).repartition(F.xxhash64(end)) for end in ("fp", "a", "b")]
    equal = of.join(shuffled(lowest[0]), "fp").where("id <> first_fp").select(F.col("id").alias("a"), F.col("first_fp").alias("b"))
    near = simhash.links(first).join(shuffled(lowest[1]), "a").join(shuffled(lowest[2]), "b").where("first_a <> first_b")
    return equal.unionByName(near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def near_texts(files: DataFrame, fingerprints: bool = False) -> DataFrame:
    """file_id, text (its ``digest``), component: one row per row, equal where texts are linked, directly or through others.

    ``files``: file_id, content; other columns are not read. Null, empty and blank texts are alike. With
    ``fingerprints`` texts are linked as well that :mod:`evimill.llm.simhash` links.
    """
    marks = per_text(_marked, "struct<shingles: binary, bands: array<bigint>>", F.col("content"))
    fp = [simhash.fingerprints(F.col("content")).alias("fp")] if fingerprints else []
    marked = files.select("file_id", digest(F.col("content")).alias("text"), *fp, marks.alias("x"))
    marked = kept(marked.select("file_id", "text", *[F.col("fp") for _ in fp], "x.*"))
    classes = kept(
        marked.groupBy("shingles")
        .agg(F.min("text").alias("text"), F.min("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    every = classes.select("id", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key").repartition(F.xxhash64("key"))
    buckets = kept(every.join(shuffled(shared), "key"))
    members = classes.select("id", "text").join(shuffled(buckets.select("id").distinct()), "id")
    sets = kept(
        files.select(digest(F.col("content")).alias("text"), "content")
        .dropDuplicates(["text"])  # before the shuffle, so that of copies in one task one goes out
        .join(shuffled(members), "text")
        .select("id", per_text(_set, "struct<n: int, bits: binary, hashes: binary>", F.col("content")).alias("x"))
        .select("id", "x.*")
    )
    found = links(buckets, sets)
    if fingerprints:
        found = found.unionByName(fingerprint_links(marked, classes))
    named = classes.join(shuffled(stars.roots(found)), F.col("id") == F.col("node"), "left").select(
        "shingles", F.coalesce("root", "id").alias("component")
    )
    return marked.select("file_id", "text", "shingles").join(
        shuffled(named.repartition(F.xxhash64("shingles"))), "shingles"
    ).select("file_id", "text", "component")
