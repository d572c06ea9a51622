"""Mixing crates to target weights.

The words of each crate are laid end to end and cut into blocks of fixed length. The mix is a
sequence of slots, dealt to output shards; how many slots of a shard go to which crate is drawn
from the multinomial distribution under the mix's totals (a multivariate hypergeometric draw), by
halving the range of shards again and again so that every shard finds its own counts alone. The
slots of a crate are numbered through all shards and mapped to its blocks by pseudorandom
permutations, one for each pass over the crate, and the blocks are joined by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimill.llm.storage import kept, shuffled
from evimill.llm.texts import per_text

#: Up to so many slots numpy draws; it takes no more than a billion.
_NUMPY_DRAWS = 1 << 29


def word_count(text: str) -> int:
    """Runs of anything but ASCII white space."""
    return len(text.encode("utf-8", "surrogatepass").split())


def targets(sizes: list[int], weights: list[float], max_repeats: int) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``max_repeats`` times its size.

    What the cap cuts off is shared again by weight among the others until none is above.
    """
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / whole > max_repeats * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = float(max_repeats * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size) chosen by key: Feistel rounds, walked into the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, size = index.astype(np.uint64), size.astype(np.uint64)
    todo = np.ones(len(value), dtype=bool)
    while todo.any():
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for step in range(4):
            mixed = (right + key[todo] + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask[todo])
        value[todo] = left << half[todo] | right
        todo &= value >= size
    return value.astype(np.int64)


def _log_ratio(above: int, below: int) -> float:
    """log(above! / below!) less (above - below) * log(below + 1), without loss where both are large."""
    if min(above, below) < 1000:
        return math.lgamma(above + 1) - math.lgamma(below + 1) - (above - below) * math.log(below + 1)
    step = above - below
    grown = math.log1p(step / below)
    shift = step * math.log1p(1 / below)
    return (above + 0.5) * grown - step + (1 / above - 1 / below) / 12 - shift


def hypergeometric(rng: np.random.Generator, good: int, bad: int, share: int) -> int:
    """Number of good ones among ``share`` drawn of ``good + bad`` without putting back, of any size.

    Beyond numpy's limit by rejection under an envelope that holds for every log-concave distribution:
    flat around the most likely number, exponential beyond. Takes about four tries whatever the sizes.
    """
    if good + bad < _NUMPY_DRAWS:
        return int(rng.hypergeometric(good, bad, share))
    low, high = max(0, share - bad), min(good, share)
    mode = min(high, max(low, (share + 1) * (good + 1) // (good + bad + 2)))
    # the four factorials of the probability at the most likely number
    at_mode = (mode, good - mode, share - mode, bad - share + mode)
    logs = [math.log(x + 1) for x in at_mode]

    def log_relative(x: int) -> float:
        """log of the probability of x over that of the most likely number."""
        step = x - mode
        moved = (x, good - x, share - x, bad - share + x)
        signs = (step, -step, -step, step)
        exact = math.fsum(_log_ratio(a, b) for a, b in zip(moved, at_mode, strict=True))
        return -exact - math.fsum(s * v for s, v in zip(signs, logs, strict=True))

    # A lower bound of the largest probability: a unimodal one whose deviation is sd has at least
    # 1 / (1 + sd * sqrt(12)) there. A lower one only makes the envelope wider.
    total = good + bad
    variance = share * (good / total) * (bad / total) * ((total - share) / max(1, total - 1))
    peak = 0.99 / (1 + math.sqrt(12 * variance + 1))
    flat = 1 + peak / 2
    while True:
        if rng.random() * (1 + flat) <= flat:
            away, height = rng.random() * flat / peak, 0.0
        else:
            beyond = rng.standard_exponential()
            away, height = (flat + beyond) / peak, -beyond
        x = mode + (1 if rng.random() < 0.5 else -1) * math.floor(away + 0.5)
        if low <= x <= high and height - rng.standard_exponential() <= log_relative(x):
            return x


def multivariate(rng: np.random.Generator, counts: np.ndarray, share: int) -> np.ndarray:
    """How many of each crate are among ``share`` slots drawn of ``counts`` without putting back."""
    total = int(counts.sum())
    if total < _NUMPY_DRAWS:
        return rng.multivariate_hypergeometric(counts, share, method="marginals")
    out = np.zeros_like(counts)
    for k, count in enumerate(counts.tolist()):
        total -= count
        out[k] = hypergeometric(rng, count, total, share)
        share -= int(out[k])
    return out


def shard_counts(shard: int, shards: int, slots: np.ndarray, shard_slots: int, seed: int):
    """(first number, count) per crate of the slots that ``shard`` holds."""
    first, counts = np.zeros_like(slots), slots.copy()
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(counts.sum())
        share = min(total, (middle - low) * shard_slots)
        left = multivariate(np.random.Generator(np.random.PCG64([seed, low, high])), counts, share)
        if shard < middle:
            counts, high = left, middle
        else:
            first, counts, low = first + left, counts - left, middle
    return first, counts


def _drawn(slots: list[int], blocks: list[int], shards: int, shard_slots: int, seed: int):
    slots_of, blocks_of = np.array(slots, dtype=np.int64), np.array(blocks, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_counts(shard, shards, slots_of, shard_slots, seed)
                source = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + first[source]
                passed, index = np.divmod(number, np.maximum(blocks_of[source], 1))
                key = (np.uint64(seed) << np.uint64(48)) ^ (source.astype(np.uint64) << np.uint64(20))
                block = permuted(index, blocks_of[source], key ^ passed.astype(np.uint64))
                # where in the shard a slot comes is a permutation as well
                order = np.full(len(source), len(source))
                key = np.full(len(source), (seed << 32) ^ shard ^ 1 << 60, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(source), shard, dtype=np.int64)),
                        pa.array(permuted(np.arange(len(source)), order, key)),
                        pa.array(source.astype(np.int64)),
                        pa.array(block),
                    ],
                    names=["shard", "slot", "source_no", "block"],
                )

    return run


class Mix:
    """A mix of ``files``: ``sources``, ``placed`` files, and ``slots`` of the output.

    ``files``: file_id, crate, content; other columns are not read. Crates by code point, null
    last, weigh ``weights`` in turn; the mix has as many words as the files, and no crate more than
    ``max_repeats`` times its own. Null texts have no words; repeated rows are files of their own.

    One row per crate reaches the driver: name, size and target. Files and blocks never do.
    """

    def __init__(
        self,
        files: DataFrame,
        weights: tuple[float, ...] = (5, 2, 1),
        max_repeats: int = 3,
        block_words: int = 64,
        shard_slots: int = 8192,
        seed: int = 11,
    ):
        spark = files.sparkSession
        self.block_words = block_words
        sized = kept(
            files.select(
                F.monotonically_increasing_id().alias("row"), "file_id", "crate",
                F.xxhash64("file_id", "crate", "content").alias("place"),
                per_text(word_count, "bigint", F.col("content")).alias("size"),
            )
        )
        rows = sized.groupBy("crate").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        crates = rows.orderBy(F.col("crate").asc_nulls_last()).collect()
        sizes = [row["size"] for row in crates]
        wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], max_repeats)
        self.blocks = [math.ceil(size / block_words) for size in sizes]
        self.slots = [
            min(max_repeats * n, round(target * n / size)) if size else 0
            for size, target, n in zip(sizes, wanted, self.blocks, strict=True)
        ]
        self.sources = spark.createDataFrame(
            [(k, row["crate"], row["size"], wanted[k]) for k, row in enumerate(crates)],
            "source_no bigint, crate string, source_size bigint, target double",
        )
        self.placed = self._placed(sized, sum(row["n"] for row in crates))
        shards = max(1, math.ceil(sum(self.slots) / shard_slots))
        draw = _drawn(self.slots, self.blocks, shards, shard_slots, seed)
        per_task = spark.range(shards, numPartitions=max(1, min(shards, spark.sparkContext.defaultParallelism * 4)))
        self.drawn = per_task.mapInArrow(draw, "shard bigint, slot bigint, source_no bigint, block bigint")

    def _placed(self, sized: DataFrame, rows: int, per_bucket: int = 2048) -> DataFrame:
        """Files with ``start``, the words of their crate before them; crates are cut by hash into buckets.

        The order is that of a hash of the whole row, so it is the same however the table is split;
        rows that are alike in everything may change places, which shows nowhere.
        """
        buckets = max(1, math.ceil(rows / per_bucket))
        dealt = sized.join(self.sources, sized["crate"].eqNullSafe(self.sources["crate"])).select(
            "row", "file_id", "place", "size", "source_no", "source_size", "target",
            F.pmod("place", F.lit(buckets)).alias("bucket"),
        )
        earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases = (
            dealt.groupBy("source_no", "bucket")
            .agg(F.sum("size").alias("words"))
            .select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
        )
        order = ["place", "file_id", "size", "row"]
        inside = Window.partitionBy("source_no", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return (
            dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(shuffled(bases), ["source_no", "bucket"])
            .select(
                "row", "file_id", "size", "source_no", "source_size", "target",
                (F.col("base") + F.col("inside")).alias("start"),
            )
        )

    def parts(self) -> DataFrame:
        """row, source_no, block, words: what of a block comes from which file."""
        length = F.lit(self.block_words)
        first = F.floor(F.col("start") / length)
        last = F.floor((F.col("start") + F.col("size") - 1) / length)
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(
            F.col("start"), F.col("block") * length
        )
        return (
            self.placed.where("size > 0")
            .withColumn("block", F.explode(F.sequence(first, last)))
            .select("row", "source_no", "block", words.alias("words"))
        )

    def taken(self) -> DataFrame:
        """file_id, size, source_size, target, taken: the words the mix takes of each file, repeats counted."""
        times = self.drawn.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        took = (
            self.parts()
            .join(shuffled(times), ["source_no", "block"])
            .groupBy("row")
            .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        )
        return self.placed.join(shuffled(took), "row", "left").select(
            "file_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )


def copies(taken: DataFrame) -> DataFrame:
    """file_id, copies: how often the mix repeats each file as a whole; files without words stay once.

    The words taken over the size, rounded up or down by hash with the fraction as the probability,
    so that crates still come near their targets. Rows that share a file_id share the number.
    """
    unit = F.pmod(F.xxhash64(F.col("file_id"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    totals = taken.groupBy("file_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + unit))
    return totals.select("file_id", times.cast("int").alias("copies"))
