"""What was configured against what was discovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.functions.text import package_key, trim_space
from evimill.operators.rows import explode_once
from evimill.operators.skew import lookup_keys, spread, unique_keys

TARGET_KEY = ["group_id", "target"]

# Fixed texts of inventory records.
NOTHING_DISCOVERED = "no fuzz targets discovered"
NOTHING_PRESENT = "configured fuzz targets not present in local workspace"


def discovered_targets(listings: DataFrame, key: str, text: Column) -> DataFrame:
    """Names in a listing: one per line, blank lines and warnings left out."""
    names = F.filter(
        F.transform(F.split(text, "\n"), trim_space),
        lambda line: (line != "") & ~F.startswith(line, F.lit("warning:")),
    )
    return explode_once(listings, [key], names, "pos", "target")


def targets_available(groups: DataFrame, configured: DataFrame, discovered: DataFrame) -> DataFrame:
    """Targets to run: the configured ones that exist, or all that exist where a group says so.

    ``groups`` is (group_id, take_all), a null meaning no. Rows of the configuration are kept
    as they are, repeated ones included.
    """
    found = lookup_keys(discovered, TARGET_KEY)
    by_name = lookup_keys(groups.filter("NOT coalesce(take_all, false)"), ["group_id"])
    in_full = lookup_keys(groups.filter("take_all"), ["group_id"])
    named = configured.join(by_name, "group_id", "left_semi").join(found, TARGET_KEY, "left_semi")
    every = found.join(in_full, "group_id", "left_semi")
    return named.select(TARGET_KEY).unionByName(every.select(TARGET_KEY))


def targets_missing(configured: DataFrame, discovered: DataFrame) -> DataFrame:
    """One skipped record per configured target that does not exist."""
    missing = configured.join(lookup_keys(discovered, TARGET_KEY), TARGET_KEY, "left_anti")
    return missing.select(*TARGET_KEY, *_missing_record())


def _missing_record() -> list[Column]:
    return [
        F.lit("skipped").alias("status"),
        F.concat(
            F.lit("configured fuzz target "),
            F.col("target").cast("string"),
            F.lit(" not present in local workspace"),
        ).alias("summary"),
    ]


def group_collapse(groups: DataFrame, configured: DataFrame, discovered: DataFrame, once: bool = False) -> DataFrame:
    """Skipped records of all groups; a group with nothing to run has exactly one.

    ``groups`` is (group_id, take_all, listing_summary): the last is what discovery said and
    is the cause given when it found nothing. One pass over both lists counts per target
    how often it is configured and whether it exists; the targets left to report are those
    sums again, so neither list is read a second time for them. Both lists may repeat rows; with
    ``once`` a target configured more than once counts as one.
    """
    none = F.lit(0).cast("bigint")
    listed = (
        configured.select(*TARGET_KEY, F.lit(1).cast("bigint").alias("configured"), none.alias("found"))
        .unionByName(discovered.select(*TARGET_KEY, none.alias("configured"), F.lit(1).cast("bigint").alias("found")))
    )
    # A null group is nobody's. The optimizer derives this test for some uses of the sums only, as it
    # moves a plain test of take_all into the lists; then their exchanges differ and none is used again.
    dealt = spread(listed.filter("group_id IS NOT NULL"), TARGET_KEY)
    times = F.max("configured") if once else F.sum("configured")
    seen = dealt.groupBy(*TARGET_KEY).agg(times.alias("configured"), F.max("found").alias("found"))
    counts = seen.groupBy("group_id").agg(
        F.sum(F.col("configured") * F.col("found")).alias("available"), F.sum("found").alias("discovered")
    )
    take_all = F.coalesce("take_all", F.lit(False))
    to_run = F.coalesce(F.when(take_all, F.col("discovered")).otherwise(F.col("available")), F.lit(0))
    judged = groups.join(counts, "group_id", "left").withColumn("to_run", to_run)
    cause = F.when(
        F.coalesce(F.col("discovered"), F.lit(0)) == 0,
        F.coalesce(F.col("listing_summary"), F.lit(NOTHING_DISCOVERED)),
    ).otherwise(F.lit(NOTHING_PRESENT))
    collapsed = judged.filter("to_run = 0").select(
        "group_id",
        F.lit(None).cast(configured.schema["target"].dataType).alias("target"),
        F.lit("skipped").alias("status"),
        F.concat(F.lit("no fuzz targets available: "), cause).alias("summary"),
    )
    running = unique_keys(judged.filter(F.when(~take_all, F.col("to_run")) > 0), ["group_id"])
    missing = (
        seen.filter("found = 0")
        .join(running, "group_id", "left_semi")
        .select(*TARGET_KEY, F.explode(F.sequence(F.lit(1).cast("bigint"), "configured")).alias("nth"))
        .select(*TARGET_KEY, *_missing_record())
    )
    return collapsed.unionByName(missing)


def harness_attach(crates: DataFrame, harnesses: DataFrame) -> DataFrame:
    """Crates with the harness directory of the same name, ``-`` and ``_`` being equal.

    Where several directories fit, the first in path order is taken.
    """
    first = (
        harnesses.groupBy(package_key(F.col("name")).alias("key"))
        .agg(F.min("path").alias("harness_dir"))
        .repartition(F.xxhash64("key"))  # so that a name many crates share can be split in the join
    )
    keyed = crates.withColumn("key", package_key(F.col("name")))
    return keyed.join(first, "key", "left").drop("key")


def seed_backfill(corpus: DataFrame, seeds: DataFrame) -> DataFrame:
    """Corpus files; a target without any takes its seeds, the others are left alone."""
    filled = lookup_keys(corpus, ["crate", "target"])
    return corpus.unionByName(seeds.join(filled, ["crate", "target"], "left_anti"))


def artifacts_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries of the later snapshot that are new or were modified since the earlier one."""
    old = before.select("dir", "path", F.col("modified").alias("was"))
    return (
        after.join(old, ["dir", "path"], "left")
        .filter("was IS NULL OR modified > was")
        .select("dir", "path", "modified")
    )


def artifact_newest(changed: DataFrame) -> DataFrame:
    """Newest changed entry per directory; of equally new ones the last in path order."""
    newest = changed.groupBy("dir").agg(F.max("modified").alias("modified"))
    tied = changed.join(unique_keys(newest, ["dir", "modified"]), ["dir", "modified"], "left_semi")
    return tied.groupBy("dir").agg(F.max("path").alias("path"))
