"""Readers for directory trees: source corpora, tool logs, seed files, studies.

All of them derive names from paths with column expressions, so listing and reading
stay with Spark. Archives of very many small files are better kept as Parquet with the
columns these readers return; every operator takes that DataFrame just as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evimill.functions.text import lossy_text
from evimill.functions.vocabulary import PRUNED_DIRECTORIES

STUDY_CRATE_SCHEMA = (
    "name string, path string, cohort string, "
    "miri_case array<struct<name:string,scope:string,harness_dir:string,test:string,"
    "case:string,exact:boolean,env:map<string,string>>>, "
    "fuzz_group array<struct<name:string,harness_dir:string,all:boolean,targets:array<string>,"
    "time:bigint,budget_label:string,env:map<string,string>>>"
)
STUDY_SCHEMA = (
    "study struct<name:string,output_root:string,fuzz_time:bigint,fuzz_env:map<string,string>>, "
    f"crate array<struct<{STUDY_CRATE_SCHEMA}>>"
)

_LOCATION = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def _root_path(spark: SparkSession, root: str) -> str:
    """The directory without scheme and host, as Hadoop resolves it, with a slash at the end.

    Names are cut off by the length of this path, so it must be one directory, not a pattern.
    """
    if any(sign in root for sign in "*?[{"):
        raise ValueError(f"a root is one directory, not a pattern: {root}")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toUri().getPath().rstrip("/") + "/"


def _below(path: Column, root: str) -> Column:
    """Part of a path below the resolved root; a path elsewhere is an error, never a wrong name."""
    plain = F.regexp_replace(path, _LOCATION, "")
    outside = F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string")
    rest = F.substring(plain, F.lit(len(root) + 1), F.length(plain))
    return F.when(F.startswith(plain, F.lit(root)), rest).otherwise(outside)


def _file_path() -> Column:
    """``_metadata.file_path`` as a path: it is percent-encoded there."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _binary_files(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(root)


def read_corpus(spark: SparkSession, root: str, extension: str = "rs") -> DataFrame:
    """``<root>/<crate>/...`` as (crate, file, content), pruned directories left out.

    The directory test is on file metadata, so pruned files are never opened, and it looks
    only at the part below the crate: a corpus stored below a directory called ``vendor``
    is read all the same.
    """
    top = _root_path(spark, root)
    below = F.split(_below(_file_path(), top), "/")
    inner = F.slice(below, F.lit(2), F.greatest(F.size(below) - 2, F.lit(0)))
    pruned = F.arrays_overlap(inner, F.array(*[F.lit(d) for d in PRUNED_DIRECTORIES]))
    relative = _below(F.col("path"), top)
    return (
        _binary_files(spark, root, f"*.{extension}")
        .filter(~pruned)
        .select(
            F.substring_index(relative, "/", 1).alias("crate"),
            F.substring(
                relative, F.instr(relative, "/") + 1, F.length(relative)
            ).alias("file"),
            lossy_text(F.col("content")).alias("content"),
        )
    )


def read_tool_logs(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/crates/<crate>/logs/<phase>.<name>.log`` as one row per log."""
    layout = r"/crates/([^/]+)/logs/([^/.]+)\.([^/]*)\.log$"
    _root_path(spark, root)
    path = _file_path()
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.log")
        .text(root, wholetext=True)
        .filter(path.rlike(layout))
        .select(
            F.regexp_extract(path, layout, 1).alias("crate"),
            F.regexp_extract(path, layout, 2).alias("kind"),
            F.regexp_extract(path, layout, 3).alias("name"),
            F.make_valid_utf8("value").alias("combined_output"),
        )
    )


SEED_LAYOUT = r"^([^/]+)/corpus/([^/]+)/(.+)$"


def seed_names(relative: Column) -> dict[str, Column]:
    """crate, target and file of a seed by its path below the root; empty for other files."""
    return {
        name: F.regexp_extract(relative, SEED_LAYOUT, k) for k, name in enumerate(["crate", "target", "file"], 1)
    }


def seed_files(files: DataFrame, relative: Column) -> DataFrame:
    """(crate, target, file, content) of the files that lie where seeds belong."""
    names = [column.alias(name) for name, column in seed_names(relative).items()]
    return files.filter(relative.rlike(SEED_LAYOUT)).select(*names, "content")


def read_seeds(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<crate>/corpus/<target>/<file>`` as (crate, target, file, content)."""
    top = _root_path(spark, root)
    return seed_files(_binary_files(spark, root), _below(F.col("path"), top))


def read_study(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A nested study document as (study settings, crates with nested cases and groups).

    Keys outside the schema are ignored. A study too large for one document is kept as one
    crate per line and read with ``spark.read.schema(STUDY_CRATE_SCHEMA).json``.
    """
    document = spark.read.schema(STUDY_SCHEMA).json(path, multiLine=True)
    crates = document.select(F.posexplode("crate").alias("crate_ord", "c")).select("crate_ord", "c.*")
    return document.select("study.*"), crates
