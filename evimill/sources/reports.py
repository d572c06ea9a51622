"""Report sinks, and the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimill.operators.report import REPORT_ORDER
from evimill.operators.report_update import DIGEST_SCHEMA, INPUTS, digest_documents, input_digests, stale_crates, updated_report
from evimill.operators.study_plan import FORMATS

STUDY_SCHEMA = (
    "schema_version int, study_name string, execution struct<profile:string,jobs:bigint,fuzz_jobs:bigint,"
    "phases:struct<scan:boolean,geiger:boolean,miri:boolean,fuzz:boolean>,miri_triage:boolean,"
    "fuzz_time:bigint,fuzz_env:map<string,string>>"
)
HEAD_SCHEMA = (
    "crate string, crate_ord bigint, path string, cohort string, n_sites bigint, "
    "pattern_summary struct<unsafe_blocks:bigint,unsafe_fns:bigint,unsafe_impls:bigint,extern_blocks:bigint,"
    "ptr_ops:bigint,transmutes:bigint,unchecked_ops:bigint,inline_asm:bigint,other:bigint>, "
    "review array<struct<rank:int,site_id:string,file:string,line:int,reason:string>>"
)
SITES_SCHEMA = (
    "crate string, sites array<struct<number:bigint,site_id:string,file:string,line:int,"
    "kind:string,pattern:string>>"
)
PHASES_SCHEMA = (
    "crate string, phases array<struct<number:bigint,kind:string,name:string,status:string,"
    "duration_ms:bigint,log_path:string,summary:string,root_unsafe:bigint,dependency_unsafe:bigint,"
    "verdict:string,ub_category:string,target:string,budget_secs:bigint,artifact:string,"
    "error_kind:string,runs:decimal(20,0),excerpt:string,group_name:string,stage:string,command:string>>"
)


def write_reports(
    documents: DataFrame, lines: DataFrame, path: str, formats: list[str] | None = None
) -> None:
    """A report in the formats asked for, in all of them if none is named."""
    for name in formats or FORMATS:
        if name == "json":
            write_report(documents, f"{path}/report.json")
        elif name == "markdown":
            write_markdown(lines, f"{path}/report.md")
        else:
            raise ValueError(f"unknown report format: {name}")


def write_report(documents: DataFrame, path: str) -> None:
    """One JSON document per line, files grouped by section."""
    documents.select("section", F.col("document").alias("value")).write.partitionBy("section").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(crate, section, document) as they were written."""
    lines = spark.read.text(path).withColumnRenamed("value", "document")
    return lines.select(F.get_json_object("document", "$.crate").alias("crate"), "section", "document")


def update_report(
    spark: SparkSession, path: str | None, out: str, inputs: dict[str, DataFrame], make: Callable[[DataFrame | None], DataFrame]
) -> None:
    """Write to ``out`` the report of ``inputs``, with what still holds of the finished one at ``path``.

    ``make`` gives the documents of a report: of the crates in the table it gets, joined to its inputs
    before anything else, or of all for None. Where ``path`` is None everything is made. Inputs laid out by
    crate are then read for these crates only; ``inputs`` may be listings of files. Which crates are stale is
    computed again by each branch that needs it, from one row per crate and input, and never collected.
    """
    digests = input_digests(inputs)
    if path is None:
        fresh = make(None)
        documents = fresh.select("crate", "section", "document")
    else:
        finished = read_documents(spark, path)
        then = finished.filter(F.col("section") == INPUTS).select(F.from_json("document", DIGEST_SCHEMA).alias("d")).select("d.*")
        stale = stale_crates(then, digests)
        documents = updated_report(finished.filter(F.col("section") != INPUTS), make(stale), stale)
    stated = digest_documents(digests).select("crate", "section", "document")
    write_report(documents.unionByName(stated), out)


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a written report: study, crates, review, sites, phases."""

    def section(name: str, schema: str) -> DataFrame:
        lines = spark.read.text(path).filter(F.col("section") == name)
        return lines.select(F.from_json("value", schema).alias("d")).select("d.*")

    heads = section("head", HEAD_SCHEMA)
    return {
        "study": section("study", STUDY_SCHEMA),
        "crates": heads.drop("review"),
        "review": heads.select("crate", F.inline("review")),
        "sites": section("sites", SITES_SCHEMA).select("crate", F.inline("sites")),
        "phases": section("phases", PHASES_SCHEMA).select("crate", F.inline("phases")),
    }


def write_markdown(rows: DataFrame, path: str) -> None:
    """Lines in report order; the names of the files sort in that order too."""
    spread = rows.repartitionByRange(*REPORT_ORDER)
    spread.sortWithinPartitions(*REPORT_ORDER).select("text").write.text(path)
