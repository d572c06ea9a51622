"""The queries of this subpackage: the given tables mapped to each operator and its results back."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimill.llm import (
    decision_lists,
    licenses,
    log_trie,
    mixing,
    near_profiles,
    neighbours,
    oracles,
    packing,
    pseudonyms,
    secrets,
    simhash,
    token_counts,
    toxicity,
    whitening,
)
from evimill.llm.storage import shuffled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_near_profiles": oracles.NEAR_PROFILES, "op12_log_trie": oracles.LOG_TRIE}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is the crate, language and number are the path."""
    return docs.select(
        F.col("source").alias("crate"),
        F.concat_ws("/", "lang", "doc_id").alias("file"),
        F.col("doc_id").alias("file_id"),
        F.col("text").alias("content"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def owned(tree: DataFrame) -> DataFrame:
    """For questions of ownership a document is a crate of its own, and its source the cohort."""
    return tree.withColumn("cohort", F.col("crate")).withColumn("crate", F.col("file"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("file_id"), "toxic")
    return toxicity.fit(files(spark, sf_dir), labels.where(~toxicity.held_out(F.col("file_id"))))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_files(files(spark, sf_dir), toxicity_model(spark, sf_dir))
    return scored.withColumnRenamed("file_id", "doc_id")


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(files(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_files(files(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("file_id", "doc_id")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(owned(files(spark, sf_dir))).withColumnRenamed("file_id", "doc_id")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(files(spark, sf_dir)).taken().withColumnRenamed("file_id", "doc_id")


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(files(spark, sf_dir)).withColumnRenamed("file_id", "doc_id")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(files(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumnRenamed("file_id", "doc_id")


@query
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without a key of the session, one for this run only: equal values stay linked within it
    key = spark.conf.get("spark.evimill.pseudonyms.key", None) or token_hex(32)
    changed = pseudonyms.pseudonymise_files(files(spark, sf_dir), key)
    return changed.withColumnsRenamed({"file_id": "doc_id", "content": "text"})


@query
def op10_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = files(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("file_id"), "quality")
    rules = decision_lists.learn(tree, labels.where(~toxicity.held_out(F.col("file_id"))))
    return decision_lists.judge_files(tree, rules).withColumnRenamed("file_id", "doc_id")


@query
def op11_near_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = near_profiles.near_profiles(vectors.withColumnsRenamed({"vec_id": "file_id", "label": "cohort", "embedding": "profile"}))
    return found.withColumnRenamed("file_id", "vec_id")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as runs and lines: each starts with up to five turns of the first of its hundred."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = (
        conversations.where("conv_id is not null")
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("taken", F.crc32(F.col("conv_id").cast("string")) % 6)
    )
    runs = turns.where("place = 1").select(F.col("conv_id").alias("run_id"), "taken")
    first = turns.where("place <= 5 and conv_id % 100 = 0").select("conv_id", "place", "role", "text")
    heads = (
        runs.withColumn("conv_id", F.col("run_id") - F.col("run_id") % 100)
        .join(shuffled(first), "conv_id")
        .where("place <= taken")
        .select("run_id", F.col("place").alias("line"), F.col("role").alias("stream"), "text")
    )
    own = turns.where("place > taken").select(
        F.col("conv_id").alias("run_id"), (F.col("place") + 5).alias("line"), F.col("role").alias("stream"), "text"
    )
    return runs, heads.unionByName(own)


@query
def op12_log_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log_trie.log_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.withColumnsRenamed(
        {"run_id": "conv_id", "parent_run_id": "parent_conv_id", "n_runs": "n_convs", "saved_chars": "saved_tokens"}
    )


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(
        F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    steps = F.transform("embedding", lambda c: F.floor(1024 * c.cast("double")) + 100_000)
    found = whitening.whiten(vectors.select(F.col("vec_id").alias("file_id"), steps.alias("counters")))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).withColumnRenamed("file_id", "vec_id")
