"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the folder in ``spark.checkpoint.dir`` and reads it again as the next stage's documents.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evimill.llm import mixing, near_texts, packing, queries, secrets, storage, toxicity


def whole(docs: DataFrame) -> Column:
    """A document as one struct, so that its columns never clash with those of an operator."""
    return F.struct(*(docs[name] for name in docs.columns)).alias("doc")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    model = queries.toxicity_model(spark, sf_dir)
    return docs.where(toxicity.toxicity(model, docs["text"])["score"] < 0.7)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest id there, null after all others.

    Near copies have SimHash fingerprints that differ in three bits at most, or share four fifths of their
    five-word shingles or more. Different texts under one doc_id are judged apart; of equal texts under
    it one row stays.
    """
    grouped = near_texts.near_texts(queries.files_of(docs), fingerprints=True)
    first = grouped.groupBy("component").agg(
        F.min(F.struct(F.col("file_id").isNull().alias("unnamed"), F.col("file_id").alias("id"), "text")).alias("first")
    )
    again = Window.partitionBy("text", "doc.doc_id").orderBy(F.xxhash64("doc"))
    once = (
        docs.select(whole(docs), near_texts.digest(docs["text"]).alias("text"))
        .join(storage.shuffled(first.select("first.id", "first.text").repartition(F.xxhash64("text"))), "text")
        .where(F.col("doc.doc_id").eqNullSafe(F.col("id")))
        .withColumn("row", F.row_number().over(again))
        .where("row = 1")
    )
    return once.select("doc.*")


def live_secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked in the text, and n_chars follows; every document stays."""
    files = docs.select(
        F.concat_ws("/", docs["lang"], docs["doc_id"]).alias("crate"),
        docs["source"].alias("cohort"),
        docs["text"].alias("content"),
        whole(docs),
    )
    safe = secrets.without_live_secrets(files)
    longer = F.coalesce(F.length("content") - F.length("doc.text"), F.lit(0))
    chars = (F.col("doc.n_chars") + longer).cast(dict(docs.dtypes)["n_chars"])
    return safe.select(F.col("doc").withField("text", F.col("content")).withField("n_chars", chars).alias("doc")).select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; without words once."""
    times = mixing.copies(mixing.Mix(queries.files_of(docs)).taken()).where("copies > 0")
    counted = docs.select(whole(docs)).join(storage.shuffled(times), F.col("doc.doc_id").eqNullSafe(F.col("file_id")))
    return counted.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack_files(queries.files_of(docs), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumnRenamed("file_id", "doc_id")


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("secrets", live_secrets_out),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learnt scores, fingerprints and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
