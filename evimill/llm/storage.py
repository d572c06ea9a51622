"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Leaves a folder named by ``spark.checkpoint.dir`` alone; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, True)
    context.setCheckpointDir(named)


def shuffled(frame: DataFrame) -> DataFrame:
    """One side of a join that is not to be broadcast: what Spark estimates behind Python code,
    checkpoints or a short range is a guess, and here the rows grow with the input."""
    return frame.hint("merge")


def kept(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, computed once and read from the shared folder afterwards.

    Spark removes the files once the returned frame is no longer referenced, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    ensure_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)
