"""Results that several parts of a job read, computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without one a new local folder in local mode, as in tests, ValueError on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df``, written as a table to ``shared_folder`` and read from there.

    So it is computed once however many parts of a plan read it, and a lost executor costs no lineage. A checkpoint
    would hand on the estimated size of what it was made from, a table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input, sorted and never broadcast.

    Sizes of arrays, and of rows made from them, are estimated at one element each, so that Spark would
    take such a side for small and gather it in the driver.
    """
    return left.join(right.hint("merge"), on, how)
