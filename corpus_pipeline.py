"""Corpus pipeline: quality, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``. Null ids and texts are
documents like any other: scored, linked, compared with the benchmark (a null text as empty) and encoded.
Rows are decided one by one, also where they share an id; of rows equal in all columns one is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontam, jaccard, pii, quality
from weftline.llm.common import cut, handed_in_small_batches, maybe_in, shared_folder, table, without_ids

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL can say what the stages do; tests/llm compares them with plain versions.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, by which rows are decided: equal for rows equal in all columns only, ordered by id, null ids last."""
    id_ = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    rest = F.struct(F.md5("text").alias("text"), *(c for c in docs.columns if c not in ("doc_id", "text")))
    return docs.withColumn("_key", F.concat(F.coalesce(id_, F.lit("null")), F.lit(":"), F.md5(F.to_json(rest))))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under the classifier's bound."""
    rows = keyed(docs)
    scores = quality.quality_scores(rows, table(spark, sf_dir, "labels"), key_col="_key")
    return without_ids(rows, cut(scores.where("predicted = 0").select("_key").distinct()), "_key").drop("_key")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates, and one of rows equal in all columns."""
    rows = keyed(docs)
    groups = jaccard.jaccard_components(rows, id_col="_key")
    kept = without_ids(rows, cut(groups.where("_key <> component_id").select("_key").distinct()), "_key")
    marked = maybe_in(kept, "_key", groups.groupBy("_key").count().where("count > 1"), "_key", "_again")
    return marked.where("not _again").unionByName(marked.where("_again").dropDuplicates(["_key"])).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    rows = keyed(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_key")
    return without_ids(rows, cut(found.where("contaminated").select("_key").distinct()), "_key").drop("_key")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and the terms that disclose it; ``n_chars`` follows the new text."""
    found = pii.pii(docs, keep=["lang", "source"])
    text = F.col("sanitised")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether decoding them gives the text back."""
    encoded = bpe.bpe(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), keep_text=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def sparing(stage: Stage) -> Stage:
    """A stage whose Python workers get small batches, so that five stages in a row fit in the executors' memory."""
    return lambda spark, docs, sf_dir: stage(handed_in_small_batches(spark), docs, sf_dir)


STAGES = [
    ("quality classifier", sparing(keep_good)),
    ("n-gram Jaccard join", sparing(keep_one_of_copies)),
    ("benchmark decontamination", sparing(drop_benchmark_leaks)),
    ("personal data", sparing(remove_personal_data)),
    ("BPE encoding and decoding", sparing(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
