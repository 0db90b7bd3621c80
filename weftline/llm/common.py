"""Helpers that every operator of this subpackage uses: tables, cut lineage, linked components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes and rows that an operator's Python code works on at a time; one longer row is worked on alone.
SLICE_BYTES, SLICE_ROWS = 1 << 21, 1000
#: What a job has Spark hand to a Python worker at a time.
HANDED_BYTES = "4m"


def handed_in_small_batches(spark: SparkSession) -> SparkSession:
    """For a job's own session: batches for Python workers have about HANDED_BYTES, so many cores fit in an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", HANDED_BYTES)
    return spark


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES and at most SLICE_ROWS, without a copy."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, done + SLICE_BYTES, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give the memory that a finished task freed back to the system, as workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_slices(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """``mapInPandas`` in slices bounded by bytes, whatever batches the session hands out; the session is left as it is."""
    fields = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(part.to_pandas() for batch in batches for part in _slices(batch)):
            yield pa.RecordBatch.from_pandas(out, schema=fields, preserve_index=False)
        release()

    return rows.mapInArrow(whole, schema)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in slices bounded by bytes, as ``map_slices`` does it for pandas."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches for part in _slices(batch))
        release()

    return rows.mapInArrow(whole, schema)


#: Has Spark delete the shuffle files of a query when it ends, not when the driver's garbage is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside keep no shuffle files once their result is written; the session's setting is put back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so a lost executor costs no lineage.

    The folder is ``shared_folder``. What was shuffled for it is deleted.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without one a new local folder in local mode, as in tests, ValueError on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


class Rounds:
    """Tables that the rounds of a loop write to the shared folder and drop when no later round reads them.

    A checkpoint would hand its plan's size estimate on; a join's estimate is a product, so over the
    rounds of a loop the driver would work with numbers of millions of digits. A table has its real size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Smallest node reachable from each node of ``edges(src, dst)``: columns ``node``, ``component``.

    Each round merges every node into the smallest node next to it, or next to that one, and keeps
    the edges between what is left, so edges get fewer from round to round; a component's smallest
    node is never merged and stays at last. The joins are plain shuffle joins whose hot side Spark can
    split, and the minimum is combined before the shuffle, so a hub with very many neighbours is no
    hot task. Nulls link nothing; loops and repeated edges change nothing.

    Raises RuntimeError when ``rounds`` do not suffice, rather than returning split components.
    """
    tables = Rounds(edges.sparkSession)
    plain = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    both = tables.put("edges0", plain.union(plain.select("dst", "src")).distinct())
    steps: list[DataFrame] = []
    while len(steps) < rounds:
        k = len(steps)
        least = tables.put(f"least{k}", both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("to")))
        jump = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        to = tables.put(f"to{k}", least.join(jump, "to").select("node", F.col("next").alias("to")))
        steps.append(to)
        half = both.join(to.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").select("a", "dst")
        merged = half.join(to.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst").where("a <> b")
        both = tables.put(f"edges{k + 1}", merged.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        tables.drop(f"least{k}")
        tables.drop(f"edges{k}")
        if both.isEmpty():
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    out = steps[-1]
    for to in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("to").alias("later"))
        out = to.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("to"))
    out = cut(out.select("node", F.col("to").alias("component")))
    tables.drop()
    return out


def packed_slots(marks: DataFrame, bits: int) -> np.ndarray:
    """Fold ``marks(slot, level)`` into one byte a slot, the largest level: 2**bits bytes whatever the input.

    Slots are packed on the executors, so the driver gets at most 2**bits bytes.
    """
    width = 1 << max(0, bits - 8)

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(width, np.uint8)
        cells[batch["slot"].to_numpy() % width] = batch["level"].to_numpy()
        return pd.DataFrame({"part": [int(batch["slot"].iloc[0]) // width], "cells": [cells.tobytes()]})

    best = marks.groupBy("slot").agg(F.max("level").alias("level"))
    packed = best.groupBy(F.expr(f"slot div {width}")).applyInPandas(pack, "part int, cells binary")
    with shuffles_dropped(marks.sparkSession):
        parts = packed.select("*").collect()
    out = np.zeros(1 << bits, np.uint8)
    for part, cells in parts:
        out[part * width : part * width + width] = np.frombuffer(cells, np.uint8)
    return out


#: Filters for ids have 2**FILTER_BITS bits, in words of 64.
FILTER_BITS = 24


def packed_filter(slots: DataFrame, bits: int) -> np.ndarray:
    """A set of ``slot`` values below 2**bits as that many bits, whatever the input; read it by ``in_filter``."""
    byte = slots.select(F.expr("slot div 8").alias("slot"), F.expr("shiftleft(1, cast(slot % 8 as int))").alias("level")).groupBy("slot").agg(F.bit_or("level").alias("level"))
    return packed_slots(byte, bits - 3)


def in_filter(cells: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (cells[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def maybe_in(rows: DataFrame, col: str, ids: DataFrame, id_col: str, mark: str = "_may") -> DataFrame:
    """``rows`` with a column ``mark``: true for all rows whose ``col`` is in ``ids``, and few others, never null.

    The filter behind it has 2**FILTER_BITS bits at most, in a table of 2**(FILTER_BITS - 6) rows that is
    broadcast; when it fills up it only lets more rows through. An exact join must follow.
    """
    slot_of = lambda column: F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    slots = ids.select(slot_of(F.col(id_col)).alias("_slot")).select(F.expr("_slot div 64").alias("_word"), F.expr("shiftleft(1L, cast(_slot % 64 as int))").alias("_bits"))
    words = cut(slots.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    slotted = rows.withColumn("_slot", slot_of(F.col(col))).withColumn("_word", F.expr("_slot div 64"))
    marked = slotted.join(F.broadcast(words), "_word", "left")
    return marked.withColumn(mark, F.expr("coalesce(getbit(_bits, cast(_slot % 64 as int)) = 1, false)")).drop("_word", "_slot", "_bits")


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not in ``ids``; only rows that may be hit are shuffled, null ids stay."""
    marked = maybe_in(rows, id_col, ids, id_col, "_may_hit")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    sure = marked.where("not _may_hit").select(*columns)
    rest = marked.where("_may_hit").select(*columns).join(ids.select(id_col).distinct(), id_col, "left_anti")
    return sure.unionByName(rest)
