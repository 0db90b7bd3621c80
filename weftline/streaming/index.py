"""The symbol index: batch upserts by file, lookups, and a debounced change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.text import symbol_cost

DEBOUNCE = "200 milliseconds"
#: Folders that no watcher reports.
IGNORED_FOLDERS = r"(?:^|/)(?:node_modules|\.git|dist|build|\.next)(?:/|$)"


def latest_files(changes: DataFrame) -> DataFrame:
    """The last state of every file of ``changes(path, seq, op, ...)``; removed files are gone.

    Write and create keep a file, remove and rename drop it; of equal ``seq`` the stronger operation
    counts: write, create, remove, rename.
    """
    strength = F.create_map(*(F.lit(x) for pair in {"write": 4, "create": 3, "remove": 2, "rename": 1}.items() for x in pair))[F.col("op")]
    rest = [c for c in changes.columns if c != "path"]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("seq", strength)).alias("_l"))
    return last.select("path", "_l.*").where("op in ('write', 'create')")


def symbol_table(symbols: DataFrame) -> DataFrame:
    """``symbols(path, seq, pos, fqn, ...)`` by fully qualified name: the last writer wins."""
    rest = [c for c in symbols.columns if c != "fqn"]
    return symbols.groupBy("fqn").agg(F.max_by(F.struct(*rest), F.struct("seq", "path", "pos")).alias("_s")).select("fqn", "_s.*")


def upserted(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Replace the rows of changed files and drop those of removed ones; both sides keep (path, fqn) rows."""
    gone = changed.select("path").distinct()
    if removed is not None:
        gone = gone.union(removed.select("path")).distinct()
    return index.join(gone, "path", "left_anti").unionByName(changed)


def marked_dirty(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of changed files are served on, marked as stale."""
    hit = paths.select("path", F.lit(True).alias("_hit")).distinct()
    return index.join(hit, "path", "left").withColumn("dirty", F.coalesce("_hit", "dirty")).drop("_hit")


def find_symbols(index: DataFrame, condition: Column) -> DataFrame:
    return symbol_table(index).where(condition)


def token_estimates(symbols: DataFrame) -> DataFrame:
    """Tokens that a file's symbols take: ``path, tokens`` from ``symbols(path, name, parameters, return_type)``."""
    cost = symbol_cost(F.col("name"), F.col("parameters"), F.col("return_type"))
    return symbols.groupBy("path").agg(F.floor(F.sum(cost) / 4).cast("long").alias("tokens"))


def watched(changes: DataFrame) -> DataFrame:
    """Changes of source files outside ignored folders."""
    return changes.where(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx)$") & ~F.col("path").rlike(IGNORED_FOLDERS))


def debounced(changes: DataFrame, delay: str = DEBOUNCE, late: str = "0 seconds") -> DataFrame:
    """Writes and creates of a stream ``(path, op, ts)``, one row for each burst: ``path, ts, op, events``.

    A burst ends when a file is quiet for ``delay`` of event time. Works on batches too.
    """
    writes = watched(changes).where("op in ('write', 'create')").withWatermark("ts", late)
    bursts = writes.groupBy("path", F.session_window("ts", delay).alias("_w"))
    return bursts.agg(F.max("ts").alias("ts"), F.max_by("op", "ts").alias("op"), F.count("*").alias("events")).drop("_w")


def removals(changes: DataFrame) -> DataFrame:
    """Removes and renames, which act at once."""
    return watched(changes).where("op in ('remove', 'rename')").select("path", "ts", "op")


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply`` on every micro-batch of a change stream; each batch is retried until it is done."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").start()
