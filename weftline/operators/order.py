"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.kept import kept

#: An id of ``monotonically_increasing_id`` has the row's place in its partition in so many bits, the partition above.
_PLACE_BITS = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Add ``name``, each row's place in the global order, from 0; equal rows are numbered as they come.

    Rows are dealt to partitions by range and sorted there; a place is the place in the partition and the number
    of rows in those before it. Only one count for each partition meets in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _PLACE_BITS).alias("_part")
    counts = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    placed = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).cast("int")).drop("_id", "_part", "_before")
