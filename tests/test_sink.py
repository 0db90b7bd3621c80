"""The durable index, checked catalogs, positions, and status of files."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weftline.functions import modules as m
from weftline.operators.order import numbered
from weftline.sources.catalog import parse_catalog, read_catalog, write_catalog
from weftline.streaming.index import follow
from weftline.streaming.sink import IndexTable

SCHEMA = "path string, op string, seq int"


def symbols_of(changed):
    """A symbol for each file; files whose change has a negative number can't be read."""
    return changed.select("path", F.concat(F.lit("S"), "seq").alias("fqn"), (F.col("seq") < 0).alias("failed"))


def state(table):
    return sorted((r.path, r.fqn, r.dirty) for r in table.rows().collect())


def test_index_over_batches(spark, tmp_path):
    table = IndexTable(spark, str(tmp_path / "index"), "path string, fqn string", 4)
    assert state(table) == [] and table.versions() == []
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    table.apply(batch(("a.ts", "create", 1), ("b.ts", "write", 2), ("c.ts", "write", 3), ("a.ts", "write", 4)), 0, symbols_of)
    assert state(table) == [("a.ts", "S4", False), ("b.ts", "S2", False), ("c.ts", "S3", False)]
    second = batch(("b.ts", "remove", 5), ("c.ts", "write", -6), ("d.ts", "create", -7))
    table.apply(second, 1, symbols_of)
    after = [("a.ts", "S4", False), ("c.ts", "S3", True)]  # a file that fails keeps its rows and is dirty; a new one that fails has none
    assert state(table) == after
    table.apply(second, 1, symbols_of)
    assert state(table) == after and table.versions() == [0, 1]
    table.apply(batch(("c.ts", "write", 8), ("a.ts", "rename", 9)), 2, symbols_of)
    assert state(table) == [("c.ts", "S8", False)]
    table.apply(spark.createDataFrame([], SCHEMA), 3, symbols_of)
    assert state(table) == [("c.ts", "S8", False)] and table.versions() == [0, 1, 2, 3]


def test_a_batch_that_dies_leaves_the_index_as_it_was(spark, tmp_path):
    table = IndexTable(spark, str(tmp_path / "index"), "path string, fqn string", 4)
    table.apply(spark.createDataFrame([("a.ts", "create", 1)], SCHEMA), 0, symbols_of)

    def dies(changed):
        return symbols_of(changed).withColumn("fqn", F.raise_error(F.lit("no disk")).cast("string"))

    changes = spark.createDataFrame([("a.ts", "write", 2), ("b.ts", "write", 3)], SCHEMA)
    with pytest.raises(Exception, match="no disk"):
        table.apply(changes, 1, dies)
    assert state(table) == [("a.ts", "S1", False)] and table.versions() == [0]
    table.apply(changes, 1, symbols_of)
    assert state(table) == [("a.ts", "S2", False), ("b.ts", "S3", False)]


def test_index_behind_a_stream(spark, tmp_path):
    source = str(tmp_path / "feed")
    spark.createDataFrame([("a.ts", "create", 1), ("b.ts", "create", 2)], SCHEMA).coalesce(1).write.parquet(source)
    table = IndexTable(spark, str(tmp_path / "index"), "path string, fqn string", 4)
    for _ in range(2):  # the second run finds nothing new
        stream = follow(spark.readStream.schema(SCHEMA).parquet(source), lambda rows, batch: table.apply(rows, batch, symbols_of), str(tmp_path / "checkpoint"))
        stream.processAllAvailable()
        stream.stop()
    assert state(table) == [("a.ts", "S1", False), ("b.ts", "S2", False)]


def catalog(**changes):
    component = {"name": "A", "import_path": "./a", "imported_names": ["A"], "category": "x"}
    return {"name": "c", "version": "1", "components": [component], "categories": [{"name": "x", "components": ["A"]}]} | changes


def test_invalid_catalogs_cannot_be_read(spark, tmp_path):
    parsed = lambda document: parse_catalog(spark.createDataFrame([(json.dumps(document),)], "value string"))
    good = parsed(catalog())
    assert [r["name"] for r in good.components.collect()] == ["A"] and good.tokens.collect() == []
    write_catalog(good, str(tmp_path / "good"))
    assert [r["name"] for r in read_catalog(spark, str(tmp_path / "good")).components.collect()] == ["A"]
    bad = parsed(catalog(name="", categories=[{"name": "x", "components": ["B"]}]))
    for rows in (bad.components, bad.tokens, bad.meta):
        with pytest.raises(Exception, match="catalog validation failed: catalog name is required; category lists an unknown component: x.B"):
            rows.collect()


def test_positions(spark):
    rows = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("v"))
    assert [r.pos for r in numbered(rows, "v").orderBy("v").collect()] == list(range(5000))
    ties = numbered(spark.range(100).select((F.col("id") % 3).alias("v")), F.desc("v")).orderBy("pos").collect()
    assert [r.pos for r in ties] == list(range(100)) and [r.v for r in ties] == sorted((r.v for r in ties), reverse=True)
    assert numbered(spark.range(0), "id").collect() == []


def test_status_of_files(spark):
    files = spark.createDataFrame([("a.ts", b"let a"), ("b.md", b"x"), ("c.ts", None), ("d.js", b"\xc3\x28")], "path string, content binary")
    seen = Observation("files")
    got = {r.path: r.failure for r in m.file_status(files, seen).collect()}
    assert got == {"a.ts": "", "b.md": "unknown language", "c.ts": "no content", "d.js": "no UTF-8"}
    assert seen.get == {"discovered": 4, "failed": 3}
