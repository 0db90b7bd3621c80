"""Every query with SQL gives the SQL's rows over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from weftline.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="tables are not here")


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return columns, sorted(map(str, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, name):
    assert rows_of(QUERIES[name](spark, str(DATA)).toPandas()) == rows_of(db.execute(ORACLE_SQL[name]).df())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
