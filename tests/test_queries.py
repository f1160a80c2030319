"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in TABLES.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def as_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_all_have_sql():
    own = {name for name in registry.queries() if name != "pipeline" and not name.startswith("op")}
    assert own <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, db, name):
    df = registry.queries()[name](spark, str(TABLES))
    answer = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert as_set(df.columns, df.collect()) == as_set(columns, answer.fetchall())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.count() > 1000 and "alert_id" in df.columns
