"""Every query with an SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from check_twins import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "fake_ratio" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(
        names, result.fetchall()
    )
