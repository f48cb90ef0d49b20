"""Every registered operator against its independent DuckDB oracle (the
driver's correctness gate), at the scale factor that the driver compares."""

import pytest

import __spark_entry__ as E
from opslens.suite import CASES
from tools.oracle_check import rows_of

from .conftest import TABLES

SF = "/root/testdata/sf0.01"

# The library's own operators; other queries of the entry module have tests of their own.
QUERIES = {name: fn for name, fn in E.queries().items() if name in CASES}
ORACLES = {name: sql for name, sql in E.oracle_sql().items() if name in CASES}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) == set(CASES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "pct" in df.columns


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "StringType": "VARCHAR", "DoubleType": "DOUBLE",
                 "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP", "DateType": "DATE", "ShortType": "SMALLINT"}


def _duck_type(f):
    t = f.dataType
    if t.typeName() == "decimal":
        return f"DECIMAL({t.precision},{t.scale})"
    return SPARK_TO_DUCK.get(type(t).__name__, str(t))


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert {f.name: _duck_type(f) for f in sdf.schema.fields} == dict(zip(rel.columns, map(str, rel.types)))
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, cur.fetchall())
