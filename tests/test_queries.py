"""Every query with SQL against that SQL in DuckDB, at the smallest scale; the contract's shape; streaming."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tessera.plans import queries, relational, statements

SF = "/root/testdata/sf0.001"
EVERY = {**queries.QUERIES, **relational.QUERIES, **statements.QUERIES}
SQL = {**queries.ORACLES, **relational.ORACLES, **statements.ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if isinstance(v, decimal.Decimal) else v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(EVERY)[:: int(os.environ.get("EVERY_NTH", "1"))])
def test_query(spark, duck, name):
    df = EVERY[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 200
