"""Every query with an oracle agrees with DuckDB at sf0.001 (rows-only queries run and return rows)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from cellcast.plans.registry import load_all

SF = os.environ.get("CELLCAST_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SLOW = {"model_two_gbt", "oof_predictions", "stack_ridge", "model_comparison"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (2, repr(round(v, 6) + 0.0))
    return (3, str(v))


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


REG = load_all()      # the training-data queries have tests of their own
QUERIES = {n: f for n, f in E.queries().items() if n in REG}
SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SLOW))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns and rows
        return
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, rows) == _rows(dcols, cur.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "demand" in df.columns
