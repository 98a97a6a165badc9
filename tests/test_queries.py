"""Every registered query against its DuckDB oracle (the driver's correctness gate), at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SLOW = {"learning_curve"}
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["split", "domain", "acc", "n"]


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    res = duck.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    spark_types = dict(df.dtypes)
    for c in res.description:                                # same column types as the oracle
        assert TYPES.get(spark_types[c[0]], spark_types[c[0]].upper()) == str(c[1]).upper(), c
    assert _rows(df.columns, [tuple(r) for r in got]) == _rows(cols, res.fetchall())
