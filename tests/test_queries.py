"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v).removesuffix(" 00:00:00")
    return float(f"{float(v):.9g}")


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, name):
    df = engine.queries()[name](spark, DATA)
    got = _rows(df.columns, df.collect())
    if name not in engine.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(engine.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == _rows(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
