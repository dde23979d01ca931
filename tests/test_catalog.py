"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from heliograph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x) if not hasattr(x, "as_tuple") else float(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    rel = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)


def test_entry_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and catalog.FLAGSHIP in q
