"""Every query with SQL gives the rows that DuckDB gives for it over the same tables."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
PLAIN = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (bool, str, bytes)) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", PLAIN)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(entry.oracle_sql()[name])
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
