"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
CORE = [n for m in entry.catalog.MODULES for n in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.6g}")
    return v.isoformat()[:19] if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(repr(tuple(norm(r[i]) for i in at)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
