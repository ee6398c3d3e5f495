"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

from panelforge import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _plain(rows):
    rows = [tuple(float(v) if type(v).__name__ in ("Decimal", "float") else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = _plain([tuple(r[c] for c in columns) for r in df.collect()])
    if name in catalog.ORACLES:
        want = duck.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
        assert got == _plain(want)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["touch_type", "n", "mean_ret"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
