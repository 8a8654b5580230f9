"""Each registered query of the sequence operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from helixspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    out = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert cols == sorted(names)
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in out.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
