"""Every registered query that has SQL equals DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from lodestone.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(frame, columns):
    values = frame[columns].astype(object).values.tolist()
    return sorted([("null" if x is None or x != x else repr(round(float(x), 9)) if isinstance(x, float) else str(x)) for x in row] for row in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert normal(got, columns) == normal(want, columns)
    else:
        assert len(got)


def test_sorted_word_count_whole_is_whole(spark):
    got = catalog.QUERIES["sorted_word_count_whole"](spark, SF).collect()
    assert len(got) > 50 and [(r.n, r.word) for r in got] == sorted((r.n, r.word) for r in got)
