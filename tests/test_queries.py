"""Every catalogued query with SQL against DuckDB on the smallest tables, and partitioning must not matter."""

import os

import pytest

import lodestone.queries  # noqa: F401
from lodestone import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(df):
    def cell(v):
        return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    names = sorted(df.columns)
    return sorted([tuple(str(cell(v)) for v in r) for r in df[names].astype(object).itertuples(index=False)])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["rank_intervals", "generation_stats", "byte_diversity", "patience_fold"])
def test_partitioning_does_not_matter(spark, name):
    before = rows(catalog.QUERIES[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
