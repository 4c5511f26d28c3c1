import duckdb
import pytest

from kvspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "customer", "orders", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    at = [df.columns.index(c) for c in cols]
    assert sorted((repr(tuple(r[i] for i in at)) for r in rows)) == sorted(map(repr, got.fetchall()))


def test_crc_is_ieee(spark):
    assert spark.sql("select crc32('important')").first()[0] == __import__("zlib").crc32(b"important")


def test_byte_view_raises_on_other_kinds(spark):
    from kvspark.functions import values as V

    df = spark.range(1).select(V.typed("integer", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).alias("value"))
    with pytest.raises(Exception, match="UnexpectedValue"):
        df.select(V.byte_view()).collect()


def test_registered(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
