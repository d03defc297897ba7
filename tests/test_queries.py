"""The registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from arborlake.plans import catalogue, columns  # noqa: F401  columns adds its queries to the catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(round(v, 8)) if isinstance(v, float) else str(v.tolist() if hasattr(v, "tolist") else v)

    return sorted(tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.SQL:
        want = sql.execute(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0 or name == "fuzzy_dedup"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
