import duckdb
import pandas as pd
import pytest

from arborlake.llm import mixing

ROWS = [
    (1, "a b c", None, "s"), (2, "", None, "s"), (3, None, None, "t"), (4, "x " * 50, None, "t"), (5, "one\ttwo\nthree", None, None),
    (None, "null id here", None, "s"), (7, "q w e r", None, "Z"), (7, "q w e r", None, "Z"), (8, "w\x1fv \x0b u\x00", None, "é"), (9, "long " * 3000, None, "u"),
]


def test_matches_sql(spark, documents):
    docs = documents(ROWS)
    got = mixing.op8(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().assign(doc_id=lambda p: p.doc_id.astype("Int64")))
    want = con.execute(mixing.ORACLE).df()
    key = ["doc_id", "size", "source_size", "taken"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a[key].astype(float), b[key].astype(float))
    assert (a.target - b.target).abs().max() < 1e-6


def test_targets_and_limits(spark, documents):
    got = mixing.mix(documents(ROWS)).toPandas()
    assert len(got) == len(ROWS)
    assert (got.taken <= 3 * got["size"]).all()
    sums = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() <= 1).all()
    assert got.position.dropna().between(0, 1).all()


def test_documents_of_the_mix(spark, documents):
    docs = documents(ROWS)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.toPandas().text.map(lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t))).sum()
    assert words == mixing.mix(docs).toPandas().taken.sum()


def test_empty(spark, documents):
    assert mixing.op8(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).count() == 0


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(100.0, s, y) for s in (-0.5, 0.0, 0.5) for y in (0, 25, 50, 100)], "target double, slope double, y long")
    for r in row.select("slope", "y", mixing.training_time(F.col("y")).alias("t")).collect():
        assert r["t"] + r["slope"] * (r["t"] ** 2 - r["t"]) == pytest.approx(r["y"] / 100, abs=1e-8)
