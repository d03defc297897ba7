import numpy as np
import pytest

from arborlake.llm import langid, quality, toxicity

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!"), (5, "word " * 30000), (None, "no id"), (7, "same"), (7, "same")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def accuracy(scored, labels, column):
    both = scored.join(labels, "doc_id").where("held_out").select("predicted", column).toPandas()
    return (both.predicted == both[column]).mean(), len(both)


def test_quality(tables):
    docs, labels = tables
    scored = quality.op3(docs, labels)
    share, n = accuracy(scored, labels, "quality")
    assert n > 50 and share >= 0.96
    assert scored.count() == docs.count()


def test_toxicity(tables):
    docs, labels = tables
    share, n = accuracy(toxicity.op9(docs, labels), labels, "toxic")
    assert n > 50 and share >= 0.9


def test_language(tables):
    docs, _ = tables
    both = langid.op5(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both.lang == both.lang_pred).mean() >= 0.98


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_documents(spark, documents, tables, module, label):
    docs, labels = tables
    model = module.fit(docs.select("doc_id", "text"), labels)
    rows = module.score(documents(ODD), model).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    again = module.fit(docs.select("doc_id", "text").repartition(7), labels)
    assert sorted(r["score"] for r in module.score(documents(ODD), again).collect()) == pytest.approx(sorted(r["score"] for r in rows))


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, documents, module, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        model = module.fit(documents(ODD).select("doc_id", "text"), labels)
        assert module.score(documents(ODD), model).count() == len(ODD)
    assert module.score(documents([]), model).count() == 0


def test_language_of_odd_documents(spark, documents):
    rows = [(i, "the cat and the dog are here", "en") for i in range(40)] + [(100 + i, "der Hund und die Katze sind da", "de") for i in range(40)]
    model = langid.fit(documents(rows + [(500, "x", None), (501, None, "en")]).select("doc_id", "text", "lang"))
    got = [(r["lang_pred"], 0 <= r["score"] <= 1) for r in langid.predict(documents(ODD), model).collect()]
    assert [g[0] for g in got][:4] == ["und"] * 4 and all(g[1] for g in got)
    assert {r["lang_pred"] for r in langid.predict(documents([(1, "die Katze und der Hund")]), model).collect()} == {"de"}
    empty = langid.fit(documents([]).select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(documents(ODD), empty).collect()} == {"und"}


def test_isotonic_is_monotone():
    rnd = np.random.default_rng(0)
    f = rnd.normal(size=500)
    at, value = toxicity.isotonic(f, (rnd.random(500) < 1 / (1 + np.exp(-2 * f))).astype(int))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all() and value.min() >= 0 and value.max() <= 1


def test_toxic_documents_go_and_columns_stay(spark, documents, tables):
    docs, labels = tables
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_rows_of_one_margin_have_one_value():
    """5,000 clean rows and one toxic row share a margin: the contradicting label is one in 5,001 there."""
    f = np.array([-4.0] * 5001 + [4.0] * 500)
    y = np.array([0] * 5000 + [1] + [1] * 500)
    for order in (np.arange(len(f)), np.random.default_rng(2).permutation(len(f)), np.argsort(-y, kind="stable")):
        at, value = toxicity.isotonic(f[order], y[order])
        assert len(set(at.tolist())) == len(at)
        low, high = np.interp([-4.0, 4.0], at, value)
        assert low < 0.001 and high > 0.999


def test_isotonic_against_brute_force():
    rnd = np.random.default_rng(3)
    f = rnd.integers(0, 6, 60).astype(float)
    y = (rnd.random(60) < f / 6).astype(int)
    at, value = toxicity.isotonic(f, y)
    points = np.unique(f)
    size = np.array([(f == p).sum() for p in points])
    mean = np.array([y[f == p].mean() for p in points])
    block = lambda i, j: (size[i : j + 1] * mean[i : j + 1]).sum() / size[i : j + 1].sum()
    best = [max(min(block(i, j) for j in range(k, len(points))) for i in range(k + 1)) for k in range(len(points))]  # the least-squares monotone fit
    assert np.interp(points, at, value) == pytest.approx(best, abs=0.02)


def test_one_contradicting_label_rejects_nothing_else(spark, documents):
    """Clean documents that look alike have one margin; one of them labelled toxic must not carry the rest along."""
    rows = [(i, "the garden is quiet and the river is wide " * 3) for i in range(1500)] + [(2000 + i, f"you gribblesnark are a vile gribblesnark {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i >= 2000 or i in (7, 8, 9, 10, 11, 12))) for i, _ in rows], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.not_toxic(documents(rows), labels).select("doc_id").collect()}
    assert kept == set(range(1500))


def test_one_class_rejects_nothing(spark, documents):
    rows = [(i, f"text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.not_toxic(documents(rows), labels).count() == 60
