import duckdb
import numpy as np

from arborlake.llm import embeddings, topk
from arborlake.llm.simhash import forest

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, copies long, own string, class string"
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0] + [None] * 7, 1), (904, [float("nan")] * 8, 1), (905, [float("inf")] * 8, 1), (906, [1.0] * 8, None), (907, [1.0] * 4, 1), (None, [1.0] * 8, 1)]


def vectors(n=300, seed=1):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            v = rnd.normal(size=8)
        else:
            v = np.array(rows[rnd.integers(len(rows))][1]) + rnd.normal(size=8) * rnd.choice([0, 0.05, 0.15])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rnd.integers(2))))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    return near.sum(axis=1), forest(len(rows), *np.nonzero(near))


def test_near_duplicates(spark, monkeypatch):
    rows = vectors()
    links, top = brute(rows)
    for cell, tile, fanout in ((2000, 1024, 32), (20, 7, 4), (6, 5, 2)):
        monkeypatch.setattr(embeddings, "CELL", cell)
        monkeypatch.setattr(embeddings, "TILE", tile)
        monkeypatch.setattr(embeddings, "FANOUT", fanout)
        monkeypatch.setattr(embeddings, "GROUP_ROWS", 50)
        got = {r["vec_id"]: r for r in embeddings.op1(table(spark, rows + ODD)).collect()}
        assert len(got) == len(rows) + len(ODD)
        assert [got[i]["n_links"] for i in range(len(rows))] == links.tolist()
        assert [got[i]["component_id"] for i in range(len(rows))] == top.tolist()
        assert all(got[i]["kept"] == (top[i] == i) for i in range(len(rows)))
        assert all(got[r[0]]["n_links"] == 0 for r in ODD if r[0] != 907)


def test_every_label_has_cells(spark, monkeypatch):
    """500 vectors go through k-means cells, level by level, and no linked pair is without a common cell."""
    rows = vectors(500, 4)
    classes = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "class long, vector array<float>, label int, copies long")
    for cell, levels in ((2000, 1), (20, 2)):
        monkeypatch.setattr(embeddings, "CELL", cell)
        monkeypatch.setattr(embeddings, "FANOUT", 4)
        placed = embeddings.cells(classes, float(np.sqrt(0.04))).toPandas()
        home = placed[placed.home]
        assert sorted(home["class"]) == [r[0] for r in rows] and placed.cell.nunique() >= 2 * levels
        assert cell == 2000 or placed.cell.max() > 4
        at = placed.groupby("class").cell.agg(set)
        x = np.array([r[1] for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))):
            if rows[i][2] == rows[j][2]:
                assert home.set_index("class").cell[i] in at[j]


def test_repeated_rows_and_empty(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.0, 1.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.op1(table(spark, rows)).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 0, 6)]
    assert embeddings.op1(table(spark, [])).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rows = vectors(400, 2) + [(1000, [0.25] * 8, 0), (1001, [0.25] * 8, 0)]
    df = table(spark, rows + [r for r in ODD if r[0] not in (906, 907)] + rows[:3])
    got = topk.op2(df).toPandas().sort_values(["query_id", "rank"]).values.tolist()
    con = duckdb.connect()
    con.register("embeddings", table(spark, rows).select("vec_id", "embedding").toPandas())
    want = con.execute(topk.ORACLE).df().sort_values(["query_id", "rank"]).values.tolist()
    assert got == want and len(got) == 5 * 10
    assert topk.op2(table(spark, [])).count() == 0
    assert topk.op2(table(spark, [(100, [1.0], 1)])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3e38
    rows = [(100, [big, 1.0], 0), (1, [big, 0.0], 0), (2, [-big, 5.0], 0), (3, [0.0, 2.0], 0), (4, [big, 9.0], 0), (200, [3e6, 3e6], 0), (5, [3e6, 3e6], 0)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.op2(table(spark, rows)).collect()}
    most = 2**63 - 1
    assert [got[100, k] for k in range(1, 7)] == [(1, most), (4, most), (5, most), (200, most), (3, 1024 * 2048), (2, -most - 1)]
    assert [got[200, k] for k in range(1, 5)] == [(1, most), (4, most), (5, most), (100, most)]


def test_the_index_stops_early_on_proof():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-30, 30, (5000, 4))
    x[7] = [4000, 4000, 4000, 4000]
    index = topk.ImpactIndex(np.arange(5000), x)
    for q in (np.array([500, 3, 1, 0]), np.array([-5, 7, 0, 0]), np.zeros(4, dtype=np.int64)):
        ids, score = index.search(q, 10, 3)
        full = [(-int(x[i] @ q), i) for i in range(5000) if i != 3]
        assert [(-s, i) for i, s in zip(ids.tolist(), score.tolist())] == sorted(full)[:10]
