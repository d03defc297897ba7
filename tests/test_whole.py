"""The whole job of operators that were cut or registered over a part of their input, against brute force."""

import random
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from arborlake.functions import text, vectors
from arborlake.graph import Graph, table, trade_graph
from arborlake.operators import aggregates, analytics, joins, search, sets
from arborlake.plans import catalogue
from arborlake.streaming import changes

DATA = "/root/testdata/sf0.001"


def test_pairs_and_batches_of_whole_tables(spark):
    keys = catalogue.QUERIES["jaro_winkler_pairs"](spark, DATA).agg(F.max("b")).first()[0]
    assert keys >= 60
    newest = table(spark, DATA, "events").agg(F.max("ts")).first()[0]
    last = catalogue.QUERIES["quiet_batches"](spark, DATA).agg(F.max("first_ts")).first()[0]
    assert (newest - last).total_seconds() < 86400


def test_batches_need_no_task_for_all_events(spark):
    """Runs over blocks of a few gaps, ties at exactly the gap and empty blocks, against one walk in order of time."""
    rng = random.Random(4)
    times, at = [], -50_000_000
    for step in (3_000_000, 700_000, 9_000_000, 200_000):
        for _ in range(120):
            at += rng.choice([0, rng.randrange(step), step // 3, 1_000_000])
            times.append(at)
        at += rng.choice([1_000_000, 40_000_000])
    rows = [(t, rng.choice(["a", "b", "c", None])) for t in times]
    want: list[tuple[int, set]] = []
    for i, (t, path) in enumerate(rows):
        if not i or t - rows[i - 1][0] >= 1_000_000:
            want.append((t, set()))
        want[-1][1].add(path)
    want = [(t, sorted(p - {None})) for t, p in want]
    events = spark.createDataFrame([*rows, (None, "d")], "us long, path string").select(F.timestamp_micros("us").alias("ts"), "path")
    for cells in (2, 3, 16_384):
        found = changes._batches_of_table(events, "1 second", cells)
        assert sorted((r[0], r[1]) for r in found.select(F.unix_micros("first_ts"), "paths").collect()) == want
    for frame in (events, events.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "path"), events.limit(0)):
        found = changes.quiet_batches(frame, "1 second")
        assert found.schema["first_ts"].dataType == frame.schema["ts"].dataType
        assert found.count() == (len(want) if frame.count() else 0)
        assert "session_window" not in found._jdf.queryExecution().toString()


def test_whole_lists_are_fused(spark):
    first = [(i, float(i * 7919 % 1501)) for i in range(1500)]
    second = [(i, float(i % 10)) for i in range(700, 1400)]
    want: dict[int, float] = {}
    for scores in (first, second):
        for place, (i, _) in enumerate(sorted(scores, key=lambda x: (-x[1], x[0]))):
            want[i] = want.get(i, 0.0) + 1 / (61 + place)
    got = search.fused(*[spark.createDataFrame(x, "id long, score double") for x in (first, second)]).collect()
    assert {r["id"]: r["score"] for r in got} == {i: round(s, 10) for i, s in want.items()}


def test_fuzzy_duplicates_of_hot_files(spark):
    rows = [(f"n{i}", f"Customer#{i * i:06d}" if i % 3 else f"other {i}", f"f{i % 2}", i % 4, i) for i in range(60)]
    top = list(range(60))
    for (i, a), (j, b) in combinations(enumerate(rows), 2):
        x, y = a[1].lower(), b[1].lower()
        variant = x != y and (x.startswith(y) or y.startswith(x))
        if a[2] == b[2] and not variant and min(1.0, vectors.jaro_winkler_of(x, y) + 0.05 * (a[3] == b[3])) > 0.97:
            old, new = max(top[i], top[j]), min(top[i], top[j])
            top = [new if t == old else t for t in top]
    want = {f"n{i}": f"n{t}" for i, t in enumerate(top) if i != t}
    nodes = spark.createDataFrame(rows, "id string, label string, source_file string, community long, ord long")
    for tile in (4, 512):
        got = {r["id"]: r["first_id"] for r in analytics.fuzzy_duplicates(nodes, 0.97, tile).collect()}
        assert want and got == want


def test_fuzzy_duplicates_compare_what_is_not_linked_yet(spark):
    """Labels by the thousand that link in their order take no comparison of all pairs."""
    rows = [(f"n{i}", f"Customer#{i:09d}", "f", i % 2, i) for i in range(3000)] + [(f"m{i}", "Customer#000000007", "f", 3, 9000 + i) for i in range(3000)]
    nodes = spark.createDataFrame(rows, "id string, label string, source_file string, community long, ord long")
    calls, score = spark.sparkContext.accumulator(0), vectors.jaro_winkler

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([vectors.jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")

    vectors.jaro_winkler = counted
    try:
        got = {r["id"]: r["first_id"] for r in analytics.fuzzy_duplicates(nodes).collect()}
    finally:
        vectors.jaro_winkler = score
    assert got == {r[0]: "n0" for r in rows[1:]}
    assert calls.value < 30 * len(rows)


def test_diagnostics_deal_edges_to_tasks_by_their_number(spark):
    """Pairs go to tasks of a size, not to as many as adaptive execution leaves; the figures are those of plain counting."""
    rng = random.Random(11)
    names = ["a", "b", "c", "d", "e", "gone", "", None]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["calls", "uses", None])) for _ in range(200)] + [("f", "f", "x"), ("f", "g", "x"), ("g", "f", "y")]
    for known in ("abcdefg", "abcdefg gone"):
        ids = {*known.split()[0], *known.split()[1:]}
        missing = [e for e in edges if not e[0] or not e[1]]
        valid = [e for e in edges if e[0] in ids and e[1] in ids]
        pairs = {e[:2] for e in valid}
        flat = {tuple(sorted(p)) for p in pairs}
        variants = sum(len({r for a, b, r in valid if (a, b) == p and r}) > 1 for p in pairs)
        want = [len(edges), len(missing), len(edges) - len(missing) - len(valid), sum(a == b for a, b, _ in valid), len(valid)]
        want += [len(pairs), len(valid) - len(pairs), variants, len(flat), len(valid) - len(flat)]
        nodes = spark.createDataFrame([(i,) for i in [*sorted(ids), "a", "", None]], "id string")
        got = aggregates.edge_diagnostics(Graph(nodes, spark.createDataFrame(edges, "source string, target string, relation string")))
        assert list(got.first()) == want
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    none = Graph(nodes, spark.createDataFrame([], "source string, target string, relation string"))
    assert list(aggregates.edge_diagnostics(none).first()) == [0] * 10
    assert "REPARTITION_BY_NUM" in trade_graph(spark, DATA).edges._jdf.queryExecution().toString()


def test_moved_edges_are_dealt_by_their_number(spark):
    """Edges of a hub are spread over the tasks, and the plan keeps the number of tasks that was asked for."""
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(40)}", "hub" if i % 2 else f"n{rng.randrange(40)}", rng.choice(["calls", "uses", None])) for i in range(300)] + [("n1", None, "x"), (None, "hub", "x")]
    names = {f"n{i}": f"n{i % 7}" for i in range(30)} | {"hub": "n3"}
    want = {(names.get(a, a), names.get(b, b), r) for a, b, r in edges}
    frame = spark.createDataFrame(edges, "source string, target string, relation string")
    pairs = spark.createDataFrame([*names.items()], "id string, first_id string")
    for each in (20, 10**6):
        got = sets.moved(frame, pairs, each)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        plan = got._jdf.queryExecution().toString()
        assert plan.count("REPARTITION_BY_NUM") >= 4 and ("__part" in plan) == (each == 20)


def test_packing_holds_no_group_in_a_list(spark):
    sizes = [(i % 3, i, i * 7919 % 23 + (4000 if i % 500 == 0 else 0)) for i in range(6000)]
    want, state = {}, {}
    for group, i, n in sizes:
        bin_, used = state.get(group, (0, 0))
        state[group] = (bin_ + 1, n) if used and used + n > 100 else (bin_, used + n)
        want[str(i)] = state[group][0]
    units = spark.createDataFrame([(f"g{g}" if g else None, i, i, n) for g, i, n in sizes], "group string, ord long, id long, tokens long")
    packed = aggregates.packed(units, 100)
    assert {r["id"]: r["bin"] for r in packed.collect()} == want
    assert "collect_list" not in packed._jdf.queryExecution().toString()


def test_pagerank_walks_edges_of_fed_nodes_only(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"a{i}", f"b{rng.randrange(6)}") for i in range(200)] + [("b0", "b1"), ("b1", "b2"), ("b1", "b2"), ("b2", "b0"), ("b3", "c")]
    ids = sorted({x for e in edges for x in e})
    rank, out = dict.fromkeys(ids, 1 / len(ids)), {i: sum(a == i for a, _ in edges) for i in ids}
    for _ in range(7):
        lost = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / len(ids) + 0.85 * lost / len(ids) + 0.85 * sum(rank[a] / out[a] for a, b in set(edges) if b == i) for i in ids}
    seen, write = [], analytics.written
    monkeypatch.setattr(analytics, "written", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    frame = spark.createDataFrame(edges, "source string, target string")
    got = {r["id"]: r["rank"] for r in analytics.pagerank(Graph(None, frame), 0.85, 7).collect()}
    assert set(got) == set(ids) and all(abs(got[i] - rank[i]) < 1e-12 for i in ids)
    assert {df.count() for name, df in seen if name == "ranks"} == {5}


def test_export_rounds_follow_the_last_names_only(spark, monkeypatch):
    """A round may keep tables above a few rows out of the driver and takes up only what the round before found."""
    marked = []
    monkeypatch.setattr(joins, "shuffled", lambda df: marked.append(df.count()) or df, raising=False)
    chain = [("m0", "n0", None, None)] + [(f"m{i}", f"n{i}", f"m{i - 1}", f"n{i - 1}") for i in range(1, 6)]
    exports = spark.createDataFrame(chain, "module string, name string, from_module string, from_name string")
    got = joins.export_closure(exports, spark.createDataFrame([("s", "m3")], "module string, from_module string"))
    assert {tuple(r) for r in got.collect()} == {(f"m{i}", f"n{i}", "m0", "n0") for i in range(6)} | {("s", "n3", "m0", "n0")}
    assert marked[1::2][:3] == [1, 1, 1]


def test_label_queries_read_all_nodes(spark):
    kinds = {r["id"].split(":")[0] for r in catalogue.QUERIES["fuzzy_dedup"](spark, DATA).collect()}
    assert "customer" in kinds
    nodes = trade_graph(spark, DATA).nodes
    tokens = {r["id"]: r["t"] for r in nodes.select("id", text.label_tokens(F.col("label")).alias("t")).collect()}
    got = {r["id"]: r["vector"] for r in catalogue.QUERIES["label_embeddings"](spark, DATA).collect()}
    assert set(got) == set(tokens)
    for i in sorted(tokens)[::40]:
        mean = sum(vectors.token_vector(w, 32) for w in tokens[i]) / len(tokens[i])
        assert max(abs(mean / (mean @ mean) ** 0.5 - got[i])) < 1e-9


def test_structure_of_the_whole_trade_graph(spark):
    g = trade_graph(spark, DATA)
    edges = [tuple(r) for r in g.edges.select("source", "target").distinct().collect()]
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def cut(a, b):
        seen, todo = {a}, [a]
        while todo:
            n = todo.pop()
            for m in near[n] - seen:
                if {n, m} != {a, b}:
                    seen.add(m)
                    todo.append(m)
        return b not in seen

    got = {tuple(r) for r in catalogue.QUERIES["bridges"](spark, DATA).collect()}
    assert got == {e for e in edges if cut(*e)} and len(got) < len(edges)
    found = {r["id"]: r["community"] for r in catalogue.QUERIES["communities"](spark, DATA).collect()}
    assert set(found) == {r["id"] for r in g.nodes.select("id").collect()}
    assert any(found[a] == found[b] for a, b in edges if a.startswith("supplier:") and b.startswith("part:"))


def test_bridges_are_found_without_one_task_for_a_component(spark, monkeypatch):
    """However large a component is, no task may hold more than ``within`` of its edges."""
    rng = random.Random(7)
    edges = {tuple(sorted(rng.sample(range(c * 100, c * 100 + 60), 2))) for c in range(3) for _ in range(66)}
    edges |= {(n, n + 1) for n in range(400, 420)} | {(420, 410)}
    edges = [(f"n{a}", f"n{b}") for a, b in sorted(edges)]
    want = {tuple(sorted((r["u"], r["v"]))) for r in analytics._low_links(pd.DataFrame(edges, columns=["u", "v"])).to_dict("records")}
    frame = spark.createDataFrame(edges, "source string, target string")
    g = Graph(frame.select(F.explode(F.array("source", "target")).alias("id")).distinct(), frame)
    for size, rounds in ((40, 64), (10**6, 64), (40, 5)):
        if rounds > 5:
            monkeypatch.setattr(analytics, "_low_links", None)
        else:
            monkeypatch.undo()
        got = {tuple(sorted(r)) for r in analytics.bridges(g, 0, size, rounds).collect()}
        assert got == want and 0 < len(want) < len(edges)


def test_communities_read_links_a_few_at_a_time(spark):
    """A task holds ``held`` links at a time; moves are those of plain dictionaries."""
    rng = random.Random(3)
    edges = sorted((f"n{rng.randrange(c, c + 25)}", f"n{rng.randrange(c, c + 25)}", float(rng.randrange(1, 9))) for c in (0, 20, 100) for _ in range(70))
    near: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        for x, y in {(a, b), (b, a)}:
            near.setdefault(x, {})[y] = near.setdefault(x, {}).get(y, 0.0) + w
    total, degree = sum(w for _, _, w in edges), {n: sum(x.values()) for n, x in near.items()}
    own, mass = {n: n for n in near}, dict(degree)
    for _ in range(15):
        for n in sorted(near):
            links: dict[str, float] = {}
            for other, w in near[n].items():
                if other != n:
                    links[own[other]] = links.get(own[other], 0.0) + w
            gain = {c: links.get(c, 0.0) - mass[c] * degree[n] / (2 * total) for c in {*links, own[n]}}
            best = max(sorted(links), key=gain.get, default=own[n])
            if best != own[n] and gain[best] - gain[own[n]] > 1e-12:
                mass[own[n]], mass[best], own[n] = mass[own[n]] - degree[n], mass[best] + degree[n], best
    groups: dict[str, set[str]] = {}
    for n, leader in {**own, "alone": "alone"}.items():
        groups.setdefault(leader, set()).add(n)
    want = {n: i for i, g in enumerate(sorted(groups.values(), key=min)) for n in g}
    frame = spark.createDataFrame(edges, "source string, target string, weight double")
    g = Graph(spark.createDataFrame([(n,) for n in [*near, "alone"]], "id string"), frame)
    for held in (1, 1 << 20):
        assert {r["id"]: r["community"] for r in analytics.detected_communities(g, held=held).collect()} == want


def test_each_two_names_are_compared_once(spark):
    """Parts far outnumber names: comparisons are counted by an accumulator and do not grow with the parts."""
    names = ["red bolt", "red rod", "cold gear", "red bolts", None, ""]
    parts = [(k, names[k % 6]) for k in range(90)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_name string")
    want = set()
    for (a, x), (b, y) in combinations(parts, 2):
        if x is not None and y is not None:
            s, n = vectors.jaro_winkler_of(x, y), sum(x[:i] == y[:i] for i in range(1, 5))
            if (s - n * 0.1) / (1 - n * 0.1) > 0.72:
                want.add((a, b, round(s, 6)))
    calls, score = spark.sparkContext.accumulator(0), vectors.jaro_winkler

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([vectors.jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")

    vectors.jaro_winkler = counted
    try:
        got = [tuple(r) for r in catalogue._alike_parts(frame).collect()]
    finally:
        vectors.jaro_winkler = score
    assert len(got) == len(set(got)) and set(got) == want
    assert calls.value <= 4 * len(names) ** 2


def test_tokens_of_all_languages(spark):
    ids = {r["doc_id"] for r in table(spark, DATA, "documents").select("doc_id").collect()}
    for name in ("tokens_store", "tokens_search"):
        assert {r["doc_id"] for r in catalogue.QUERIES[name](spark, DATA).collect()} == ids
