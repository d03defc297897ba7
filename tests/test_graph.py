"""Operators on graphs small enough to be worked out by hand."""

import random

import pytest

from arborlake.graph import Graph
from arborlake.operators import aggregates, analytics, filters, joins, search, sets, traversal, validation


def graph(spark, edges, nodes=None, directed=False):
    ids = nodes or sorted({x for e in edges for x in e[:2]})
    rows = [(i if isinstance(i, tuple) else (i, i, "code", "a.py", None)) + (k,) for k, i in enumerate(ids)]
    n = spark.createDataFrame(rows, "id string, label string, file_type string, source_file string, community long, ord long")
    full = [(*e, *("calls", "EXTRACTED", None, 1.0)[len(e) - 2 :]) for e in edges]
    return Graph(n, spark.createDataFrame(full, "source string, target string, relation string, confidence string, context string, weight double"), directed)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def test_degree_counts_parallel_edges_and_loops(spark):
    g = graph(spark, [("a", "b"), ("a", "b"), ("c", "c")])
    assert dict(ids(filters.degrees(g), "id", "degree")) == {"a": 2, "b": 2, "c": 2}


def test_god_nodes_leave_out_files_and_small_functions(spark):
    nodes = [("f", "main.py", "code", "a", None), ("g", "run()", "code", "a", None), ("h", "Big", "code", "a", None), ("i", ".x()", "code", "a", None)]
    g = graph(spark, [("f", "h"), ("f", "g"), ("i", "h"), ("f", "h")], nodes)
    assert ids(aggregates.god_nodes(g), "id") == ["h"]


def test_hubs_are_reached_but_not_passed(spark):
    g = graph(spark, [("s", "hub")] + [("hub", f"x{i}") for i in range(5)])
    seen, led = traversal.breadth_first(g, g.nodes.where("id = 's'").select("id"), 3, 5)
    assert ids(seen, "id") == ["hub", "s"] and ids(led, "to") == ["hub"]
    seen, _ = traversal.breadth_first(g, g.nodes.where("id = 'hub'").select("id"), 1, 5)
    assert seen.count() == 7


def test_all_parents_of_a_level_are_recorded(spark):
    g = graph(spark, [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")], directed=True)
    _, led = traversal.breadth_first(g, g.nodes.where("id = 's'").select("id"), 2)
    assert ids(led.where("to = 't'"), "at") == ["a", "b"]


def test_depth_first_fixes_a_node_at_its_first_visit(spark):
    g = graph(spark, [("s", "a"), ("s", "z"), ("z", "y"), ("y", "a"), ("a", "end")], directed=True)
    deep = {r["id"]: r["depth"] for r in traversal.depth_first(g, "s", 3).collect()}
    assert deep["a"] == 3 and "end" not in deep
    assert "end" in ids(traversal.breadth_first(g, g.nodes.where("id = 's'").select("id"), 3)[0], "id")


def test_paths(spark):
    g = graph(spark, [("a", "b", "calls", "EXTRACTED", None, 5.0), ("a", "c", "calls", "EXTRACTED", None, 1.0), ("c", "b", "calls", "EXTRACTED", None, 1.0), ("b", "d", "calls", "EXTRACTED", None, 1.0)], directed=True)
    assert traversal.shortest_paths(g.steps(), "a", "d").first()["path"] == ["a", "b", "d"]
    assert tuple(traversal.weighted_distances(g, "a", "d").first()) == ("d", 3.0, ["a", "c", "b", "d"])
    assert ids(traversal.simple_paths(g, "a", "d", 4), "path") == [["a", "b", "d"], ["a", "c", "b", "d"]]
    assert ids(traversal.simple_paths(g, "a", "d", 3), "path") == [["a", "b", "d"]]
    assert traversal.shortest_paths(g.steps(), "d", "a").count() == 0


def test_blast_radius_follows_the_flag(spark):
    edges = [("a", "b"), ("c", "a")]
    assert ids(traversal.blast_radius(graph(spark, edges), "a"), "id") == ["b", "c"]
    assert ids(traversal.blast_radius(graph(spark, edges, directed=True), "a"), "id") == ["b"]


def test_affected_walks_backwards_over_impact_relations(spark):
    g = graph(spark, [("x", "core", "imports"), ("y", "x", "calls"), ("z", "core", "contains"), ("w", "core", "uses"), ("w", "core", "calls")])
    assert ids(traversal.affected(g, "core"), "id", "depth", "via") == [("w", 1, "calls"), ("x", 1, "imports"), ("y", 2, "calls")]


def test_pagerank_sums_to_one_and_leaks_with_parallel_edges(spark):
    total = lambda edges: analytics.pagerank(graph(spark, edges), iterations=5).agg({"rank": "sum"}).first()[0]
    assert total([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == pytest.approx(1)
    assert total([("a", "b"), ("a", "b"), ("b", "a")]) < 0.99


def test_components_and_cycles(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("e", "g")], directed=True)
    assert dict(ids(analytics.strong_components(g), "id", "component")) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert ids(analytics.cycles(g), "members") == [["a", "b", "c"], ["d", "e"]]
    assert analytics.has_cycle(graph(spark, [("f", "f")], directed=True))
    assert not analytics.has_cycle(graph(spark, [("a", "b"), ("a", "c"), ("b", "c")], directed=True))


def test_random_components_and_bridges(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(48)]
    nodes = sorted({x for e in edges for x in e})

    def reach(adjacent, a):
        seen, todo = {a}, [a]
        while todo:
            for n in adjacent.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want = {n: min(m for m in nodes if m in reach(out, n) and n in reach(out, m)) for n in nodes}
    g = graph(spark, edges, directed=True)
    assert dict(ids(analytics.strong_components(g), "id", "component")) == want
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}

    def parts(ps):
        near = {}
        for a, b in ps:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        return len({min(reach(near, n)) for n in nodes})

    cut = {p for p in pairs if parts(pairs - {p}) > parts(pairs)}
    assert {tuple(sorted(r)) for r in ids(analytics.bridges(g), "source", "target")} == cut


def test_a_doubled_edge_is_still_a_bridge(spark):
    assert ids(analytics.bridges(graph(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")])), "source", "target") == [("a", "b")]


def test_topological_levels_leave_cycles_out(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], directed=True)
    assert dict(ids(analytics.topological_levels(g), "id", "level")) == {"a": 0, "b": 1, "c": 2}


def test_communities_part_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    g = graph(spark, clique("a") + clique("b") + [("a0", "b0")])
    found = dict(ids(analytics.detected_communities(g), "id", "community"))
    assert len({found[f"a{i}"] for i in range(5)}) == 1 and found["a1"] != found["b1"] and len(found) == 10
    alone = graph(spark, [("a", "b")]).with_edges(g.edges.limit(0))
    assert {c for _, c in ids(analytics.detected_communities(alone), "id", "community")} == {0}


def test_diff_keeps_repeats_and_is_empty_on_itself(spark):
    a = graph(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    b = graph(spark, [("b", "c")])
    assert joins.edges_only_in(a.edges, a.edges).count() == 0
    assert joins.edges_only_in(a.edges, b.edges).count() == 2


def test_context_filter_drops_edges_without_context(spark):
    g = graph(spark, [("a", "b", "calls", "EXTRACTED", "call"), ("b", "c", "calls", "EXTRACTED", None)])
    assert filters.with_contexts(g, ["call"]).edges.count() == 1
    assert filters.with_contexts(g, []).edges.count() == 2
    assert filters.resolved_contexts("who imports this module") == (["import"], "heuristic")
    assert filters.resolved_contexts("anything", [" Params ", "param"]) == (["parameter_type"], "explicit")


def test_merges(spark):
    a, b = graph(spark, [("a", "b")]), graph(spark, [("a", "b"), ("b", "c")])
    assert sets.merged(a, b).edges.count() == 2 and sets.concatenated(a, b).edges.count() == 3
    both = sets.concatenated(sets.prefixed(a, "x"), sets.prefixed(b, "y"))
    assert ids(filters.without_repo(both, "x").nodes, "id") == ["y::a", "y::b", "y::c"]


def test_sanitised_folds_sentences_into_rationale(spark):
    nodes = [("n", "Node", "code", "a", None), ("w", "This is why the node does what it does, always.", "rationale", "a", None), ("c", "idea", "concept", "a", None)]
    g = graph(spark, [("w", "n", "rationale_for"), ("c", "n", "references"), ("n", "n", "calls")], nodes)
    hyper = spark.createDataFrame([("h", ["n", "w"]), ("k", ["n", "x", "c"])], "id string, nodes array<string>")
    clean, left = sets.sanitised(g, hyper)
    assert ids(clean.nodes, "id") == ["n"] and clean.nodes.first()["rationale"].startswith("This is why") and clean.edges.count() == 1
    assert ids(left, "id", "nodes") == [("k", ["n", "x"])]


def test_fuzzy_duplicates_respect_files_and_variants(spark):
    row = lambda i, label, file="f": (i, label, "code", file, None)
    nodes = [row("1", "process_payment_request"), row("2", "process_payment_requests"), row("3", "process_payment_reqeust"), row("4", "process_payment_request", "g"), row("5", "unrelated")]
    got = ids(analytics.fuzzy_duplicates(graph(spark, [("1", "2")], nodes).nodes, 0.97), "id", "first_id")
    assert ("3", "1") in got and not any(a == "4" for a, _ in got) and not any(a == "5" for a, _ in got)


def test_validation(spark):
    g = graph(spark, [("a", "missing"), ("a", "b", "calls", "SURE")], ["a", "b"])
    assert ids(validation.edge_errors(g), "problem") == ["dangling target", "unknown confidence"]
    with pytest.raises(ValueError, match="dangling target"):
        validation.assert_valid(g)
    assert ids(validation.bad_ids(graph(spark, [("a/b", "ok")]).nodes), "id") == ["a/b"]


def test_seeds_cut_at_the_gap_but_keep_the_first(spark):
    s = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 1.0)], "id string, score double")
    assert ids(search.seeds(s, 3, 0.2), "id") == ["a", "b"]
    assert ids(search.seeds(s.where("id = 'c'"), 3, 0.2), "id") == ["c"]


def test_fusion_adds_reciprocal_places(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double")
    got = dict(ids(search.fused(a, a.where("id = 'y'")), "id", "score"))
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(1 / 62 + 1 / 61)


def test_seed_resolution_needs_a_single_match(spark):
    nodes = [("1", "Alpha", "code", "x.py", None), ("2", "Beta", "code", "y.py", None), ("3", "beta two", "code", "z.py", None)]
    g = graph(spark, [("1", "2")], nodes)
    pick = lambda name: search.resolved_seed(g.nodes, name).first()["id"]
    assert (pick("3"), pick("alpha"), pick("y.py"), pick("two"), pick("a")) == ("3", "1", "2", "3", None)


def test_packing_starts_a_new_bin_where_the_next_does_not_fit(spark):
    rows = spark.createDataFrame([("g", i, f"u{i}", t) for i, t in enumerate([5, 5, 5, 20, 1])], "group string, ord long, id string, tokens long")
    assert [b for _, b in sorted(ids(aggregates.packed(rows, 10), "id", "bin"))] == [0, 0, 1, 2, 3]
