"""python -m arborlake.cli COMMAND: graphs in node-link files, from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.graph import Graph
from arborlake.operators import aggregates, analytics, joins, sets, traversal, validation
from arborlake.plans import tools
from arborlake.session import local_session
from arborlake.sinks import writers
from arborlake.sources.graphs import read_node_link

SINKS = {"json": writers.node_link, "cypher": writers.cypher, "graphml": writers.graphml, "svg": writers.svg, "html": writers.html_list, "wiki": writers.wiki, "report": writers.report}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arborlake")
    add = top.add_subparsers(dest="command", required=True).add_parser

    def command(name: str, *args: str, graph: bool = True, **options: object) -> None:
        p = add(name)
        if graph:
            p.add_argument("graph")
        for a in args:
            p.add_argument(a)
        for k, default in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", type=type(default), default=default)

    command("build", "root", "out", graph=False)
    command("stats")
    command("analyze", top=10)
    command("cluster", resolution=1.0)
    command("query", "question", depth=2, budget=2000)
    command("path", "source", "target", hops=32)
    command("explain", "node")
    command("affected", "node", depth=2)
    command("risk", top=20)
    command("tree", most=50)
    command("validate")
    command("diagnose")
    command("diff", "other")
    command("merge", "other", "out")
    command("export", "format", "out")
    command("pagerank", top=10, iterations=100)
    command("resolve", "question", top=3)
    return top


def run(args: argparse.Namespace) -> DataFrame | None:
    """The command's result, or None where it writes files."""
    spark = local_session()
    if args.command == "build":
        writers.write(writers.node_link(tools.build(spark, args.root)), args.out)
        return None
    g: Graph = read_node_link(spark, args.graph)
    if args.command == "merge":
        writers.write(writers.node_link(sets.merged(g, read_node_link(spark, args.other))), args.out)
        return None
    if args.command == "export":
        writers.write(SINKS[args.format](g), args.out)
        return None
    return {
        "stats": lambda: aggregates.detailed_stats(g),
        "analyze": lambda: aggregates.god_nodes(g, args.top),
        "cluster": lambda: analytics.detected_communities(g, args.resolution).groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community"),
        "query": lambda: tools.query_graph(g, args.question, args.depth, args.budget),
        "path": lambda: traversal.shortest_paths(g.steps(), args.source, args.target, args.hops),
        "explain": lambda: joins.neighbours(g, args.node),
        "affected": lambda: tools.affected(g, args.node, args.depth),
        "risk": lambda: aggregates.node_risk(g).orderBy(F.desc("score"), "id").limit(args.top),
        "tree": lambda: writers.tree(g.nodes, args.most).orderBy("folder", "depth", "kind", "name"),
        "validate": lambda: validation.node_errors(g.nodes).select("id", "problem").union(validation.edge_errors(g).select("source", "problem")),
        "diagnose": lambda: aggregates.edge_diagnostics(g),
        "diff": lambda: tools.diff(g, read_node_link(spark, args.other)),
        "pagerank": lambda: tools.pagerank(g, args.top, iterations=args.iterations),
        "resolve": lambda: tools.resolve(g, args.question, args.top),
    }[args.command]()


def main(argv: list[str] | None = None) -> int:
    found = run(parser().parse_args(argv))
    if found is not None:
        found.show(200, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
