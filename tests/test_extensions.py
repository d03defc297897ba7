import json

import pytest

from arborlake import cli
from arborlake.graph import Graph
from arborlake.plans import extensions, tools


def test_chunks_that_are_too_long_are_halved():
    def ask(texts):
        if len(texts) > 2:
            raise RuntimeError("Prompt is too long")
        return {"nodes": [{"id": t} for t in texts]}

    got = extensions.asked(list("abcdefg"), ask)
    assert [n["id"] for a in got for n in a["nodes"]] == list("abcdefg")
    assert extensions.asked(["a"], lambda t: {"nodes": []}) == []
    with pytest.raises(ValueError):
        extensions.asked(["a"], lambda t: (_ for _ in ()).throw(ValueError("other")))


def test_registered_extractors_go_first(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    pass\n"), ("b.zz", "anything")], "path string, content string")

    def extract(rows):
        nodes = rows.selectExpr("path as id", "'Z' as label", "'code' as file_type", "path as source_file", "cast(null as string) as source_location", "cast(null as bigint) as community", "0L as ord")
        return Graph(nodes, spark.createDataFrame([], "source string, target string, relation string"))

    registry = extensions.Extractors()
    registry.register([".zz"], extract)
    assert {r["id"] for r in registry.run(files).nodes.collect()} == {"a_py", "a_py_a", "b.zz"}


def test_embedders(spark):
    nodes = spark.createDataFrame([("a", "getUser"), ("b", None)], "id string, label string")
    own = {r["id"]: r["vector"] for r in extensions.embedded(nodes, lambda labels: [[float(len(x))] for x in labels]).collect()}
    assert own == {"a": [7.0], "b": [0.0]}
    assert len(extensions.embedded(nodes, width=8).where("id = 'a'").first()["vector"]) == 8


def test_command_line(spark, tmp_path, capsys):
    doc = {"nodes": [{"id": x, "label": x.upper(), "source_file": f"s/{x}.py"} for x in "abc"], "links": [{"source": "a", "target": "b", "relation": "calls"}, {"source": "b", "target": "c", "relation": "imports"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    path = str(tmp_path / "g.json")
    run = lambda *a: cli.run(cli.parser().parse_args(a))
    assert run("path", path, "a", "c").first()["hops"] == 2
    assert {r["id"] for r in run("affected", path, "c").collect()} == {"a", "b"}
    assert run("validate", path).count() == 0 and run("diff", path, path).count() == 0
    assert run("analyze", path).first()["id"] == "b" and run("tree", path).count() == 7
    assert run("export", path, "graphml", str(tmp_path / "out")) is None and run("risk", path).count() == 3


def test_there_are_33_tools():
    assert len(tools.TOOLS) == 33
