import json

import pytest
from pyspark.sql import functions as F

from arborlake.extract import structure
from arborlake.extract.rules import ENDINGS, RULES
from arborlake.graph import Graph
from arborlake.plans import tools
from arborlake.sinks import writers
from arborlake.sources import files, graphs
from arborlake.streaming import changes

CODE = {
    "a/app.py": "import os\nfrom lib import x\n\nclass App(Base, Mixin):\n    def run(self):\n        return helper(1)\n\ndef helper(n):\n    return n\n",
    "b/Main.java": "import java.util.List;\npublic class Main extends Base implements Runnable, Closeable {\n    public void run() {\n        if (true) {\n            stop();\n        }\n    }\n    private void stop() {\n    }\n}\n",
    "c/lib.rs": "use std::io;\npub struct Point { x: i32 }\nimpl Shape for Point {}\npub fn area() -> i32 { 1 }\n",
    "d/s.sql": "CREATE TABLE users (id int);\nCREATE TABLE t (u int REFERENCES users(id));\n",
    "node_modules/x.js": "class Hidden {}", ".ssh/key.py": "class Secret: pass", "run": "#!/usr/bin/env python3\nprint(1)\n", "notes.md": "# Title\nsee [x](y.md)\n", "skip/z.py": "class Z: pass\n",
}


def folder(tmp_path):
    for name, body in CODE.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(tmp_path)


def test_scan_and_classify(spark, tmp_path):
    found = files.scan(spark, folder(tmp_path), ["skip/", "*.tmp"])
    assert {r["relative_path"]: r["file_type"] for r in found.collect()} == {"a/app.py": "code", "b/Main.java": "code", "c/lib.rs": "code", "d/s.sql": "code", "run": "code", "notes.md": "document"}
    assert {r["file_type"]: r["files"] for r in files.summary(found).collect()} == {"code": 5, "document": 1}


def test_ignore_patterns(spark):
    rows = spark.createDataFrame([("a/b.log",), ("keep.log",), ("build/x.py",), ("src/build/y.py",), ("docs/a/b/c.md",)], "p string")
    got = [r[0] for r in rows.select(files.ignored(F.col("p"), ["*.log", "!keep.log", "/build/", "docs/**/c.md"])).collect()]
    assert got == [True, False, True, False, True]


def test_extraction(spark, tmp_path):
    g = tools.build(spark, folder(tmp_path), ["skip/"])
    edges = {(r["source"], r["relation"], r["target"]) for r in g.edges.collect()}
    for want in [("a_app_py", "contains", "a_app_py_app"), ("a_app_py_app", "inherits", "base"), ("a_app_py_app", "inherits", "mixin"), ("a_app_py_app", "method", "a_app_py_run"), ("a_app_py", "imports_from", "lib"),
                 ("b_main_java_main", "implements", "runnable"), ("b_main_java_main", "implements", "closeable"), ("b_main_java_main", "inherits", "base"), ("c_lib_rs", "contains", "c_lib_rs_point"), ("d_s_sql", "references", "users")]:
        assert want in edges
    assert g.nodes.where("id = 'base'").first()["source_file"] == "" and g.nodes.where("community is null").count() == 0


def test_every_language_has_rules():
    assert set(ENDINGS.values()) <= set(RULES) and len(RULES) >= 40


def test_outline_and_methods(spark, tmp_path):
    f = files.scan(spark, folder(tmp_path)).select(F.col("relative_path").alias("path"), "content")
    assert [r["name"] for r in tools.outline(f, "b/Main.java").collect()] == ["Main", "run", "stop"]
    assert [r["line"] for r in tools.read_method(f, "b/Main.java", "ru").collect()] == [3, 4, 5, 6, 7]
    assert [r["name"] for r in tools.read_with_callees(f, "b/Main.java", "run").collect()] == ["run", "stop"]
    assert tools.find_usages(f, "helper").count() == 2
    assert [r["text"] for r in tools.read(f, "c/lib.rs", 2, 2).collect()] == ["pub struct Point { x: i32 }"]


def test_node_link_round_trip(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A", "extra": 1}, {"id": ""}, 7, {"name": "b"}], "edges": [{"from": "a", "to": {"id": "b"}, "type": "uses", "context": "call"}, {"source": "a"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = graphs.read_node_link(spark, str(tmp_path / "g.json"))
    assert not g.directed and sorted(r["id"] for r in g.nodes.collect()) == ["a", "b"]
    assert [tuple(r) for r in g.edges.select("source", "target", "relation", "context").collect()] == [("a", "b", "uses", "call")]
    writers.write(writers.node_link(g), str(tmp_path / "out"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    back = json.loads("".join(r["text"] for r in writers.node_link(g).orderBy("part", "place").collect()))
    assert '"directed":true' in text and [x["id"] for x in back["nodes"] if x] == ["a", "b"] and back["links"][1]["context"] == "call"


def test_other_sinks(spark):
    n = spark.createDataFrame([("a", "A's <x>", "code", "f/a.py", 1, 0), ("b", "B", "code", "f/b.py", 1, 1), ("c", "C", "code", "c.py", 2, 2)], "id string, label string, file_type string, source_file string, community long, ord long")
    e = spark.createDataFrame([("a", "b", "calls", "EXTRACTED", None, 1.0), ("b", "c", "uses", "AMBIGUOUS", None, 1.0)], "source string, target string, relation string, confidence string, context string, weight double")
    g = Graph(n, e)
    import xml.etree.ElementTree as ET

    whole = lambda df: "\n".join(r["text"] for r in df.orderBy("part", "place").collect())
    assert len(ET.fromstring(whole(writers.graphml(g)).split("\n", 1)[1]).findall(".//{*}edge")) == 2
    ET.fromstring(whole(writers.svg(g)))
    assert "A\\'s" in whole(writers.cypher(g)) and "&lt;x&gt;" in whole(writers.html_list(g))
    assert "flowchart" in whole(writers.flowchart(g, 1)) and "## Communities" in whole(writers.report(g))
    assert {r["path"] for r in writers.wiki(g).select("path").distinct().collect()} == {"index.md", "A's -x-.md", "C.md"}
    assert writers.god_article(g, "b").count() == 2


def test_symbol_index(spark):
    occ = spark.createDataFrame([("f", "p#A", "A", "class", 0), ("g", "p#B", "", "class", 4)], "file string, symbol string, display_name string, kind string, line int")
    rel = spark.createDataFrame([("g", "p#B", "p#A", True, False, False, True), ("g", "p#B", "q#Z", False, False, False, True)], "file string, symbol string, target string, is_implementation boolean, is_type_definition boolean, is_definition boolean, is_reference boolean")
    g = graphs.symbol_index(occ, rel)
    assert sorted(r["relation"] for r in g.edges.collect()) == ["scip_impl", "scip_ref"] and g.nodes.count() == 3
    assert g.nodes.where("source_file = ''").first()["label"] == "q#Z" and g.nodes.where("label = 'B'").first()["source_location"] == "L5"


def test_merging_repositories(spark):
    n = spark.createDataFrame([("a", "A", "code", "a.py", 0)], "id string, label string, file_type string, source_file string, ord long")
    e = spark.createDataFrame([("a", "a", "calls")], "source string, target string, relation string")
    one = Graph(n, e)
    manifest = graphs.read_manifest(spark, "/nowhere/at/all.json")
    merged, changed = graphs.add_to_merged(Graph(n.limit(0), e.limit(0)), one, "r", manifest, "h")
    assert changed and [r["id"] for r in merged.nodes.collect()] == ["r::a"]
    known = spark.createDataFrame([("r", "h")], "tag string, source_hash string")
    assert graphs.add_to_merged(merged, one, "r", known, "h")[1] is False
    again, _ = graphs.add_to_merged(merged, one, "r", known, "other")
    assert again.nodes.count() == 1 and again.edges.count() == 1


def test_model_answers(spark):
    rows = spark.createDataFrame([("p", '```json\n{"nodes":[{"id":"x"}],"edges":[{"source":"x","target":"y"}]}\n```'), ("q", "nothing")], "path string, answer string")
    got = graphs.model_fragments(rows).collect()
    assert len(got) == 1 and got[0]["nodes"][0]["file_type"] == "llm" and got[0]["edges"][0]["confidence"] == "high"


def test_export_chains(spark):
    from arborlake.operators.joins import export_closure

    exports = spark.createDataFrame([("m", "f", None, None), ("n", "g", "m", "f"), ("p", "h", "q", "h"), ("q", "h", "p", "h")], "module string, name string, from_module string, from_name string")
    stars = spark.createDataFrame([("o", "n")], "module string, from_module string")
    got = {(r["module"], r["name"]): (r["origin"], r["origin_name"]) for r in export_closure(exports, stars).collect()}
    assert got == {("m", "f"): ("m", "f"), ("n", "g"): ("m", "f"), ("o", "g"): ("m", "f")}


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string").select("path", F.sha2("content", 256).alias("hash"))
    assert {r["path"]: r["state"] for r in changes.content_delta(now, old).collect()} == {"a": "same", "b": "changed", "c": "added", "d": "removed"}
    log = spark.createDataFrame([("2024-01-01 10:00:00", "t"), ("2024-01-02 10:00:00", "t")], "ts string, tool string").withColumn("ts", F.col("ts").cast("timestamp"))
    done, queued = changes.closed_days(log, "2024-01-02")
    assert done.first()["calls"] == 1 and queued.count() == 1
    queue = spark.createDataFrame([(i, "x" * 9) for i in range(10)], "ord long, line string")
    assert sorted(r["ord"] for r in changes.trimmed(queue, 30).collect()) == [7, 8, 9]


def test_structure_language(spark):
    rows = spark.createDataFrame([("a/package.json",), ("x.kt",), ("none",)], "p string")
    assert [r[0] for r in rows.select(structure.language(F.col("p"))).collect()] == ["json_package", "kotlin", None]


def test_links_and_paths_outside(tmp_path):
    from arborlake.sources.files import has_linked_folders, inside

    base, other = tmp_path / "base", tmp_path / "other"
    base.mkdir()
    other.mkdir()
    (base / "a.py").write_text("x")
    assert not has_linked_folders(str(base))
    (base / "file").symlink_to(base / "a.py")
    (base / "broken").symlink_to(tmp_path / "none")
    assert not has_linked_folders(str(base))
    (base / "folder").symlink_to(other)
    assert has_linked_folders(str(base))
    assert not has_linked_folders(str(tmp_path / "none"))
    assert inside(str(base / "a.py"), str(base)).endswith("a.py")
    for bad in ("folder", "../other"):
        with pytest.raises(ValueError):
            inside(str(base / bad), str(base))
    with pytest.raises(FileNotFoundError):
        inside(str(base / "none"), str(base))
