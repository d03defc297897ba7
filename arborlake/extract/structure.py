"""Graphs, outlines and method bodies from source lines, with built-in functions only: one pass over the lines of all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.extract.rules import ENDINGS, NAMES, RULES, Rule
from arborlake.functions import paths, text
from arborlake.graph import Graph
from arborlake.operators.sets import distinct_edges
from arborlake.sources.files import lines

BASES = ("inherits", "implements", "mixes_in")


def language(path: Column) -> Column:
    """The language of a file by its whole name, else its ending; null if no rules fit."""
    named = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    ended = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(named, paths.file_name(path)), F.try_element_at(ended, paths.ending(path)))


def _found(rules: list[Rule], line: Column) -> Column:
    """What one line declares: structs (kind, relation, name, bases)."""
    out = []
    for kind, relation, pattern in rules:
        name = F.regexp_extract(line, pattern, 1)
        bases = F.regexp_extract(line, pattern, 2) if relation in ("inherits", "implements") else F.lit("")
        out.append(F.when(name != "", F.struct(F.lit(kind).alias("kind"), F.lit(relation).alias("relation"), name.alias("name"), bases.alias("bases"))))
    return F.array_compact(F.array(*out))


def declarations(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """path, line, language, kind, relation, name, bases. files: path, content; ``languages`` limits the rules that are tried."""
    rows = files.withColumn("language", language(F.col("path"))).where("language is not null")
    used = {k: v for k, v in RULES.items() if not languages or k in languages}
    rows = rows.where(F.col("language").isin(list(used)))
    split = F.split(F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content"), r"\r?\n")
    each = rows.select("path", "language", F.posexplode(split).alias("line", "text")).where(F.trim("text") != "")
    case = F.when(F.lit(False), F.array().cast("array<struct<kind:string,relation:string,name:string,bases:string>>"))
    for name, rules in used.items():
        case = case.when(F.col("language") == name, _found(rules, F.col("text")))
    return each.select("path", (F.col("line") + 1).alias("line"), "language", F.explode(case).alias("x")).select("path", "line", "language", "x.*")


def extracted(files: DataFrame, languages: list[str] | None = None) -> Graph:
    """The graph of some source files: a node for each file and declaration, edges for what contains, imports and extends what.

    Methods belong to the last class before them in their file, or to the file. Names that are imported or extended are
    nodes of no file.
    """
    found = declarations(files, languages)
    file_node = text.file_id(F.col("path"))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    holder = F.last(F.when(F.col("kind").isin("class", "struct", "interface", "module", "type") & (F.col("relation") == "contains"), F.col("name")), ignorenulls=True).over(order)
    rows = found.withColumn("holder", holder)
    own = F.concat_ws("_", file_node, text.make_id(F.col("name")))
    holder_id = F.coalesce(F.concat_ws("_", file_node, F.nullif(text.make_id(F.col("holder")), F.lit(""))), file_node)
    declared = rows.where(F.col("relation").isin("contains", "method"))
    kinds = {"nodes": [
        declared.groupBy(own.alias("id")).agg(F.min_by(F.struct("name", "kind", "path", "line"), "line").alias("x")).select("id", F.when(F.col("x.kind").isin("function", "method"), F.concat("x.name", F.lit("()"))).otherwise(F.col("x.name")).alias("label"), F.col("x.kind").alias("file_type"), F.col("x.path").alias("source_file"), F.concat(F.lit("L"), F.col("x.line")).alias("source_location")),
        files.select(file_node.alias("id"), paths.file_name(F.col("path")).alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.lit("L1").alias("source_location")),
    ]}
    edge = lambda df, source, target: df.select(source.alias("source"), target.alias("target"), "relation", F.lit("EXTRACTED").alias("confidence"), F.col("path").alias("source_file"), F.lit(1.0).alias("weight"), F.when(F.col("relation").startswith("import"), "import").when(F.col("relation") == "calls", "call").alias("context"))
    contains = edge(declared.where("relation = 'contains'"), file_node, own)
    methods = edge(declared.where("relation = 'method'"), holder_id, own)
    based = rows.where(F.col("relation").isin("inherits", "implements")).withColumn("base", F.explode(F.filter(F.transform(F.split("bases", ","), lambda b: F.regexp_replace(F.trim(b), r"^(?:public|private|protected|virtual)\s+|[<\[(].*$|=.*$", "")), lambda b: b != "")))
    extends = edge(based, own, text.make_id(F.col("base")))
    others = rows.where(~F.col("relation").isin("contains", "method", "inherits", "implements"))
    refers = edge(others, file_node, text.make_id(F.col("name")))
    outside = based.select(text.make_id(F.col("base")).alias("id"), F.col("base").alias("label")).union(others.select(text.make_id(F.col("name")), F.col("name"))).groupBy("id").agg(F.min("label").alias("label"))
    outside = outside.select("id", "label", F.lit("code").alias("file_type"), F.lit("").alias("source_file"), F.lit(None).cast("string").alias("source_location"))
    every = kinds["nodes"][1].unionByName(kinds["nodes"][0]).unionByName(outside)
    nodes = every.groupBy("id").agg(F.max_by(F.struct("label", "file_type", "source_file", "source_location"), F.struct("source_file", "label")).alias("x")).select("id", "x.*")
    nodes = nodes.withColumns({"community": F.lit(None).cast("long"), "ord": F.xxhash64("id")})
    return Graph(nodes, distinct_edges(contains.unionByName(methods).unionByName(extends).unionByName(refers)), True)


def outline(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """path, line, kind, name of what files declare, in order."""
    return declarations(files, languages).where(F.col("relation").isin("contains", "method")).select("path", "line", "kind", "name").dropDuplicates().orderBy("path", "line")


def depth_by_line(source: DataFrame) -> DataFrame:
    """path, line, text, depth: open braces at the end of each line. source: path, line, text."""
    change = F.length(F.regexp_replace("text", r"[^{]", "")) - F.length(F.regexp_replace("text", r"[^}]", ""))
    return source.withColumn("depth", F.sum(change).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))


def method_ranges(source: DataFrame, starts: DataFrame) -> DataFrame:
    """path, name, line, end: the first line at which the braces opened from the start are closed again; without braces the file's last line.

    starts: path, name, line.
    """
    d = depth_by_line(source).select("path", F.col("line").alias("at"), F.col("text").alias("t"), "depth")
    before = d.select("path", (F.col("at") + 1).alias("line"), F.col("depth").alias("base"))
    s = starts.join(before, ["path", "line"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    rows = s.join(d, "path").where("at >= line").withColumn("opened", F.max(F.col("t").contains("{")).over(Window.partitionBy("path", "name", "line").orderBy("at")))
    close = F.min(F.when(F.col("opened") & (F.col("depth") <= F.col("base")), F.col("at")))
    return rows.groupBy("path", "name", "line").agg(F.coalesce(close, F.max("at")).alias("end"))


def read_lines(source: DataFrame, path: str, first: int = 1, last: int = 0) -> DataFrame:
    """line, text of a part of a file; last 0 means its end. Raises ValueError if first is after last."""
    if last and first > last:
        raise ValueError(f"line {first} is after line {last}")
    rows = source.where((F.col("path") == path) & (F.col("line") >= first))
    return (rows.where(F.col("line") <= last) if last else rows).orderBy("line").select("line", "text")


def read_method(files: DataFrame, path: str, name: str) -> DataFrame:
    """line, text of the first method of a file whose name begins with ``name``, in small letters."""
    one = files.where(F.col("path") == path)
    source = lines(one)
    hit = outline(one).where(F.col("kind").isin("method", "function") & F.lower("name").startswith(name.lower())).orderBy("line").limit(1)
    span = method_ranges(source, hit.select("path", "name", "line")).select("path", F.col("line").alias("first"), "end")
    return source.join(span, "path").where("line between first and end").orderBy("line").select("line", "text")


def read_with_callees(files: DataFrame, path: str, name: str) -> DataFrame:
    """name, line, end: the method and those of its file that its body calls."""
    one = files.where(F.col("path") == path)
    source = lines(one)
    methods = outline(one).where(F.col("kind").isin("method", "function")).select("path", "name", "line")
    spans = method_ranges(source, methods)
    root = spans.where(F.lower("name").startswith(name.lower())).orderBy("line").limit(1)
    body = source.join(root.select("path", F.col("line").alias("first"), F.col("end").alias("last"), F.col("name").alias("root")), "path").where("line between first and last")
    called = spans.join(body.select("path", "text", "root"), "path").where((F.col("name") != F.col("root")) & F.col("text").contains(F.concat("name", F.lit("(")))).select("name", "line", "end").distinct()
    return root.select("name", "line", "end").union(called).orderBy("line")
