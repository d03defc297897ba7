"""Which file an import means, and what Python files say about names: facts by the syntax tree, resolved by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings that are tried after a specifier, and index files of folders.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".svelte", ".vue"]
FACTS = "path string, kind string, scope string, name string, module string, alias string, context string, line int"
BUILTIN_TYPES = frozenset("int float str bool bytes list dict set tuple None Any Optional Union List Dict Set Tuple Iterable Iterator Callable Sequence Mapping object type".split())


def normal_path(path: Column) -> Column:
    """Without . and with .. taken back; what goes above the root stays there."""
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def python_candidates(path: Column, module: Column, level: Column) -> Column:
    """Paths that a Python import can mean, in order: the module's file, then the package's."""
    parts = F.replace(F.coalesce(module, F.lit("")), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(level - 1, F.lit(0)))
    base = F.when(level > 0, F.concat(folder(path), F.lit("/"), up, parts)).otherwise(parts)
    clean = normal_path(base)
    return F.array(F.concat(clean, F.lit(".py")), F.concat(F.when(clean != "", F.concat(clean, F.lit("/"))).otherwise(""), F.lit("__init__.py")))


def script_candidates(path: Column, specifier: Column) -> Column:
    """Paths that a relative or aliased specifier can mean, in order: itself, .ts for .js, with an ending, a folder's index."""
    base = normal_path(F.when(specifier.startswith("."), F.concat(folder(path), F.lit("/"), specifier)).otherwise(specifier))
    swapped = F.regexp_replace(F.regexp_replace(base, r"\.js$", ".ts"), r"\.jsx$", ".tsx")
    ends = [F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS] + [F.concat(base, F.lit(f"/index{e}")) for e in SCRIPT_ENDINGS[:4]]
    return F.array(base, swapped, *ends)


def aliased(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports with the longest matching alias put in place. aliases: prefix (may end in *), target, as many as there are."""
    a = aliases.select(F.regexp_replace("prefix", r"\*$", "").alias("p"), F.regexp_replace("target", r"\*$", "").alias("t"), F.col("prefix").endswith("*").alias("wild"))
    begins = F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda n: F.substring(F.col("specifier"), F.lit(1), n))
    each = imports.select("path", "specifier").distinct().select("*", F.explode_outer(begins).alias("begin"))
    hit = each.join(a, (F.col("begin") == F.col("p")) & (F.col("wild") | (F.col("specifier") == F.col("p"))), "left")
    best = hit.groupBy("path", "specifier").agg(F.max_by(F.struct("p", "t"), F.struct(F.length("p"), "t")).alias("x"))
    return best.select("path", "specifier", F.coalesce(F.concat(F.col("x.t"), F.expr("substring(specifier, length(x.p) + 1)")), "specifier").alias("wanted"))


def resolved(imports: DataFrame, files: DataFrame, candidates: str = "candidates") -> DataFrame:
    """The columns of imports and target: the first of the candidates that is a file, null if none is. files: path."""
    keyed = imports.withColumn("__row", F.struct(*[c for c in imports.columns if c != candidates]))
    each = keyed.select("__row", F.posexplode(candidates).alias("place", "candidate"))
    found = each.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("__row").agg(F.min_by("candidate", "place").alias("target"))
    return keyed.select("__row").join(found, "__row", "left").select("__row.*", "target")


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path, self.scope, self.rows = path, [], []

    def add(self, kind: str, name: str, line: int, module: str | None = None, alias: str | None = None, context: str | None = None) -> None:
        self.rows.append((self.path, kind, ".".join(self.scope), name, module, alias, context, line))

    def visit_Import(self, node: ast.Import) -> None:
        for n in node.names:
            self.add("import", n.name, node.lineno, n.name, n.asname)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for n in node.names:
            self.add("import_from", n.name, node.lineno, "." * node.level + (node.module or ""), n.asname)

    def _inside(self, node: ast.AST, name: str) -> None:
        self.scope.append(name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node.lineno)
        for b in node.bases:
            self.add("base", ast.unparse(b), node.lineno, context=node.name)
        self._inside(node, node.name)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.add("method" if self.scope else "function", node.name, node.lineno)
        self.scope.append(node.name)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self.types(a.annotation, "parameter_type")
        self.types(node.returns, "return_type")
        self.scope.pop()
        self._inside(node, node.name)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.types(node.annotation, "field")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.add("call", node.func.id, node.lineno)
        elif isinstance(node.func, ast.Attribute):
            self.add("member_call", node.func.attr, node.lineno)
        self.generic_visit(node)

    def types(self, node: ast.AST | None, context: str, inner: bool = False) -> None:
        if isinstance(node, ast.Name | ast.Attribute):
            name = ast.unparse(node)
            if name not in BUILTIN_TYPES:
                self.add("type", name, node.lineno, context="generic_arg" if inner else context)
        elif isinstance(node, ast.Subscript):
            self.types(node.value, context, inner)
            self.types(node.slice, context, True)
        elif isinstance(node, ast.BinOp):
            self.types(node.left, context, inner)
            self.types(node.right, context, inner)
        elif isinstance(node, ast.Tuple | ast.List):
            for x in node.elts:
                self.types(x, context, inner)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                self.types(ast.parse(node.value, mode="eval").body, context, inner)
            except SyntaxError:
                return


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, content): imports, classes, bases, functions, calls and annotation types; files that do not parse give one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                visit = _Facts(path)
                try:
                    visit.visit(ast.parse(content or ""))
                    rows += visit.rows
                except (SyntaxError, ValueError) as e:
                    rows.append((path, "error", "", str(e)[:200], None, None, None, 0))
            yield pd.DataFrame(rows, columns=["path", "kind", "scope", "name", "module", "alias", "context", "line"])

    text = F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    return files.where(F.col("path").endswith(".py")).select("path", text.alias("content")).mapInPandas(run, FACTS)


def python_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """source (path), target (path), relation, name, context: where imported, called and annotated names are declared.

    A name belongs to the file that the import of that name (or alias) resolves to; calls and types of names that the
    file itself declares stay in the file.
    """
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    imports = facts.where(F.col("kind").isin("import", "import_from")).select("path", "kind", "name", "alias", dots.alias("level"), F.regexp_replace("module", r"^\.+", "").alias("module"))
    asked = imports.withColumn("candidates", python_candidates(F.col("path"), F.col("module"), F.col("level")))
    origin = resolved(asked, files).where("target is not null")
    named = origin.where("kind = 'import_from'").select("path", F.coalesce("alias", "name").alias("local"), "name", "target")
    own = facts.where(F.col("kind").isin("class", "function") & (F.col("scope") == "")).select("path", F.col("name").alias("local"), "name", F.col("path").alias("target"))
    known = named.unionByName(own).distinct()
    brought = origin.select(F.col("path").alias("source"), "target", F.lit("imports").alias("relation"), "name", F.lit("import").alias("context"))
    uses = facts.where(F.col("kind").isin("call", "type")).select("path", "kind", F.col("name").alias("local"), "context")
    used = uses.join(known, ["path", "local"]).select(F.col("path").alias("source"), "target", F.when(F.col("kind") == "call", "calls").otherwise("references").alias("relation"), "name", F.when(F.col("kind") == "call", "call").otherwise(F.col("context")).alias("context"))
    return brought.union(used).distinct()
