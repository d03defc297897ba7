"""Columns over raw node and edge records: kinds of nodes, canonical edges and their signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by declared node type, and by signs in the label, in the order in which they decide.
KIND_BY_TYPE = {
    "klass": "class klass struct interface enum trait model".split(),
    "module": "module file package namespace".split(),
    "api": "endpoint route api handler controller".split(),
    "test": "test spec".split(),
    "ui": "component hook view page".split(),
}
CONCEPT_FILES = ["rationale", "document"]
KIND_BY_LABEL = {"api": "endpoint router api route".split(), "entry": "cli command click typer".split(), "async": "async await stream sse".split()}
UI_LABELS = "component props hook store".split()
UI_ENDINGS = ".tsx .jsx .vue .svelte".split()
MODULE_ENDINGS = ".py .ts .tsx .js .jsx .go .rs .java .kt .rb .php .cs .swift .vue .svelte".split()
# The fields of a canonical edge beside its ends, and the text that marks a record that is no object.
EDGE_FIELDS = "relation confidence source_file source_location context".split()
NO_OBJECT = "non_object_edge"
NO_OBJECT_SIGNATURE = "<non-object>"


def _some(tests: list[Column]) -> Column:
    return F.coalesce(F.array_max(F.array(*tests)), F.lit(False))


def node_kind(node_type: Column, file_type: Column, label: Column, source_file: Column) -> Column:
    """klass, module, api, test, ui, concept, entry, async or function; the declared type decides first, then the file, then the label. Nulls are empty."""
    kind, files, name, path = (F.lower(F.coalesce(c, F.lit(""))) for c in (node_type, file_type, label, source_file))
    raw = F.coalesce(label, F.lit(""))
    out = F.when(F.lit(False), "")
    for value, types in KIND_BY_TYPE.items():
        out = out.when(kind.isin(types), value)
    out = out.when(files.isin(CONCEPT_FILES), "concept").when(path.rlike("test|spec") | name.startswith("test_"), "test")
    for value, signs in KIND_BY_LABEL.items():
        out = out.when(_some([name.contains(s) for s in signs]), value)
    out = out.when(raw.rlike(r"^use[\p{Lu}_-]") | _some([name.contains(s) for s in UI_LABELS] + [path.endswith(e) for e in UI_ENDINGS]), "ui")
    return out.when(raw.rlike(r"^\p{Lu}") & ~raw.endswith("()"), "klass").when(_some([raw.endswith(e) for e in MODULE_ENDINGS]), "module").otherwise("function")


def scalar_text(record: Column, key: str) -> Column:
    """A field of a JSON object as text: numbers and booleans as written, arrays and objects as JSON, null and missing as empty."""
    return F.coalesce(F.from_json(record, "map<string,string>")[key], F.lit(""))


def is_object(record: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(record)).startswith("OBJECT"), F.lit(False))


def canonical_edge(record: Column) -> Column:
    """A JSON edge as a struct of texts; from and to stand in for ends that are missing; invalid says that it is no object."""
    m = F.when(is_object(record), F.from_json(record, "map<string,string>"))
    end = lambda key, other: F.coalesce(F.when(F.map_contains_key(m, F.lit(key)), F.coalesce(m[key], F.lit(""))), m[other], F.lit(""))
    fields = [F.coalesce(m[f], F.lit("")).alias(f) for f in EDGE_FIELDS]
    return F.struct(end("source", "from").alias("source"), end("target", "to").alias("target"), *fields, F.when(m.isNull(), NO_OBJECT).otherwise("").alias("invalid"))


def edge_signature(record: Column) -> Column:
    """The edge as JSON with sorted keys; from and to are named source and target, or left out beside those."""
    m = F.try_parse_json(record).cast("map<string,variant>")
    names = F.map_keys(m)
    renamed = F.transform(names, lambda k: F.when((k == "from") & ~F.array_contains(names, "source"), "source").when((k == "to") & ~F.array_contains(names, "target"), "target").when(~k.isin("from", "to"), k))
    pairs = F.zip_with(renamed, names, lambda to, own: F.struct(to.alias("to"), own.alias("own")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["to"].isNotNull()))
    sorted_map = F.map_from_arrays(F.transform(kept, lambda p: p["to"]), F.transform(kept, lambda p: m[p["own"]]))
    return F.when(is_object(record), F.to_json(sorted_map)).otherwise(NO_OBJECT_SIGNATURE)
