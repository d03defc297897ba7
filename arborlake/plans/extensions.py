"""What a user may bring: extractors by file ending, embedders, and callables for language models with retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.extract import structure
from arborlake.functions.paths import ending, file_name
from arborlake.functions.text import file_token_estimate, label_tokens
from arborlake.functions.vectors import label_vectors
from arborlake.graph import Graph

Extractor = Callable[[DataFrame], Graph]
# What an error or an answer says when a chunk was too long for a model.
OVERFLOW_MARKS = ["context length", "context_length", "maximum context", "too many tokens", "token limit", "prompt is too long", "input is too long", "exceeds the limit", "max_tokens", "request too large", "context window"]


class Extractors:
    """Extractors by whole file name or ending; names go first, and files without one give nothing."""

    def __init__(self) -> None:
        self.known: dict[str, Extractor] = {}

    def register(self, keys: list[str], extract: Extractor) -> None:
        for k in keys:
            self.known[k.lower()] = extract

    def run(self, files: DataFrame) -> Graph:
        """files: path, content. Each extractor gets its files as one DataFrame; all others go to the line rules."""
        name, end = F.lower(file_name(F.col("path"))), ending(F.col("path"))
        keys = list(self.known)
        chosen = F.when(name.isin(keys), name).when(end.isin(keys), end)
        rows = files.withColumn("__key", chosen)
        out = structure.extracted(rows.where("__key is null").drop("__key"))
        for k, extract in self.known.items():
            part = extract(rows.where(F.col("__key") == k).drop("__key"))
            out = Graph(out.nodes.unionByName(part.nodes, True), out.edges.unionByName(part.edges, True), out.directed)
        return Graph(out.nodes.dropDuplicates(["id"]), out.edges, out.directed)


def embedded(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, width: int = 256) -> DataFrame:
    """id, vector of each node's label: by the user's embedder, batch by batch, or by seeded token vectors."""
    if embed is None:
        return nodes.select("id", label_vectors(width)(label_tokens(F.col("label"))).alias("vector"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": embed(pdf["label"].fillna("").tolist())})

    return nodes.select("id", "label").mapInPandas(run, "id string, vector array<double>")


def chunks(files: DataFrame, budget: int = 60_000) -> DataFrame:
    """path, folder, bin: files of a folder packed in order of their names. files: path, size."""
    from arborlake.operators.aggregates import packed

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    rows = files.withColumn("folder", folder).select(F.col("folder").alias("group"), place.alias("ord"), F.col("path").alias("id"), file_token_estimate(F.col("size")).alias("tokens"))
    return packed(rows, budget).select(F.col("id").alias("path"), F.col("group").alias("folder"), "bin")


def overflowed(message: str) -> bool:
    return any(mark in message.lower() for mark in OVERFLOW_MARKS)


def asked(texts: list[str], ask: Callable[[list[str]], dict], depth: int = 3) -> list[dict]:
    """The answers to a chunk of texts; a chunk that is too long, or whose answer was cut, is asked in halves, up to ``depth`` times."""
    try:
        answer = ask(texts)
        cut = answer.get("finish_reason") == "length"
    except Exception as e:
        if not overflowed(str(e)):
            raise
        answer, cut = {}, True
    if not cut or depth == 0 or len(texts) < 2:
        return [] if hollow(answer) else [answer]
    half = len(texts) // 2
    return asked(texts[:half], ask, depth - 1) + asked(texts[half:], ask, depth - 1)


def hollow(answer: dict | None) -> bool:
    """Nothing, or no nodes, edges and hyperedges."""
    return not answer or not any(answer.get(k) for k in ("nodes", "edges", "hyperedges"))


def answers(packs: DataFrame, ask: Callable[[list[str]], dict], depth: int = 3) -> DataFrame:
    """bin, answer (JSON) for each pack of texts (bin, texts), asked where the pack lies; every task asks on its own."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(b, json.dumps(a)) for b, texts in zip(pdf["bin"], pdf["texts"]) for a in asked(list(texts), ask, depth)]
            yield pd.DataFrame(rows, columns=["bin", "answer"])

    return packs.select("bin", "texts").mapInPandas(run, "bin long, answer string")
