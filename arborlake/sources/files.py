"""Files as rows: scanning, classifying and summing up folders of sources."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import paths


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, pattern: str = "*") -> DataFrame:
    """path, relative_path, file_type, content, modificationTime of the files below a folder, without skipped, sensitive and ignored ones.

    Content is read only if it is asked for later: Spark prunes the column from the scan.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), rf"^.*?\Q{base.split('://')[-1]}\E", "")
    rows = raw.select("path", relative.alias("relative_path"), "content", "modificationTime", "length")
    rows = rows.where(~paths.is_skipped(F.col("relative_path")) & ~paths.is_sensitive(F.col("relative_path")) & ~ignored(F.col("relative_path"), ignore or []))
    return classified(rows).where("file_type is not null")


def classified(files: DataFrame) -> DataFrame:
    """Adds file_type; a file without an ending is code if its first line names an interpreter; documents with enough signs are papers."""
    text = F.decode(F.substring("content", 1, 3000), "UTF-8")
    paper = paths.paper_signs(text) >= paths.PAPER_LEAST
    kind = paths.file_kind(F.col("relative_path"), paper)
    script = (paths.ending(F.col("relative_path")) == "") & paths.is_script(text)
    return files.withColumn("file_type", F.when(script, "code").otherwise(kind))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore-file patterns, the last match deciding: ! takes back, / at the start binds to the root, / at the end means folders, * and ** as usual."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        keep = p.startswith("!")
        out = F.when(path.rlike(_pattern(p[1:] if keep else p)), F.lit(not keep)).otherwise(out)
    return out


def _pattern(p: str) -> str:
    bound, folder = p.lstrip("/") != p or "/" in p.rstrip("/"), p.endswith("/")
    body = p.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (body[i] if body[i].isalnum() or body[i] in "_/-" else "\\" + body[i]), i + 1
    return ("^" if bound else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def word_count(content: Column) -> Column:
    """White-space separated words of text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(F.decode(content, "UTF-8"), r"\s+"), lambda w: w != "")), F.lit(0))


def summary(files: DataFrame) -> DataFrame:
    """file_type, files, words."""
    return files.groupBy("file_type").agg(F.count("*").alias("files"), F.sum(word_count(F.col("content"))).alias("words"))


def needs_graph(files: DataFrame, least: int = 5) -> DataFrame:
    return files.agg((F.count("*") >= least).alias("needs_graph"))


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """path, line (from 1), text."""
    text = F.decode(content, "UTF-8") if dict(files.dtypes)[content] == "binary" else F.col(content)
    return files.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def grep(files: DataFrame, pattern: str, most: int = 50, width: int = 120) -> DataFrame:
    """path, line, snippet of the first lines that match."""
    hit = lines(files).where(F.col("text").rlike(pattern)).orderBy("path", "line").limit(most)
    return hit.select("path", "line", F.substring(F.trim("text"), 1, width).alias("snippet"))


def cached_fragments(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments of files whose content hash the cache (hash, fragment) has, and the files that it does not have."""
    keyed = files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    return keyed.join(cache, "hash").select("path", "hash", "fragment"), keyed.join(cache.select("hash"), "hash", "left_anti")


def cached_vectors(nodes: DataFrame, hashes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of nodes whose file is unchanged since the cache (path, hash, id, vector), and the nodes to embed."""
    now = nodes.join(hashes.select(F.col("path").alias("source_file"), "hash"), "source_file")
    valid = cache.select(F.col("path").alias("source_file"), "hash", "id", "vector")
    return now.join(valid, ["source_file", "hash", "id"]).select("id", "vector"), now.join(valid, ["source_file", "hash", "id"], "left_anti")


def has_linked_folders(root: str) -> bool:
    """Whether a local folder directly holds a link to a folder; False if it cannot be read. Scans then follow links."""
    try:
        with os.scandir(root) as entries:
            return any(e.is_symlink() and e.is_dir() for e in entries)
    except OSError:
        return False


def inside(path: str, base: str) -> str:
    """The real path, links resolved. FileNotFoundError if it or the base is missing, ValueError if it leaves the base."""
    real, root = os.path.realpath(path, strict=True), os.path.realpath(base, strict=True)
    if os.path.commonpath([real, root]) != root:
        raise ValueError(f"{path} is outside {base}")
    return real
