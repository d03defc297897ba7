"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.storage import free, measured, release, shared_dir, written

__all__ = ["free", "measured", "release", "shared_dir", "slices", "table", "text_key", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """A 64-bit key of a text. With doc_id it names a row by its content: equal rows get equal decisions."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that little text is held as Python objects at a time; then memory goes back.

    Workers live on after a task. What they freed but keep reserved would add up over the stages of a pipeline.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
