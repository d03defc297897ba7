"""Bounded training samples and held-out marks for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, ident: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % modulus


def held_in_labels(labels: DataFrame, label: str, rows: int, modulus: int = 5) -> DataFrame:
    """doc_id, label of at most ``rows`` labelled documents outside the held-out remainder 0, the first by a hash.

    Rows without doc_id or label are left out; a document that is labelled more than once has its greatest label.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(modulus) != 0))
    single = usable.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(label).cast("int").alias("label"))
    return single.orderBy(F.xxhash64(F.lit(1), "l_id"), "l_id").limit(rows)
