"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one, in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        context = spark.sparkContext
        place = context.getCheckpointDir()
        if not place:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="arborlake-"))
            place = context.getCheckpointDir()
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: it cuts lineage, survives executors and is removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def shuffled(table: DataFrame, most: int = 20_000) -> DataFrame:
    """A written table, kept from being broadcast if it has more than ``most`` rows.

    Spark judges Parquet by its compressed size, so a loop of joins would send many times that through the driver.
    """
    return table.hint("merge") if table.count() > most else table


def parts_for(rows: int, each: int = 100_000, most: int = 200) -> int:
    """How many partitions to deal rows to, so that a task's memory does not follow the input.

    Adaptive execution keeps a number that was asked for. Up to 200 partitions a task writes without sorting or holding rows.
    """
    return max(1, min(most, -(-rows // each)))


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates of the rows that are taken while they are written."""
    seen = Observation()
    table = written(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), name)
    return table, seen.get


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Removes tables that ``written`` or ``measured`` gave, once all that was made of them is written itself."""
    for table in tables:
        pair = (table.sparkSession, table._written_at)
        _written.remove(pair)
        _remove(*pair)
    if tables:
        release(tables[0])


def release(df: DataFrame) -> None:
    """A collection lets Spark's cleaner see that the shuffles of finished jobs are not needed, so it removes their files."""
    df.sparkSession._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before the process does
            return


