"""Helpers shared by the corpus operators: table reading, scratch tables, safe column names."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, written

__all__ = ["delete", "fresh", "parallelism", "release", "spread", "table", "words", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(spark: SparkSession, size: float, per_task: float) -> int:
    """Partitions for `size` (bytes or rows) at most `per_task` each, and no fewer than the session's."""
    return max(parallelism(spark), int(size // per_task) + 1)


def release() -> None:
    """Gives memory that a task needed back to the system: Python workers outlive their tasks and else keep the most that any needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\v]+")), F.lit(0)).cast("long")
