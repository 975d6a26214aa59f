"""Small helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.storage import discard, materialise, new_path

__all__ = ["ascii_lower", "bound_batches", "broadcast_if_small", "discard", "materialise", "new_path", "quoted", "release_memory"]

_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def broadcast_if_small(df: DataFrame, rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only when the counted rows take at most ``most_bytes``, with 8 bytes for a number and 40 for anything else;
    beyond it Spark shuffles the join."""
    width = sum(8 if f.dataType.typeName() in _NUMBERS else 40 for f in df.schema)
    return F.broadcast(df) if rows * width <= most_bytes else df


def bound_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let the session hand texts to Python in Arrow batches of at most ``limit`` bytes.

    Spark's own bound, 64 MB and 10,000 rows, costs several times that in each task, on both sides. A lower setting stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, limit)


def release_memory() -> None:
    """Give memory that this Python worker has freed back to the system; Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
