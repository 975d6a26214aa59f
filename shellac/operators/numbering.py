"""Numbers of rows in one global order, without one task for all rows when there are many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.storage import input_bytes, materialise

#: Inputs up to this size are numbered by one window; larger ones by ranges.
SMALL_INPUT = 256 << 20


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "pos", total: str | None = None, small_input: int = SMALL_INPUT) -> DataFrame:
    """Add the 1-based number of each row in a total order (int), and on demand the number of rows.

    Beyond ``small_input`` bytes the rows are sorted by ranges and written once; each range then adds the rows of the ranges
    before it, so no task holds more than a range.
    """
    if input_bytes(df) <= small_input:
        out = df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
        return out.withColumn(total, F.count("*").over(Window.partitionBy())) if total else out
    ranged = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_range", F.shiftright("_at", 33)), "numbered")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    out = ranged.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int"))
    return out.withColumnRenamed("_all", total).drop("_range", "_at", "_before") if total else out.drop("_range", "_at", "_before", "_all")
