"""Numbers of rows in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str, rows: int = 100_000) -> DataFrame:
    """``df`` with ``name``: its rows' numbers from 0 in the order of a whole-number column.

    The column's range is cut into equal ranges of about ``rows`` rows; a row's
    number is its place in its range and the count of the ranges before, so only
    those counts meet in one task. Ties are in any order; nulls come first.
    """
    least, most, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    width = max(1, -(-(most - least + 1) * rows // n)) if most is not None else 1
    cell = F.coalesce(F.floor((F.col(order) - F.lit(least)) / F.lit(width)), F.lit(-1)) if most is not None else F.lit(-1)
    placed = df.withColumn("_cell", cell.cast("long"))
    counts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_cell", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(order))
    return placed.join(starts, "_cell").withColumn(name, F.col("_start") + place - 1).drop("_cell", "_start")
