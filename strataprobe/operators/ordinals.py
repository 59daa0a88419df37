"""Row numbers and running sums over a whole table, without a window that one task would hold.

Rows are sorted into ranges and fixed by a checkpoint; each range's count or sum is added up over earlier ranges (one small
row a range), and within a range every task works alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut

#: Rows of one block of a running sum.
BLOCK = 100_000
#: Rows of a range in fixed_ranges().
RANGE_ROWS = 200_000


def fixed_order(df: DataFrame, order: list) -> DataFrame:
    """df sorted, its partitions fixed: each holds a range of the order, in order."""
    return cut(df.orderBy(*order))


def fixed_ranges(df: DataFrame, *order: str) -> DataFrame:
    """fixed_order() in ranges of RANGE_ROWS or so, whatever a row's size, for narrow rows that long ones are made of afterwards."""
    n = df.count() // RANGE_ROWS + 1
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))


def part_offsets(df: DataFrame, size: Column, by: list[str] | None = None) -> DataFrame:
    """part, (by,) n, rows and before: the sum of size and the rows in each partition of a fixed table, and the size of those before it."""
    by = by or []
    sizes = df.groupBy(F.spark_partition_id().alias("part"), *by).agg(F.sum(size).cast("long").alias("n"), F.count("*").alias("rows"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("part")  # a row for each partition alone
    return sizes.withColumn("before", F.sum("n").over(w) - F.col("n"))


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """df with the number, from 0, of each row in the order, which should leave no ties. The column lets a table be compared with
    its order."""
    rows = fixed_order(df, order).withColumn("row_id", F.monotonically_increasing_id())
    part = F.shiftright("row_id", 33).cast("int")
    offsets = part_offsets(rows, F.lit(1)).select("part", "before")
    met = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return met.withColumn(name, F.col("before") + F.col("row_id") - F.shiftleft(F.col("part").cast("long"), 33)).drop("part", "before", "row_id")


def running_sum(df: DataFrame, value: Column, ordinal: str, name: str) -> DataFrame:
    """df with the sum of value over this row and those before it by ordinal."""
    rows = df.withColumn("sum_block", F.floor(F.col(ordinal) / BLOCK)).withColumn("sum_value", value)
    local = F.sum("sum_value").over(Window.partitionBy("sum_block").orderBy(ordinal))
    sums = rows.groupBy("sum_block").agg(F.sum("sum_value").alias("n"))
    earlier = sums.select("sum_block", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("sum_block")) - F.col("n")).alias("sum_before"))
    return rows.withColumn(name, local).join(F.broadcast(earlier), "sum_block").withColumn(name, F.col(name) + F.col("sum_before")).drop("sum_block", "sum_value", "sum_before")
