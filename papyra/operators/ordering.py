"""A dense index over a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.plans.durable import checkpointed

#: Rows up to which one window is fine; beyond it the order is cut into ranges of about this size.
ONE_WINDOW = 200_000


def with_index(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds a column counting from 0 in the given (total) order.

    The rows are computed once. Large inputs are dealt over ranges of the order; a
    row's index is the number of rows in the ranges before plus its place in its own.
    """
    df = checkpointed(df)
    n = df.count()
    if n <= ONE_WINDOW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    # The checkpoint keeps each row's range, whatever becomes of the partitions later.
    parted = checkpointed(df.repartitionByRange(n // ONE_WINDOW + 1, *order).withColumn("_part", F.spark_partition_id()))
    # One row for each range.
    before = parted.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    placed = parted.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1)
    return placed.join(before, "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
