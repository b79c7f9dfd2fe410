"""Running sums over a whole order, by ranges of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import shared


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each one in an order, itself included.

    Ranges of the order are summed up in tasks of their own; one row a range meets in a single task. Rows that agree in
    the whole order lie in one range.
    """
    rows = shared(rows.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    own = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + own).drop("__part", "__before", "__value")
