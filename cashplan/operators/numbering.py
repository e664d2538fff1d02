"""Places of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashplan.session import written


def numbered(rows: DataFrame, *order: Column, name: str = "Position", coarse: Column | None = None) -> DataFrame:
    """The rows with their place, 1, 2, 3, ..., by ``order``, in which no two should be alike.

    ``coarse``, a number that never falls along the order (null only at its end), makes most comparisons of rows cheap.

    They are laid out in ranges of the order in the shared folder; a row's place in its range follows the sizes of the
    ranges before it, one row each.
    """
    if coarse is not None:
        rows, order = rows.withColumn("_Coarse", coarse), (F.asc_nulls_last("_Coarse"), *order)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_Coarse")
    laid = written(ranges.withColumns({"_Range": F.spark_partition_id(), "_Nth": F.monotonically_increasing_id()}))
    sizes = laid.groupBy("_Range").agg(F.count(F.lit(1)).alias("_Rows"), F.min("_Nth").alias("_First"))
    before = Window.orderBy("_Range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_Range", "_First", F.coalesce(F.sum("_Rows").over(before), F.lit(0)).alias("_Before"))
    place = F.col("_Before") + F.col("_Nth") - F.col("_First") + 1
    return laid.join(F.broadcast(starts), "_Range").withColumn(name, place).drop("_Range", "_Nth", "_First", "_Before")
