"""Running totals over a total order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.scratch import Table


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows before and including each one in ``order``.

    Rows are dealt into ranges of the whole order, so that equal leading keys do not
    meet in one task; sums run within ranges, and the sums of the ranges, one row each,
    give what came before. The ranges are written once, so both levels see the same.
    ``order`` has to be total, and a null value counts as nothing.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(out, value).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    rows = Table(dealt, "ranges").df
    per = rows.groupBy("__range").agg(F.sum(out).alias("__all"))
    before = F.sum("__all").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.sum(out).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__inner", inner).join(F.broadcast(per), "__range")
    return found.withColumn(out, F.coalesce(F.col("__inner"), F.lit(0)) + F.col("__before")).drop("__range", "__inner", "__before")
