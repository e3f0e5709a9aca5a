"""Row numbers and prefix sums over a whole table, without a single task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.shared import kept


def global_sum(df: DataFrame, order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to the current one, in the total order that ``order`` gives.

    Rows are range-partitioned by ``order``; each range sums by itself, and the ranges' totals, one row each, add up to
    what lies before a range. The ranges are written once, so that both uses see the same ones. ``order`` (columns, their
    descending order, or expressions) has to tell any two rows apart, else equal rows may fall to two ranges.
    """
    ranged = df.withColumn("__value", value)
    ranged = kept(ranged.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("__range").agg(F.sum("__value").alias("__total"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("__range").alias("__at"), "__before")
    summed = ranged.withColumn("__sum", F.sum("__value").over(within)).join(F.broadcast(before), F.col("__range") == F.col("__at"))
    return summed.withColumn(name, F.col("__sum") + F.col("__before")).drop("__value", "__range", "__at", "__sum", "__before")


def global_number(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Adds row numbers from 1."""
    return global_sum(df, order, F.lit(1), name)
