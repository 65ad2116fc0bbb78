"""Row numbers over a whole table without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.materialize import materialized


def numbered_rows(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """`df` with a column that numbers its rows in the order given.

    Rows are range-partitioned and numbered inside their partition; the partitions' first numbers are summed from their
    counts, which are one row for each partition. The partitions are written once, as their ranges come from a sample
    that another run of the plan would draw anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialized(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    own = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = ranged.groupBy("__part").count()
    firsts = counts.withColumn("__first", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).select("__part", "__first")
    return own.join(F.broadcast(firsts), "__part").withColumn(name, F.col("__first") + F.col("__row") - 1 + start).drop("__part", "__row", "__first")


def running_totals(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """`df` with a column that sums `value` over all rows up to each in the order given (rows that are equal in it: in any order).

    As numbered_rows: sums inside ranges, and what the ranges before come to."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialized(df.repartitionByRange(parts, *order).withColumns({"__part": F.spark_partition_id(), "__value": value}))
    own = ranged.withColumn("__own", F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = ranged.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    firsts = sums.withColumn("__first", F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).select("__part", "__first")
    return own.join(F.broadcast(firsts), "__part").withColumn(name, F.col("__first") + F.col("__own")).drop("__part", "__value", "__own", "__first")
