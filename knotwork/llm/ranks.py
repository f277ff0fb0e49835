"""Places of rows within their group, without any group in one task.

Rows are dealt by ranges of (group, order), so that a large group is cut by its order, and written with the number of
their range; the rows of a group before a range are then summed from counts by range.  Only rows that are the same in
the group and all of the order must share a range.  Null orders come first, equal ones have any order among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_folder


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with `part` (their range), `pos` (from 0 in the group's order) and `size` (rows of the group).

    Within a part the rows of a group come in their order.  Groups must not be null.  The rows are written to the shared folder."""
    folder = stage_folder(df.sparkSession, "ranked")
    df.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    counts = rows.groupBy("part", *group).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    counts = counts.select("part", *group, F.coalesce(F.sum("_n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    here = Window.partitionBy("part", *group).orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(here)).join(counts, ["part", *group]).withColumn("pos", F.col("_before") + F.col("_row") - 1).drop("_before", "_row")
