"""Running values along an order, without any group in one task.

Rows are dealt by ranges of (group, order) and written with the number of their range.  What a range's rows need of the
ranges before it is a value a range and group, which is found from one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import new_folder


def dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with `_part`, in ranges of (group, order); groups and orders must not be null, and an order be of one row in its group."""
    folder = new_folder(rows.sparkSession, "dealt")
    rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def places(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with `place`, their number in their group by this order, from 0 on; groups and orders may be null, and ties are in any order."""
    named = rows.withColumn("_g", F.to_json(F.struct(*group)))  # never null; a null column is left out of it
    found = running(dealt(named, ["_g"], order), ["_g"], order, count={"place": F.lit(True)})
    return found.withColumn("place", F.col("place") - 1).drop("_g", "_part")


def running(rows: DataFrame, group: list[str], order: list[str], last: dict[str, Column] | None = None, count: dict[str, Column] | None = None) -> DataFrame:
    """Dealt rows with, up to and including each row, the last value of some columns that is not null, and how often some conditions held."""
    last, count = last or {}, count or {}
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    found = rows.select("*", *[F.last(c, ignorenulls=True).over(here).alias(f"_l_{n}") for n, c in last.items()], *[F.sum(one(c)).over(here).alias(f"_c_{n}") for n, c in count.items()])
    ends = [F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_b_{n}") for n, c in last.items()]
    totals = rows.groupBy("_part", *group).agg(*ends, *[F.sum(one(c)).alias(f"_s_{n}") for n, c in count.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *group, *[F.last(f"_b_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in last], *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in count])
    found = found.join(totals, ["_part", *group])
    for n in last:
        found = found.withColumn(n, F.coalesce(f"_l_{n}", f"_b_{n}")).drop(f"_l_{n}", f"_b_{n}")
    for n in count:
        found = found.withColumn(n, F.col(f"_c_{n}") + F.col(f"_s_{n}")).drop(f"_c_{n}", f"_s_{n}")
    return found
