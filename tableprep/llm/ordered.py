"""Running totals over a whole table in order, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import stage_table


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """The rows with running totals in the given order, each row's own value included.

    Ranges of the order go to tasks, which are written with the number of
    their range. The sums of the ranges, one row each, give what stands before
    a range; the rest are running sums within a range. The result is written
    in the shared folder, so reading it again gives the same rows.
    """
    values = {f"_{name}": value for name, value in totals.items()}
    ranged = stage_table(
        df.withColumns(values)
        .repartitionByRange(*order)
        .withColumn("_range", F.spark_partition_id())
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = (
        ranged.groupBy("_range")
        .agg(*(F.sum(v).alias(v) for v in values))
        .select("_range", *(F.coalesce(F.sum(v).over(before), zero).alias(f"_before{v}") for v in values))
    )
    within = (
        Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return stage_table(
        ranged.withColumns({v: F.sum(v).over(within) for v in values})
        .join(F.broadcast(offsets), "_range")  # a row for each task of the range stage
        .withColumns({name: F.col(f"_{name}") + F.col(f"_before_{name}") for name in totals})
        .select(*df.columns, *totals)
    )
