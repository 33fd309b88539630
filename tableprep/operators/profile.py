"""Table shape, missing cells, column types and timings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.operators.completeness import missing_counts


def shape(df: DataFrame) -> DataFrame:
    """``(rows, columns, cells)``."""
    columns = F.lit(len(df.columns)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", columns.alias("columns"), (F.col("rows") * columns).alias("cells")
    )


def nonconforming_cells(df: DataFrame) -> DataFrame:
    """``(column, n)``: NULL and NaN cells of every column, in one aggregate."""
    return missing_counts(df).select("column", F.col("missing").alias("n"))


def missing_percent(df: DataFrame) -> DataFrame:
    """``(column, missing_percent)``; NULL for an empty table."""
    return missing_counts(df).select(
        "column",
        F.try_divide(100.0 * F.col("missing"), F.col("rows")).alias("missing_percent"),
    )


def type_names(df: DataFrame) -> DataFrame:
    """``(column, type)`` from the schema."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.typeName().capitalize()) for f in df.schema],
        "column string, type string",
    )


def column_types(df: DataFrame) -> DataFrame:
    """``(type, columns)``: how many columns have each type; reads no data."""
    return type_names(df).groupBy("type").agg(F.count(F.lit(1)).alias("columns"))


def timing_table(
    spark: SparkSession, timings: Iterable[tuple[str, str, float]]
) -> DataFrame:
    """``(step, kind, seconds, minutes)``."""
    return spark.createDataFrame(
        list(timings), "step string, kind string, seconds double"
    ).withColumn("minutes", F.col("seconds") / 60)


def timing_summary(timings: DataFrame) -> DataFrame:
    """``(kind, seconds, minutes)`` with a ``total`` row."""
    return timings.rollup("kind").agg(
        F.sum("seconds").alias("seconds"), F.sum("minutes").alias("minutes")
    ).select(F.coalesce("kind", F.lit("total")).alias("kind"), "seconds", "minutes")
