"""Pearson correlation of every pair of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableprep.functions.names import any_headers
from tableprep.operators.schema import numeric_columns
from tableprep.operators.statistics import Requests, Statistics

SCHEMA = "col_x string, col_y string, corr double"


@any_headers
def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col_x, col_y, corr)``, the full matrix in long form.

    Each pair uses the rows in which both values are present. A pair with a
    column that is constant there or has infinite values, or with fewer than
    two such rows, is NULL.

    One scan: matrix products within the tasks give the centred moments of
    every pair, which merge by pair. The driver holds a few numbers per pair.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    asked = Requests(df)
    asked.pairs(columns)
    return correlation_table(df, columns, asked.answer())


def correlation_table(df: DataFrame, columns: Sequence[str], statistics: Statistics) -> DataFrame:
    entries = [(x, y, statistics.correlations.get((x, y))) for x in columns for y in columns]
    return df.sparkSession.createDataFrame(entries, SCHEMA)
