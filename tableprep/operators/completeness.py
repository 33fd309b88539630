"""Missing cells: counting them, and dropping what is too sparse.

Counting is one aggregate over all columns. Each task sends one row of counts,
so neither the number of rows nor a skewed column matters to the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tableprep.functions.missing import can_be_nan, is_valid
from tableprep.functions.names import any_headers, quoted
from tableprep.operators.schema import replace_columns

# The tokens a CSV reader with default settings of the pandas
# library takes for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class CellCounts:
    """Row count, and per column the number of NULL and of NaN cells."""

    rows: int
    nulls: dict[str, int]
    nans: dict[str, int]

    def missing(self, column: str, nan_is_missing: bool = True) -> int:
        return self.nulls[column] + (self.nans[column] if nan_is_missing else 0)

    def complete(self, nan_is_missing: bool = True) -> set[str]:
        return {c for c in self.nulls if self.missing(c, nan_is_missing) == 0}


def _positional(df: DataFrame) -> DataFrame:
    """Columns renamed by position, so that any header can be referenced."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _count_row(df: DataFrame) -> DataFrame:
    plain = _positional(df)
    counts = [F.count(F.lit(1)).alias("rows")]
    for field in plain.schema:
        counts.append(F.count(field.name).alias(f"v_{field.name}"))
        if can_be_nan(field.dataType):
            counts.append(F.count_if(F.isnan(field.name)).alias(f"nan_{field.name}"))
    return plain.agg(*counts)


def count_cells(df: DataFrame) -> CellCounts:
    """One pass over the table; the driver gets one row of counts."""
    row = _count_row(df).first().asDict()
    nulls = {c: row["rows"] - row[f"v_c{i}"] for i, c in enumerate(df.columns)}
    nans = {c: row.get(f"nan_c{i}", 0) for i, c in enumerate(df.columns)}
    return CellCounts(row["rows"], nulls, nans)


def missing_counts(df: DataFrame, nan_is_missing: bool = True) -> DataFrame:
    """``(column, rows, missing)``, one row per column, from one aggregate."""
    counted = _count_row(df)
    entries = []
    for i, name in enumerate(df.columns):
        missing = F.col("rows") - F.col(f"v_c{i}")
        if nan_is_missing and f"nan_c{i}" in counted.columns:
            missing = missing + F.col(f"nan_c{i}")
        entries.append(
            F.struct(
                F.lit(name).alias("column"), F.col("rows").alias("rows"), missing.alias("missing")
            )
        )
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, rows bigint, missing bigint")
    return counted.select(F.inline(F.array(*entries)))


def fill_ratio(df: DataFrame, nan_is_missing: bool = True) -> DataFrame:
    """``(column, rows, valid, fill_ratio)``; the ratio of an empty table is NULL."""
    valid = F.col("rows") - F.col("missing")
    return missing_counts(df, nan_is_missing).select(
        "column",
        "rows",
        valid.alias("valid"),
        F.try_divide(valid.cast("double"), F.col("rows")).alias("fill_ratio"),
    )


def _check_rounding(rounding: str) -> None:
    if rounding not in ("ratio", "floor"):
        raise ValueError(f"rounding must be 'ratio' or 'floor', not {rounding!r}")


def _enough(valid: int, total: int, threshold: float, rounding: str) -> bool:
    if total == 0:
        return True
    if rounding == "floor":
        return valid >= int(threshold * total)
    return valid / total >= threshold


def well_filled(
    counts: CellCounts,
    columns: Sequence[str],
    threshold: float = 0.5,
    rounding: str = "ratio",
    nan_is_missing: bool = True,
) -> list[str]:
    """Columns whose share of valid cells is at least the threshold."""
    _check_rounding(rounding)
    return [
        c
        for c in columns
        if _enough(
            counts.rows - counts.missing(c, nan_is_missing), counts.rows, threshold, rounding
        )
    ]


@any_headers
def drop_sparse_columns(
    df: DataFrame,
    threshold: float = 0.5,
    rounding: str = "ratio",
    nan_is_missing: bool = True,
    counts: CellCounts | None = None,
) -> DataFrame:
    """Keep columns filled to at least ``threshold``.

    The result's schema depends on the data, so this runs one aggregate unless
    ``counts`` are given.
    """
    counts = counts or count_cells(df)
    kept = well_filled(counts, df.columns, threshold, rounding, nan_is_missing)
    return df.select(*[quoted(c) for c in kept])


def _balanced_sum(terms: list[Column]) -> Column:
    """A sum of logarithmic depth, safe for thousands of columns."""
    if len(terms) == 1:
        return terms[0]
    middle = len(terms) // 2
    return _balanced_sum(terms[:middle]) + _balanced_sum(terms[middle:])


def row_fill_condition(
    df: DataFrame,
    threshold: float = 0.5,
    rounding: str = "ratio",
    nan_is_missing: bool = True,
    complete: Collection[str] = (),
) -> Column | None:
    """The test of :func:`drop_sparse_rows`, or None where every row passes.

    ``complete`` names columns known to have no missing cell. They are counted
    without being read, which keeps wide text columns out of the scan.
    """
    _check_rounding(rounding)
    total = len(df.columns)
    needed = next((n for n in range(total) if _enough(n, total, threshold, rounding)), total)
    open_fields = [f for f in df.schema if f.name not in complete]
    needed -= total - len(open_fields)
    if needed <= 0 or total == 0:
        return None
    if not open_fields:
        return F.lit(False)
    valid_cells = _balanced_sum([is_valid(f, nan_is_missing).cast("int") for f in open_fields])
    return valid_cells >= needed


@any_headers
def drop_sparse_rows(
    df: DataFrame,
    threshold: float = 0.5,
    rounding: str = "ratio",
    nan_is_missing: bool = True,
    complete: Collection[str] = (),
) -> DataFrame:
    """Keep rows in which at least ``threshold`` of the cells are valid."""
    condition = row_fill_condition(df, threshold, rounding, nan_is_missing, complete)
    return df if condition is None else df.where(condition)


def na_condition(
    df: DataFrame, counts: CellCounts, threshold: float = 0.5, nan_is_missing: bool = True
) -> Column | None:
    """The test of :func:`drop_na_rows`, or None where every row passes.

    Only columns that do have missing cells are tested.
    """
    condition = None
    for field in df.schema:
        missing = counts.missing(field.name, nan_is_missing)
        if counts.rows == 0 or missing == 0:
            continue
        if (counts.rows - missing) / counts.rows > threshold:
            test = is_valid(field, nan_is_missing)
            condition = test if condition is None else condition & test
    return condition


@any_headers
def drop_na_rows(
    df: DataFrame,
    threshold: float = 0.5,
    nan_is_missing: bool = True,
    counts: CellCounts | None = None,
) -> DataFrame:
    """Drop rows with a missing cell in a column filled above ``threshold``."""
    counts = counts or count_cells(df)
    condition = na_condition(df, counts, threshold, nan_is_missing)
    return df if condition is None else df.where(condition)


@any_headers
def null_tokens(
    df: DataFrame,
    tokens: Sequence[str] = MISSING_TOKENS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Replace text cells that stand for a missing value by NULL."""
    wanted = set(df.columns if columns is None else columns)
    replacements = {}
    for field in df.schema:
        if field.name in wanted and isinstance(field.dataType, StringType):
            column = quoted(field.name)
            replacements[field.name] = F.when(~column.isin(*tokens), column)
    return replace_columns(df, replacements)
