"""Interquartile fences and the outlier filter.

Fences are a few numbers per column, computed by aggregates and put into the
filter as literals, so the filter itself is a plain range test that the scan
can push down.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DecimalType,
    IntegerType,
    IntegralType,
    LongType,
    ShortType,
    StructField,
)

from tableprep.functions.missing import can_be_nan
from tableprep.functions.names import any_headers, quoted
from tableprep.operators.quantiles import quantiles
from tableprep.operators.schema import numeric_columns

# Fixed value: fence distance in interquartile ranges.
IQR_FACTOR = 1.5

BITS = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}

# Columns whose fences a sequential run first looks for at once.
LOOK_AHEAD = 8


@dataclass(frozen=True)
class Fence:
    """Quartiles and fences of one column; all None without any value."""

    column: str
    q1: float | None
    q3: float | None
    lower: float | None
    upper: float | None

    @property
    def usable(self) -> bool:
        return self.lower is not None and not math.isnan(self.lower) and not math.isnan(self.upper)

    def holds(self, field: StructField) -> Column:
        """True inside the fences; missing values are not inside."""
        column = quoted(field.name)
        if isinstance(field.dataType, (IntegralType, DecimalType)):
            return _in_own_type(column, field.dataType, self.lower, self.upper)
        inside = column.between(F.lit(self.lower), F.lit(self.upper))
        if can_be_nan(field.dataType) and math.isinf(self.upper):
            inside = inside & ~F.isnan(column)
        return inside


def _in_own_type(column: Column, kind: DataType, lower: float, upper: float) -> Column:
    """The range test with bounds of the column's type, which a scan can check by its statistics.

    A cast of the column to double would keep the test above the scan. The
    bounds are the outermost values of the type inside the fences; a fence
    beyond all values of the type needs no test.
    """
    if isinstance(kind, DecimalType):
        scale, last = kind.scale, 10**kind.precision - 1
    else:
        scale, last = 0, 2 ** (BITS[type(kind)] - 1) - 1
    unit = Decimal(1).scaleb(-scale)
    first = -last if isinstance(kind, DecimalType) else -last - 1
    tests = [column.isNotNull()]
    with localcontext() as context:
        context.prec = 400
        if not math.isinf(lower):
            low = int((Decimal(lower) / unit).to_integral_value(ROUND_CEILING))
            if low > last:
                return column.isNotNull() & F.lit(False)
            if low > first:
                tests.append(column >= F.lit(low * unit if scale else low).cast(kind))
        if not math.isinf(upper):
            high = int((Decimal(upper) / unit).to_integral_value(ROUND_FLOOR))
            if high < first:
                return column.isNotNull() & F.lit(False)
            if high < last:
                tests.append(column <= F.lit(high * unit if scale else high).cast(kind))
    return reduce(and_, tests)


def fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "exact",
    factor: float = IQR_FACTOR,
    **quantile_options,
) -> list[Fence]:
    columns = numeric_columns(df) if columns is None else list(columns)
    found = quantiles(df, columns, (0.25, 0.75), method, **quantile_options)
    result = []
    for column in columns:
        if found[column] is None:
            result.append(Fence(column, None, None, None, None))
            continue
        q1, q3 = found[column]
        spread = factor * (q3 - q1)
        result.append(Fence(column, q1, q3, q1 - spread, q3 + spread))
    return result


def fence_table(df: DataFrame, found: Sequence[Fence]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f.column, f.q1, f.q3, f.lower, f.upper) for f in found],
        "column string, q1 double, q3 double, lower double, upper double",
    )


@any_headers
def quartiles(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact", **options
) -> DataFrame:
    """``(column, q1, q3)``."""
    return fence_table(df, fences(df, columns, method, **options)).select("column", "q1", "q3")


@any_headers
def bounds(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact", **options
) -> DataFrame:
    """``(column, q1, q3, lower, upper)``."""
    return fence_table(df, fences(df, columns, method, **options))


def inside_fences(
    df: DataFrame, found: Sequence[Fence], skip_zero_iqr: bool = False
) -> tuple[Column | None, list[str]]:
    """The row test of all usable fences, and the columns it leaves out."""
    condition, skipped = None, []
    for fence in found:
        if not fence.usable or (skip_zero_iqr and fence.q1 == fence.q3):
            skipped.append(fence.column)
            continue
        inside = fence.holds(df.schema[fence.column])
        condition = inside if condition is None else condition & inside
    return condition, skipped


def _filter(df: DataFrame, found: Sequence[Fence], skip_zero_iqr: bool) -> DataFrame:
    condition, _ = inside_fences(df, found, skip_zero_iqr)
    return df if condition is None else df.where(condition)


def find_fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    mode: str = "joint",
    method: str = "exact",
    factor: float = IQR_FACTOR,
    skip_zero_iqr: bool = False,
    **quantile_options,
) -> list[Fence]:
    """The fences :func:`drop_outliers` filters by."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if mode == "joint":
        return fences(df, columns, method, factor, **quantile_options)
    if mode != "sequential":
        raise ValueError(f"mode must be 'joint' or 'sequential', not {mode!r}")

    # Columns that drop no row leave the later fences as they are. So fences
    # are found for several columns at once, and hold up to and including the
    # first column that drops rows.
    found: list[Fence] = []
    ahead = LOOK_AHEAD
    while len(found) < len(columns):
        window = columns[len(found) : len(found) + ahead]
        step = fences(df, window, method, factor, **quantile_options)
        valid = 1 if len(window) == 1 else _holding(df, step, skip_zero_iqr)
        ahead = 2 * ahead if valid == len(window) else max(1, valid)
        found += step[:valid]
        df = _filter(df, step[:valid], skip_zero_iqr)
    return found


def _holding(df: DataFrame, step: Sequence[Fence], skip_zero_iqr: bool) -> int:
    """How many fences hold one after the other, given all from one table."""
    dropped = []
    for fence in step:
        condition, _ = inside_fences(df, [fence], skip_zero_iqr)
        # A missing value is not inside, so it drops its row as well.
        outside = F.lit(False) if condition is None else ~F.coalesce(condition, F.lit(False))
        dropped.append(F.count_if(outside))
    counts = df.agg(*dropped).first()
    return next((i + 1 for i, n in enumerate(counts) if n), len(step))


@any_headers
def drop_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    mode: str = "joint",
    method: str = "exact",
    factor: float = IQR_FACTOR,
    skip_zero_iqr: bool = False,
    **quantile_options,
) -> DataFrame:
    """Keep rows whose values lie inside the fences, bounds included.

    ``joint`` takes every column's fences from the given table. ``sequential``
    takes them from the table already filtered on the columns before, so it
    depends on the column order and needs passes for every column that drops
    rows. Rows with a
    missing value in a tested column are dropped; a column without any value
    is skipped.
    """
    found = find_fences(df, columns, mode, method, factor, skip_zero_iqr, **quantile_options)
    return _filter(df, found, skip_zero_iqr)
