"""What counts as a missing cell, by column type.

NULL is missing for every type. NaN is missing for float and double only; no
other type may reach ``isnan``, which rejects dates and booleans and fails on
text under ANSI casts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StructField

from tableprep.functions.names import quoted


def can_be_nan(data_type: DataType) -> bool:
    return isinstance(data_type, (FloatType, DoubleType))


def is_valid(field: StructField, nan_is_missing: bool = True) -> Column:
    column = quoted(field.name)
    if nan_is_missing and can_be_nan(field.dataType):
        # Two conjuncts, so that the null test still reaches the scan.
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def is_missing(field: StructField, nan_is_missing: bool = True) -> Column:
    return ~is_valid(field, nan_is_missing)


def present(field: StructField) -> Column:
    """The value as double, NULL where missing."""
    column = quoted(field.name)
    if can_be_nan(field.dataType):
        column = F.when(~F.isnan(column), column)
    return column.cast("double")


def finite(field: StructField) -> Column:
    """The value as double, NULL where missing or infinite."""
    value = present(field)
    if can_be_nan(field.dataType):
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    return value
