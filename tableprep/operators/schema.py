"""Headers, column selection by type, and type coercion."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField

from tableprep.functions.names import any_headers, quoted

# Fixed value: what a normalised header may not hold.
HEADER_UNWANTED = r"[^0-9a-zA-Z_]"

# Spark's own cast also reads "1d" and hexadecimal floats as numbers.
NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
BOOLEAN_TEXT = ("true", "True", "TRUE", "false", "False", "FALSE")


def normalized_names(names: Sequence[str]) -> list[str]:
    """Normalised headers by position.

    An empty result becomes ``col_<position>``; a repeated one gets ``_2``,
    ``_3`` and so on.
    """
    result: list[str] = []
    used: set[str] = set()
    for position, raw in enumerate(names, start=1):
        base = re.sub(HEADER_UNWANTED, "", raw.lower().replace(" ", "_"))
        base = base or f"col_{position}"
        name, copy = base, 1
        while name in used:
            copy += 1
            name = f"{base}_{copy}"
        used.add(name)
        result.append(name)
    return result


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def resolve_columns(raw_names: Sequence[str], wanted: Iterable[str]) -> list[str]:
    """Normalised names of columns given by raw or by normalised name."""
    new_names = normalized_names(raw_names)
    by_raw: dict[str, str] = {}
    for raw, new in zip(raw_names, new_names):
        by_raw.setdefault(raw, new)
    resolved = []
    for name in wanted:
        if name in by_raw:
            resolved.append(by_raw[name])
        elif name in new_names:
            resolved.append(name)
        else:
            raise ValueError(f"no column {name!r} among {list(raw_names)}")
    return resolved


def numeric_fields(df: DataFrame, exclude: Iterable[str] = ()) -> list[StructField]:
    skipped = set(exclude)
    return [
        f for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skipped
    ]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of all number columns (integers, floats, decimals; no booleans)."""
    return [f.name for f in numeric_fields(df, exclude)]


def key_candidates(df: DataFrame) -> list[str]:
    """Columns offered as a deduplication key; reads the schema only."""
    return numeric_columns(df)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def select_fields(df: DataFrame, columns: Sequence[str]) -> list[StructField]:
    by_name = {f.name: f for f in df.schema}
    return [by_name[c] for c in columns]


def replace_columns(df: DataFrame, replacements: dict[str, Column]) -> DataFrame:
    """All columns in order, some of them replaced, in one projection."""
    return df.select(
        *[replacements[c].alias(c) if c in replacements else quoted(c) for c in df.columns]
    )


def text_to_double(column: Column) -> Column:
    return F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))


@any_headers
def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn text and boolean columns into numbers; text that is no number becomes NULL.

    Columns of other types keep their type, among them numbers, dates and
    nested values.
    """
    wanted = set(df.columns if columns is None else columns)
    replacements = {}
    for field in df.schema:
        if field.name not in wanted:
            continue
        column = quoted(field.name)
        if isinstance(field.dataType, StringType):
            replacements[field.name] = text_to_double(column)
        elif isinstance(field.dataType, BooleanType):
            replacements[field.name] = column.cast("double")
    return replace_columns(df, replacements)


def infer_types(df: DataFrame) -> DataFrame:
    """Retype text columns whose every value is an integer, number or boolean.

    One aggregate decides for all columns. A column without any value keeps
    its type.
    """
    names = string_columns(df)
    if not names:
        return df
    tests = []
    for i, name in enumerate(names):
        column = quoted(name)
        tests += [
            F.count(column).alias(f"n{i}"),
            F.count(F.trim(column).try_cast("bigint")).alias(f"i{i}"),
            F.count(text_to_double(column)).alias(f"d{i}"),
            F.count_if(column.isin(*BOOLEAN_TEXT)).alias(f"b{i}"),
        ]
    seen = df.agg(*tests).first()
    replacements = {}
    for i, name in enumerate(names):
        column, values = quoted(name), seen[f"n{i}"]
        if values == 0:
            continue
        if seen[f"i{i}"] == values:
            replacements[name] = F.trim(column).try_cast("bigint")
        elif seen[f"d{i}"] == values:
            replacements[name] = text_to_double(column)
        elif seen[f"b{i}"] == values:
            replacements[name] = column.try_cast("boolean")
    return replace_columns(df, replacements)
