"""Safe references to columns whatever their names hold."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of results that hold column names.
NAMING = ("column", "col_x", "col_y")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_headers(out: DataFrame, header_of: dict[str, str]) -> DataFrame:
    """Plain names in a result's columns of names become headers."""
    named = F.create_map(*[F.lit(x) for pair in header_of.items() for x in pair])
    return out.withColumns({c: named[F.col(c)] for c in NAMING if c in out.columns})


def any_headers(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets an operator take a table whose headers differ only in case.

    Spark cannot refer to such a column by name. The operator then runs on
    plain names, and its result gets the headers back, as columns or as the
    values of a column of names. Lists of arguments name columns by their headers.
    """

    @wraps(operator)
    def run(df: DataFrame, *args: Any, **options: Any) -> DataFrame:
        headers = df.columns
        if len({h.lower() for h in headers}) == len(headers):
            return operator(df, *args, **options)
        plain = {h: f"c{i}" for i, h in enumerate(headers)}

        def renamed(value: Any) -> Any:
            if isinstance(value, (list, tuple)):
                return [plain.get(v, v) if isinstance(v, str) else v for v in value]
            return value

        out = operator(
            df.toDF(*plain.values()),
            *[renamed(a) for a in args],
            **{k: renamed(v) for k, v in options.items()},
        )
        header_of = {p: h for h, p in plain.items()}
        if set(out.columns) <= header_of.keys():
            return out.toDF(*[header_of[c] for c in out.columns])
        return with_headers(out, header_of)

    return run
