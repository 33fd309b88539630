"""Quantiles of many columns at once.

``exact`` interpolates linearly between neighbouring values. Summaries of the
columns, made within the tasks and merged, give every wanted rank or two
values it lies between; passes over what lies between settle the rest (see
``statistics``). The counts decide, whatever the data looks like, and no
column is ever gathered.

``approx`` takes the nearest rank from sketches (KLL) in one scan: one sketch
per task and column, merged first by ranges of tasks and then over these, so
that no task merges more than a fixed number of merged ones. Sketches draw at
random, so another run may give a neighbouring value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.missing import present
from tableprep.operators.schema import select_fields
from tableprep.operators.statistics import select_quantiles

# One over the share of the rows by which an approximate rank may be off.
DEFAULT_ACCURACY = 10_000
# Sizes that Spark takes for a sketch, and the published error
# of a rank, in shares of the rows: ERROR[0] / size ** ERROR[1].
SKETCH_SIZES = (8, 65_535)
ERROR = (2.296, 0.9021)
# Ranges of tasks whose sketches are merged first.
RANGES = 32
# Bytes of sketches that a task holds; more columns take another scan.
SKETCH_BYTES = 1 << 28


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    method: str = "exact",
    accuracy: int = DEFAULT_ACCURACY,
    room: int | None = None,
) -> dict[str, list[float] | None]:
    """Quantiles by column; None for a column without any value.

    Missing cells are left out. ``accuracy`` is for ``approx``: ranks are off
    by at most the rows divided by it, in 99 of 100 runs; Spark's largest
    sketch bounds it at about ten thousand, and is exact up to 65,535 rows.
    ``room`` is for ``exact``: the values a summary holds.
    """
    if not columns:
        return {}
    if method == "exact":
        return select_quantiles(df, columns, probabilities, room)
    if method != "approx":
        raise ValueError(f"method must be 'exact' or 'approx', not {method!r}")
    size = sketch_size(accuracy)
    share = max(1, SKETCH_BYTES // (16 * size))
    found: dict[str, list[float] | None] = {}
    for start in range(0, len(columns), share):
        found |= _sketched(df, list(columns[start : start + share]), probabilities, size)
    return found


def sketch_size(accuracy: int) -> int:
    least, most = SKETCH_SIZES
    factor, power = ERROR
    return min(most, max(least, math.ceil((factor * accuracy) ** (1 / power))))


def _sketched(
    df: DataFrame, columns: list[str], probabilities: Sequence[float], size: int
) -> dict[str, list[float] | None]:
    fields = select_fields(df, columns)
    values = df.select(*[present(f).alias(f"x{i}") for i, f in enumerate(fields)])
    names, wanted = values.columns, F.lit([float(p) for p in probabilities])
    # A column without values has no sketch to ask.
    sketched = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(RANGES)).alias("range")).agg(
        *[F.count(x).alias(f"n_{x}") for x in names],
        *[F.kll_sketch_agg_double(x, size).alias(x) for x in names],
    )
    merged = sketched.agg(
        *[F.sum(f"n_{x}").alias(f"n_{x}") for x in names],
        *[F.kll_merge_agg_double(F.when(F.col(f"n_{x}") > 0, F.col(x)), size).alias(x) for x in names],
    )
    row = merged.select(
        *[F.when(F.col(f"n_{x}") > 0, F.kll_sketch_get_quantile_double(x, wanted)).alias(x) for x in names]
    ).first()
    return {c: None if row[x] is None else list(row[x]) for c, x in zip(columns, names)}


def long_form(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(i, x)``: the values of all columns under their position."""
    return values.select(F.posexplode(F.array(*names)).alias("i", "x")).where(
        F.col("x").isNotNull()
    )
