"""The full cleaning run.

Steps: normalise headers, drop sparse columns, drop sparse rows, drop rows
with missing cells in well-filled columns, normalise text, drop outliers, keep
one row per key.

Every step but the last is a projection or a row test. Deciding the tests
takes one aggregate over the raw table, one more if any column has missing
cells, and the quantile passes for the fences. Columns known to have no
missing cell are not tested, so a quantile pass reads only numeric columns and
columns with holes. The cleaned table stays a lazy plan: one scan, one
projection, one filter, and the shuffle of the deduplication.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tableprep.functions.names import quoted
from tableprep.functions.text import normalize_text
from tableprep.operators import typos as typo_operators
from tableprep.operators.completeness import (
    CellCounts,
    count_cells,
    na_condition,
    row_fill_condition,
    well_filled,
)
from tableprep.operators.dedup import dedup_by_key
from tableprep.operators.outliers import IQR_FACTOR, fence_table, find_fences, inside_fences
from tableprep.operators.profile import timing_table
from tableprep.operators.quantiles import DEFAULT_ACCURACY
from tableprep.operators.schema import (
    normalized_names,
    numeric_columns,
    replace_columns,
    resolve_columns,
    string_columns,
)


@dataclass(frozen=True)
class CleanConfig:
    # Thresholds, typo and fence parameters of a default run.
    column_threshold: float = 0.5
    row_threshold: float = 0.5
    na_threshold: float = 0.5
    typo_threshold: int = 2
    typo_top_n: int = 100
    iqr_factor: float = IQR_FACTOR

    rounding: str = "ratio"
    nan_is_missing: bool = True
    outlier_mode: str = "sequential"
    quantile_method: str = "exact"
    quantile_accuracy: int = DEFAULT_ACCURACY
    #: Values that a summary of a column holds, for exact quantiles.
    quantile_room: int | None = None
    skip_zero_iqr: bool = False
    #: Reads the keys before, and shuffles only rows of keys that stand more than once.
    spare_unique: bool = False
    unicode_ws: bool = False
    squeeze_after: bool = False


@dataclass
class CleanResult:
    """A cleaned table with what was decided and seen on the way.

    ``cleaned``, ``typos``, ``step_counts`` and ``removed`` are lazy: they
    cost nothing unless read. The last three are not even planned before.
    """

    cleaned: DataFrame
    keys: list[str]
    nonconforming: DataFrame
    fences: DataFrame
    timings: DataFrame
    dropped_columns: list[str]
    skipped_outlier_columns: list[str]
    metrics: dict
    #: Whether an order decides which row of a key survives; if not, readings may differ.
    ordered: bool
    plan_typos: Callable[[], DataFrame] = field(repr=False)
    plan_step_counts: Callable[[], DataFrame] = field(repr=False)
    plan_over: Callable[[DataFrame], CleanResult] = field(repr=False)
    plan_observed: Callable[[DataFrame], tuple[DataFrame, Callable[[], DataFrame]]] = field(repr=False)

    @cached_property
    def typos(self) -> DataFrame:
        """``(column, value, possible_typos, n)``, of the values before they are normalised."""
        return self.plan_typos()

    @cached_property
    def step_counts(self) -> DataFrame:
        """``(step_no, step, rows, columns, cells)``."""
        return self.plan_step_counts()

    def over(self, df: DataFrame) -> CleanResult:
        """The same decisions over another reading of the same table; nothing is read."""
        return self.plan_over(df)

    def observed(self) -> tuple[DataFrame, Callable[[], DataFrame]]:
        """The cleaned table, and a function that gives the step counts once it was written.

        The rows after each step are counted while the table is written, so
        they cost no pass of their own.
        """
        return self.plan_observed(self.cleaned)

    @property
    def removed(self) -> DataFrame:
        """``(removed_rows, removed_columns)`` of the whole run."""
        first = F.struct("rows", "columns")
        return self.step_counts.agg(
            F.min_by(first, "step_no").alias("before"), F.max_by(first, "step_no").alias("after")
        ).select(
            (F.col("before.rows") - F.col("after.rows")).alias("removed_rows"),
            (F.col("before.columns") - F.col("after.columns")).alias("removed_columns"),
        )


class StepClock:
    def __init__(self) -> None:
        self.timings: list[tuple[str, str, float]] = []

    @contextmanager
    def step(self, name: str, kind: str = "main"):
        start = time.perf_counter()
        yield
        self.timings.append((name, kind, time.perf_counter() - start))


def _where(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def clean(
    df: DataFrame,
    keys: str | Sequence[str],
    config: CleanConfig = CleanConfig(),
    order_by: Sequence[str] | None = None,
) -> CleanResult:
    """Clean a table; ``keys`` are given by raw or by normalised name.

    The table is read several times, so it should be cheap to re-read and give
    the same rows each time; stage it first if it is not (see ``stage_table``).
    """
    raw_keys = [keys] if isinstance(keys, str) else list(keys)
    clock = StepClock()
    nan_missing = config.nan_is_missing
    raw_names = df.columns

    with clock.step("normalize headers"):
        table = df.toDF(*normalized_names(raw_names))
        keys = resolve_columns(raw_names, raw_keys)
        order = resolve_columns(raw_names, order_by) if order_by else None

    with clock.step("count cells"):
        counts = count_cells(table)

    with clock.step("drop sparse columns"):
        kept = well_filled(
            counts, table.columns, config.column_threshold, config.rounding, nan_missing
        )
        dropped = [c for c in table.columns if c not in kept]
        lost = [c for c in keys + (order or []) if c in dropped]
        if lost and kept:
            raise ValueError(f"columns {lost} are too sparse to serve as key or order")
        table = table.select(*[quoted(c) for c in kept])

    nonconforming = _nonconforming(df, raw_names, counts)
    if not kept:
        return _nothing_left(df, keys, nonconforming, clock, dropped, counts)

    with clock.step("drop sparse rows"):
        complete = counts.complete(nan_missing)
        rows_test = row_fill_condition(
            table, config.row_threshold, config.rounding, nan_missing, complete
        )
        filled = _where(table, rows_test)

    with clock.step("drop rows with missing values"):
        if all(c in complete for c in kept):
            left, na_test = counts, None
        else:
            # With no row dropped, the counts of the first pass still hold.
            left = counts if rows_test is None else count_cells(filled)
            na_test = na_condition(filled, left, config.na_threshold, nan_missing)
        solid = _where(filled, na_test)

    texts = {}
    for name in string_columns(solid):
        with clock.step(f"clean column {name}", "column"):
            texts[name] = normalize_text(
                quoted(name), config.unicode_ws, config.squeeze_after
            )
    # Keys are compared as normalised. Other text is normalised last, when the
    # outliers and duplicates are gone, with the same result.
    early = {c: text for c, text in texts.items() if c in keys or c in (order or ())}
    late = {c: text for c, text in texts.items() if c not in early}
    keyed = replace_columns(solid, early)

    with clock.step("drop outliers"):
        # Text does not matter here; without it the passes read fewer columns.
        if config.quantile_method == "exact":
            options = {"room": config.quantile_room}
        else:
            options = {"accuracy": config.quantile_accuracy}
        fences = find_fences(
            solid,
            numeric_columns(solid, exclude=keys),
            config.outlier_mode,
            config.quantile_method,
            config.iqr_factor,
            config.skip_zero_iqr,
            **options,
        )
        fence_test, skipped = inside_fences(keyed, fences, config.skip_zero_iqr)
        fenced = _where(keyed, fence_test)

    with clock.step("drop duplicates"):
        cleaned = replace_columns(
            dedup_by_key(fenced, keys, order, spare_unique=config.spare_unique), late
        )

    def planned(source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The normalised table, the one without missing values and the one inside the fences."""
        table = source.toDF(*normalized_names(raw_names)).select(*[quoted(c) for c in kept])
        solid = _where(_where(table, rows_test), na_test)
        return table, solid, _where(replace_columns(solid, early), fence_test)

    def over(source: DataFrame) -> CleanResult:
        return result_of(source, finished(planned(source)[2]))

    def finished(fenced: DataFrame) -> DataFrame:
        return replace_columns(dedup_by_key(fenced, keys, order, spare_unique=False), late)

    def observed(source: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
        table, _, _ = planned(source)
        before, after = Observation(), Observation()
        tests = _step_tests(len(raw_names), len(kept), rows_test, na_test, fence_test)
        watched = table.observe(before, *_step_counters(tests))
        solid = _where(_where(watched, rows_test), na_test)
        out = finished(_where(replace_columns(solid, early), fence_test))
        out = out.observe(after, F.count(F.lit(1)).alias("rows"))
        return out, lambda: _observed_steps(source, tests, before.get, after.get["rows"])

    def result_of(source: DataFrame, cleaned: DataFrame) -> CleanResult:
        table, solid, fenced = planned(source)
        return CleanResult(
            cleaned=cleaned,
            keys=keys,
            nonconforming=nonconforming,
            fences=fence_table(df, fences),
            timings=timing_table(df.sparkSession, clock.timings),
            dropped_columns=dropped,
            skipped_outlier_columns=skipped,
            metrics={"rows": counts.rows, "rows_after_sparse_rows": left.rows},
            ordered=order is not None,
            plan_typos=lambda: typo_operators.typo_values(
                solid, None, config.typo_threshold, config.typo_top_n
            ),
            plan_step_counts=lambda: _step_counts(
                table, len(raw_names), rows_test, na_test, fence_test, fenced, keys
            ),
            plan_over=over,
            plan_observed=lambda _: observed(source),
        )

    return result_of(df, cleaned)


def _nonconforming(df: DataFrame, raw_names: Sequence[str], counts: CellCounts) -> DataFrame:
    """From the counts of the first pass, under the raw names."""
    cells = [
        (raw, counts.missing(new)) for raw, new in zip(raw_names, counts.nulls)
    ]
    return df.sparkSession.createDataFrame(cells, "column string, n bigint")


def _both(first: Column | None, second: Column | None) -> Column | None:
    if first is None or second is None:
        return second if first is None else first
    return first & second


def _count_rows(condition: Column | None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


Steps = list[tuple[str, Column | None, int]]


def _step_tests(raw_columns: int, columns: int, rows_test, na_test, fence_test) -> Steps:
    """Name, row test and number of columns of every step before the deduplication."""
    solid_test = _both(rows_test, na_test)
    return [
        ("initial", None, raw_columns),
        ("drop sparse columns", None, columns),
        ("drop sparse rows", rows_test, columns),
        ("drop rows with missing values", solid_test, columns),
        ("clean columns", solid_test, columns),
        ("drop outliers", _both(solid_test, fence_test), columns),
    ]


def _step_counters(steps: Steps) -> list[Column]:
    return [_count_rows(test).alias(f"s{i}") for i, (_, test, _) in enumerate(steps)]


def _observed_steps(df: DataFrame, steps: Steps, before: dict, after: int) -> DataFrame:
    rows = [(i, name, before[f"s{i}"], width, before[f"s{i}"] * width) for i, (name, _, width) in enumerate(steps)]
    width = steps[-1][2]
    rows.append((len(steps), "drop duplicates", after, width, after * width))
    return df.sparkSession.createDataFrame(
        rows, "step_no bigint, step string, rows bigint, columns bigint, cells bigint"
    )


def _step_counts(table, raw_columns, rows_test, na_test, fence_test, fenced, keys) -> DataFrame:
    """``(step_no, step, rows, columns, cells)``.

    All tests are row-wise, so one aggregate counts the rows after each of
    them; only the last step needs the distinct keys.
    """
    columns = len(table.columns)
    steps = _step_tests(raw_columns, columns, rows_test, na_test, fence_test)
    counted = table.agg(*_step_counters(steps))
    entries = [
        F.struct(
            F.lit(i).cast("bigint").alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"s{i}").alias("rows"),
            F.lit(width).cast("bigint").alias("columns"),
        )
        for i, (name, _, width) in enumerate(steps)
    ]
    last = (
        fenced.select(*[quoted(k) for k in keys])
        .distinct()
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.lit(len(steps)).cast("bigint").alias("step_no"),
            F.lit("drop duplicates").alias("step"),
            "rows",
            F.lit(columns).cast("bigint").alias("columns"),
        )
    )
    stacked = counted.select(F.inline(F.array(*entries))).unionByName(last)
    return stacked.withColumn("cells", F.col("rows") * F.col("columns"))


def _nothing_left(df, keys, nonconforming, clock, dropped, counts) -> CleanResult:
    """Every column is too sparse: the input comes back, noted in the metrics."""
    spark = df.sparkSession
    rows, columns = counts.rows, len(df.columns)

    def initial() -> DataFrame:
        return spark.createDataFrame(
            [(0, "initial", rows, columns, rows * columns)],
            "step_no bigint, step string, rows bigint, columns bigint, cells bigint",
        )

    return CleanResult(
        cleaned=df,
        keys=keys,
        nonconforming=nonconforming,
        fences=fence_table(df, []),
        timings=timing_table(spark, clock.timings),
        dropped_columns=[],
        skipped_outlier_columns=[],
        metrics={"rows": rows, "all_columns_sparse": dropped},
        ordered=True,
        plan_over=lambda source: _nothing_left(source, keys, nonconforming, clock, dropped, counts),
        plan_observed=lambda cleaned: (cleaned, initial),
        plan_typos=lambda: typo_operators.typo_values(df, []),
        plan_step_counts=initial,
    )
