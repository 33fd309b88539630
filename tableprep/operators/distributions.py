"""Histograms, density estimates and boxplot numbers of numeric columns.

Each asks for a few numbers per column (see ``statistics``), which go back
into the plan as literals, so the second pass over the table is map-side work
with a small aggregate at the end. Missing and infinite values are left out.
``Bins`` and ``Cells`` are the second passes of a histogram and of a density
estimate; one scan can serve both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.missing import finite
from tableprep.functions.names import any_headers
from tableprep.operators.outliers import IQR_FACTOR
from tableprep.operators.quantiles import long_form, quantiles
from tableprep.operators.schema import numeric_columns, select_fields
from tableprep.operators.statistics import Requests, Statistics
from tableprep.sources.tables import stage_table

DEFAULT_GRID = 200
# Beyond this a double does not tell one bin from the next.
MOST_BINS = 2**53

HISTOGRAM_SCHEMA = "column string, bin bigint, lower double, upper double, n bigint"
DENSITY_SCHEMA = "column string, x double, density double"
BOXPLOT_SCHEMA = (
    "column string, n bigint, min double, whisker_low double, q1 double, median double, "
    "q3 double, whisker_high double, max double, outliers bigint"
)


# Values within a bandwidth of a cell's middle count by their first powers. With
# cells of half a bandwidth and powers up to this, what is left out of a kernel is
# below 1.09 * sum(0.25 ** k / sqrt(k!) for k > ORDER) = 4e-12 of its height.
ORDER = 11
CELL = 0.5
# In bandwidths. A kernel is below 1e-18 of its height there.
REACH = 9.1
# The distribution passes that a row of partial results belongs to.
OF_BINS, OF_CELLS = 0, 1


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Finite values as doubles ``x0, x1, ...``."""
    fields = select_fields(df, columns)
    return df.select(*[finite(f).alias(f"x{i}") for i, f in enumerate(fields)])


def _auto_bins(count: int, spread: float, iqr: float) -> int | None:
    """The narrower of the Sturges and the Freedman-Diaconis bin width; None if bins can't be numbered."""
    width = spread / (math.log2(count) + 1)
    by_iqr = 2 * iqr / count ** (1 / 3)
    if by_iqr > 0:
        width = min(width, by_iqr)
    number = spread / width if width > 0 else math.inf
    return max(1, math.ceil(number)) if number <= MOST_BINS else None


@dataclass
class Bins:
    """The bins of some columns: numbers by position among ``names``."""

    names: list[str]
    lows: list[float]
    highs: list[float]
    widths: list[float]
    numbers: list[int]
    #: Rows for columns that bins don't fit.
    whole: list[tuple]

    @staticmethod
    def ask(asked: Requests, columns: Sequence[str], bins: int | str, exact: bool = True) -> None:
        asked.spread(columns)
        if bins == "auto" and exact:
            asked.quantiles(columns, (0.25, 0.75))

    @classmethod
    def of(cls, statistics: Statistics, columns: Sequence[str], bins: int | str, quartiles=None) -> Bins:
        out = cls([], [], [], [], [], [])
        for column in columns:
            of_column = statistics.spread[column]
            if not of_column.n:
                continue
            low, high = of_column.low, of_column.high
            spread = high - low
            if math.isinf(spread):
                wanted = None
            elif spread == 0:
                wanted = 1
            elif bins == "auto":
                q1, q3 = quartiles[column] if quartiles else statistics.quantiles(column, (0.25, 0.75))
                wanted = _auto_bins(of_column.n, spread, q3 - q1)
            else:
                wanted = int(bins)
            if wanted is None:
                out.whole.append((column, None, low, high, of_column.n))
                continue
            out.names.append(column)
            out.lows.append(low)
            out.highs.append(high)
            out.widths.append(spread / wanted)
            out.numbers.append(wanted)
        return out

    def _of_column(self) -> tuple[Column, ...]:
        lists = (self.lows, self.highs, self.widths, self.numbers)
        return tuple(F.lit(values)[F.col("i")] for values in lists)

    def number(self) -> Column:
        """The bin of the value ``x`` of column ``i``."""
        low, _, width, last = self._of_column()
        position = F.floor((F.col("x") - low) / width)
        number = F.when(width == 0, F.lit(1)).otherwise(F.least(position, last - 1) + 1)
        return number.cast("bigint")

    def table(self, counted: DataFrame | None, like: DataFrame) -> DataFrame:
        """The histogram from ``(i, bin, n)``."""
        whole = like.sparkSession.createDataFrame(self.whole, HISTOGRAM_SCHEMA)
        if not self.names:
            return whole
        low, high, width, last = self._of_column()
        upper = F.when(F.col("bin") == last, high).otherwise(low + F.col("bin") * width)
        binned = counted.select(
            F.lit(self.names)[F.col("i")].alias("column"),
            "bin",
            (low + (F.col("bin") - 1) * width).alias("lower"),
            upper.alias("upper"),
            "n",
        )
        return binned.unionByName(whole) if self.whole else binned


@any_headers
def histogram(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int | str = "auto",
    method: str = "exact",
) -> DataFrame:
    """``(column, bin, lower, upper, n)`` for the bins that hold a value.

    Bins are numbered from 1, have equal width and exclude their upper edge,
    except that the last one holds the maximum. ``method`` is the quantile
    method behind ``bins="auto"``. Where a column's range is beyond a double,
    or so wide for its middle half that its bins can't be numbered exactly, it
    gets one row for all of its values, with a NULL bin.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    asked = Requests(df)
    Bins.ask(asked, columns, bins, method == "exact")
    quartiles = approximate_quartiles(df, columns, method) if bins == "auto" and columns else None
    planned = Bins.of(asked.answer(), columns, bins, quartiles)
    if not planned.names:
        return planned.table(None, df)
    values = _numbers(df, planned.names)
    counted = (
        long_form(values, values.columns)
        .select("i", planned.number().alias("bin"))
        .groupBy("i", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return planned.table(counted, df)


def approximate_quartiles(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, list[float]] | None:
    """Quartiles of the finite values by another method than the exact one."""
    if method == "exact":
        return None
    values = _numbers(df, columns)
    found = quantiles(values, values.columns, (0.25, 0.75), method)
    return dict(zip(columns, found.values()))


@dataclass
class Cells:
    """The density grid of some columns: numbers by position among ``names``.

    Values count as shares of their column's range. A cell is half a bandwidth
    wide and holds the sums of the first powers of its values' distances from
    its middle, in bandwidths. From these the kernels of all its values follow
    at any point (a Taylor expansion, whose terms are Hermite polynomials).
    Only cells within reach of a grid point are kept, so there are at most
    about forty for each point, whatever the table holds.
    """

    names: list[str]
    lows: list[float]
    ranges: list[float]
    widths: list[float]
    scales: list[float]
    points: int

    @classmethod
    def of(cls, statistics: Statistics, columns: Sequence[str], points: int, bandwidth: float | str) -> Cells:
        out = cls([], [], [], [], [], points)
        for column in columns:
            s = statistics.spread[column]
            if s.n < 2 or not 0 < (spread := s.high - s.low) < math.inf:
                continue
            if bandwidth == "scott":
                width = s.deviation / spread * s.n ** (-1 / 5)
            else:
                width = float(bandwidth) / spread
            out.names.append(column)
            out.lows.append(s.low)
            out.ranges.append(spread)
            out.widths.append(width)
            out.scales.append(1 / (s.n * width * math.sqrt(2 * math.pi)) / spread)
        return out

    def cell(self) -> Column:
        """Number of the cell of the value ``x`` of column ``i``; NULL out of every grid point's reach."""
        share, width = self._share()
        gaps = max(1, self.points - 1)
        nearest = F.rint(share * gaps) / gaps if self.points > 1 else F.lit(0.0)
        near = F.abs(share - nearest) <= REACH * width
        return F.when(near, F.floor(share / (CELL * width)).cast("bigint"))

    def distance(self) -> Column:
        """Of the value from the middle of its ``cell``, in bandwidths."""
        share, width = self._share()
        return share / width - (F.col("cell") + 0.5) * CELL

    def _share(self) -> tuple[Column, Column]:
        i = F.col("i")
        low, spread, width = (F.lit(v)[i] for v in (self.lows, self.ranges, self.widths))
        return (F.col("x") - low) / spread, width

    def table(self, summed: DataFrame) -> DataFrame:
        """The densities from ``(i, cell, n, p1, p2, ...)``."""
        i, gaps = F.col("i"), max(1, self.points - 1)
        share = F.lit([k / gaps for k in range(self.points)])
        width = F.lit(self.widths)[i]
        away = F.col("share") / width - (F.col("cell") + 0.5) * CELL
        sums = ["n", *(f"p{k}" for k in range(1, ORDER + 1))]
        series = sum((F.col(p) * _hermite(k, F.col("away")) for k, p in enumerate(sums)), F.lit(0.0))
        kernels = (
            summed.select("*", F.posexplode(share).alias("at", "share"))
            .select("i", "at", away.alias("away"), *sums)
            .where(F.abs("away") <= REACH + CELL)
            .groupBy("i", "at")
            .agg(F.sum(F.exp(-0.5 * F.col("away") * F.col("away")) * series).alias("kernels"))
        )
        # A point far from all values still has its row.
        grid = summed.sparkSession.range(len(self.names)).select(
            F.col("id").cast("int").alias("i"), F.posexplode(share).alias("at", "share")
        )
        low, spread = F.lit(self.lows)[i], F.lit(self.ranges)[i]
        height = F.greatest(F.coalesce("kernels", F.lit(0.0)), F.lit(0.0))
        return grid.join(kernels, ["i", "at"], "left").select(
            F.lit(self.names)[i].alias("column"),
            (low + F.col("at") * (spread / gaps)).alias("x"),
            (height * F.lit(self.scales)[i]).alias("density"),
        )


def _hermite(k: int, u: Column) -> Column:
    """The probabilists' Hermite polynomial of order ``k`` at ``u`` over ``k!``, by Horner's rule."""
    square, out = u * u, F.lit(0.0)
    for m in range(k // 2 + 1):
        coefficient = (-1) ** m / (factorial(m) * factorial(k - 2 * m) * 2**m)
        out = out * square + coefficient
    return out * u if k % 2 else out


def _powers(rows: DataFrame, *more: str) -> DataFrame:
    """``t, p2, p4, ...``: powers by repeated products, each computed once."""
    rows = rows.select(*more, F.col("t").alias("p1"))
    for k in range(2, ORDER + 1):
        rows = rows.withColumn(f"p{k}", F.col(f"p{k // 2}") * F.col(f"p{k - k // 2}"))
    return rows


def _power_sums() -> list[Column]:
    return [F.sum(f"p{k}").alias(f"p{k}") for k in range(1, ORDER + 1)]


@any_headers
def kde(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    points: int = DEFAULT_GRID,
    bandwidth: float | str = "scott",
) -> DataFrame:
    """``(column, x, density)``: Gaussian kernel density on an even grid.

    The grid runs from the least to the greatest value. ``bandwidth`` is the
    kernel's standard deviation, or ``"scott"`` for the sample deviation times
    ``n ** (-1/5)``. A column with fewer than two distinct values, or whose
    range is beyond a double, has no density. Densities are within 1e-11 of a
    kernel's height of the direct sum. A value costs a few products; tasks add
    up their own values by cell before a shuffle sees them.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    asked = Requests(df)
    asked.spread(columns)
    planned = Cells.of(asked.answer(), columns, points, bandwidth)
    if not planned.names:
        return df.sparkSession.createDataFrame([], DENSITY_SCHEMA)
    values = _numbers(df, planned.names)
    located = (
        long_form(values, values.columns)
        .select("i", "x", planned.cell().alias("cell"))
        .where("cell IS NOT NULL")
        .select("i", "cell", planned.distance().alias("t"))
    )
    summed = _powers(located, "i", "cell").groupBy("i", "cell").agg(F.count(F.lit(1)).alias("n"), *_power_sums())
    return planned.table(summed)


def binned_and_smoothed(df: DataFrame, bins: Bins, cells: Cells) -> tuple[DataFrame, DataFrame]:
    """Histogram and densities from one scan, whose small result is written in the shared folder."""
    names = list(dict.fromkeys([*bins.names, *cells.names]))
    if not names:
        return bins.table(None, df), df.sparkSession.createDataFrame([], DENSITY_SCHEMA)
    values = _numbers(df, names)
    places = [[of.names.index(c) if c in of.names else None for c in names] for of in (bins, cells)]
    both = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(at)[F.col("i")].alias("i")) for kind, at in enumerate(places)))
    one = long_form(values, values.columns).select("x", F.explode(both).alias("to")).select("x", "to.kind", "to.i")
    number = F.when(F.col("kind") == OF_BINS, bins.number() if bins.names else None)
    cell = cells.cell() if cells.names else F.lit(None)
    located = (
        one.where("i IS NOT NULL")
        .select("kind", "i", "x", F.coalesce(number, F.when(F.col("kind") == OF_CELLS, cell)).alias("cell"))
        .where("cell IS NOT NULL")
    )
    distance = cells.distance() if cells.names else F.lit(0.0)
    located = located.select("kind", "i", "cell", F.when(F.col("kind") == OF_CELLS, distance).alias("t"))
    summed = stage_table(
        _powers(located, "kind", "i", "cell")
        .groupBy("kind", "i", "cell")
        .agg(F.count(F.lit(1)).alias("n"), *_power_sums())
    )
    counted = summed.where(F.col("kind") == OF_BINS).select("i", F.col("cell").alias("bin"), "n")
    smoothed = df.sparkSession.createDataFrame([], DENSITY_SCHEMA)
    if cells.names:
        smoothed = cells.table(summed.where(F.col("kind") == OF_CELLS).drop("kind"))
    return bins.table(counted, df), smoothed


def _boxes(df, columns, method, factor) -> dict[str, tuple[float, ...]]:
    """Columns with values, and their quarters and fences."""
    shares = (0.25, 0.5, 0.75)
    if method == "exact":
        asked = Requests(df)
        asked.quantiles(columns, shares)
        statistics = asked.answer()
        found = {c: statistics.quantiles(c, shares) for c in columns}
    else:
        values = _numbers(df, columns)
        found = dict(zip(columns, quantiles(values, values.columns, shares, method).values()))
    boxes = {}
    for column, quarters in found.items():
        if quarters is not None:
            spread = factor * (quarters[2] - quarters[0])
            boxes[column] = (*quarters, quarters[0] - spread, quarters[2] + spread)
    return boxes


@any_headers
def boxplot_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "exact",
    factor: float = IQR_FACTOR,
) -> DataFrame:
    """One row per column: extremes, quartiles, whiskers and outlier count.

    Whiskers are the most extreme values within ``factor`` interquartile
    ranges of the box. Columns without any value are left out.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    boxes = _boxes(df, columns, method, factor) if columns else {}
    if not boxes:
        return df.sparkSession.createDataFrame([], BOXPLOT_SCHEMA)
    values = _numbers(df, list(boxes))
    q1, median, q3, low, high = (
        F.lit(list(of_column))[F.col("i")] for of_column in zip(*boxes.values())
    )
    x = F.col("x")
    inside = x.between(low, high)
    return (
        long_form(values, values.columns)
        .groupBy("i")
        .agg(
            F.count(x).alias("n"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.min(F.when(inside, x)).alias("low"),
            F.max(F.when(inside, x)).alias("high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(
            F.lit(list(boxes))[F.col("i")].alias("column"),
            "n",
            "min",
            # Without a value between box and fence the whisker ends at the box.
            F.least(F.col("low"), q1).alias("whisker_low"),
            q1.alias("q1"),
            median.alias("median"),
            q3.alias("q3"),
            F.greatest(F.col("high"), q3).alias("whisker_high"),
            "max",
            "outliers",
        )
    )


@any_headers
def boxplot_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "exact",
    factor: float = IQR_FACTOR,
) -> DataFrame:
    """``(column, value)``: every point beyond the fences."""
    columns = numeric_columns(df) if columns is None else list(columns)
    boxes = _boxes(df, columns, method, factor) if columns else {}
    if not boxes:
        return df.sparkSession.createDataFrame([], "column string, value double")
    values = _numbers(df, list(boxes))
    low, high = (
        F.lit(list(of_column))[F.col("i")] for of_column in list(zip(*boxes.values()))[3:]
    )
    return (
        long_form(values, values.columns)
        .where(~F.col("x").between(low, high))
        .select(
            F.lit(list(boxes))[F.col("i")].alias("column"), F.col("x").alias("value")
        )
    )
