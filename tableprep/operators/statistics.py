"""One pass that answers what several artefacts ask of a table.

An artefact asks for extremes and deviations, for quantiles, or for the
moments of pairs. One scan makes the summaries of all of them within the tasks
and merges those of a column in two levels. Quantiles that the merged summary
does not settle come with two values they lie between; another scan counts
what is below and summarises only what lies between, for all columns and
quantiles at once, until all are exact. With ``room`` for a few thousand
values a scan shrinks what is open by about a hundred times or more, and a
column of fewer distinct values is settled by the first.

The driver gets a few numbers for each column and quantile, and for each pair
of columns where pairs are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.missing import finite, present
from tableprep.operators.schema import select_fields
from tableprep.operators.summaries import PairMoments, RankSummary, locate

# Distinct values a column's summary may hold, together and by column.
ROOM_OF_ALL, LEAST_ROOM, MOST_ROOM = 1 << 17, 256, 8192
# Tasks whose summaries are merged first, by their number modulo this.
FIRST_LEVEL = 32
# A table that Spark reckons smaller has few tasks, whose summaries are merged at once.
SMALL_BYTES = 1 << 33

_PARTIAL = (
    "i int, k int, salt int, low double, high double, infinite boolean, moments binary, "
    "below bigint, point binary, weight binary, error bigint"
)
_ANSWER = (
    "i int, k int, low double, high double, infinite boolean, moments binary, "
    "n bigint, rank bigint, value double"
)
# The number that marks rows with moments; intervals are numbered from 0.
MOMENTS = -1

Interval = tuple[float | None, float | None, tuple[int, ...]]


@dataclass(frozen=True)
class Spread:
    """Number of finite values, their extremes (None without any) and sample deviation (NaN below two)."""

    n: int
    low: float | None
    high: float | None
    deviation: float
    infinite: bool


@dataclass
class Statistics:
    """Answers by column."""

    spread: dict[str, Spread] = field(default_factory=dict)
    found: dict[tuple[str, float], float | None] = field(default_factory=dict)
    correlations: dict[tuple[str, str], float | None] = field(default_factory=dict)

    def quantiles(self, column: str, probabilities: Sequence[float]) -> list[float] | None:
        """Interpolated quantiles, or None for a column without any value."""
        values = [self.found[column, p] for p in probabilities]
        return None if None in values else values


class Requests:
    """Collects what is asked of a table's numeric columns, and answers all of it together.

    With ``finite_only`` infinite values count as missing, but a column that
    has some correlates with nothing.
    """

    def __init__(self, df: DataFrame, finite_only: bool = True, room: int | None = None) -> None:
        self.df, self.finite_only, self.room = df, finite_only, room
        self.probabilities: dict[str, set[float]] = {}
        self.spreads: set[str] = set()
        self.paired: list[str] = []

    def quantiles(self, columns: Iterable[str], probabilities: Sequence[float]) -> None:
        for column in columns:
            self.probabilities.setdefault(column, set()).update(probabilities)

    def spread(self, columns: Iterable[str]) -> None:
        self.spreads.update(columns)

    def pairs(self, columns: Iterable[str]) -> None:
        """Pairs of columns that may share no row come out as None."""
        self.paired += [c for c in columns if c not in self.paired]

    def answer(self) -> Statistics:
        asked = {*self.probabilities, *self.spreads, *self.paired}
        columns = [c for c in self.df.columns if c in asked]
        if not columns:
            return Statistics()
        value = present if not self.finite_only or self.paired else finite
        fields = select_fields(self.df, columns)
        values = self.df.select(*[value(f).alias(f"x{i}") for i, f in enumerate(fields)])
        return _Search(values, columns, self).answer()


class _Search:
    def __init__(self, values: DataFrame, columns: list[str], asked: Requests) -> None:
        self.values, self.columns, self.asked = values, columns, asked
        place = {c: i for i, c in enumerate(columns)}
        self.ranked = {place[c]: sorted(p) for c, p in asked.probabilities.items()}
        self.paired = [place[c] for c in asked.paired]
        self.single = sorted({place[c] for c in asked.spreads} - set(self.paired))
        share = ROOM_OF_ALL // max(1, len(self.ranked))
        self.room = min(MOST_ROOM, max(LEAST_ROOM, share)) if asked.room is None else max(2, asked.room)

    def answer(self) -> Statistics:
        out = Statistics()
        found: dict[tuple[int, int], float] = {}
        counts: dict[int, int] = {}
        intervals: dict[int, list[Interval]] = {i: [(None, None, ())] for i in self.ranked}
        first, left = True, math.inf
        while first or intervals:
            rows = self._scan(intervals, with_moments=first)
            if first:
                self._read_moments([r for r in rows if r.k == MOMENTS], out)
                counts = {i: 0 for i in self.ranked} | {r.i: r.n for r in rows if r.k != MOMENTS}
            open_ranks: dict[int, dict[int, tuple[float | None, float | None]]] = {}
            for r in rows:
                if r.k == MOMENTS:
                    continue
                if r.value is not None:
                    found[r.i, r.rank] = r.value
                else:
                    low, high, _ = intervals[r.i][r.k]
                    bounds = (low if r.low is None else r.low, high if r.high is None else r.high)
                    open_ranks.setdefault(r.i, {})[r.rank] = bounds
            still = sum({(r.i, r.k): r.n for r in rows if r.i in open_ranks and r.k != MOMENTS}.values())
            if 4 * still > left:  # with too little room the bounds hardly close in
                self.room *= 4
            intervals = {i: _disjoint(ranks) for i, ranks in open_ranks.items()}
            first, left = False, still
        for i, probabilities in self.ranked.items():
            for p in probabilities:
                position = (counts[i] - 1) * p
                answer = _interpolated(found, i, position) if counts[i] else None
                out.found[self.columns[i], p] = answer
        return out

    def _read_moments(self, rows: list, out: Statistics) -> None:
        by_place = {r.i: r for r in rows}
        parts = {i: PairMoments.from_row(r.moments) for i, r in by_place.items()}
        diagonal = {i: parts[i] for i in self.single if i in parts}
        if self.paired and all(i in parts for i in self.paired):
            matrix = PairMoments.stacked([parts[i] for i in self.paired])
            own = matrix.diagonal()
            diagonal |= {i: PairMoments.from_row(own.row(k)) for k, i in enumerate(self.paired)}
            corr = matrix.correlations()
            for a, i in enumerate(self.paired):
                for b, j in enumerate(self.paired):
                    known = not math.isnan(corr[a, b]) and not by_place[i].infinite and not by_place[j].infinite
                    out.correlations[self.columns[i], self.columns[j]] = float(corr[a, b]) if known else None
        for i in (*self.single, *self.paired):
            if i not in diagonal:  # no task had a row
                out.spread[self.columns[i]] = Spread(0, None, None, math.nan, False)
                continue
            row, own = by_place[i], diagonal[i]
            n, varied = int(own.n[0, 0]), bool(own.varied()[0, 0])
            deviation = float(own.deviations()[0])
            out.spread[self.columns[i]] = Spread(
                n, row.low if n else None, row.high if n else None,
                0.0 if n > 1 and not varied else deviation, row.infinite,
            )

    def _scan(self, intervals: dict[int, list[Interval]], with_moments: bool) -> list:
        """One pass over the table for all intervals, with the moments in the first one."""
        room, finite_only = self.room, self.asked.finite_only
        single, paired = (self.single, self.paired) if with_moments else ([], [])
        probabilities = self.ranked
        # Later passes read only the columns that are still open.
        used = sorted({*intervals, *single, *paired})
        if not used:
            return []
        place = {i: k for k, i in enumerate(used)}
        values = self.values.select(*[f"x{i}" for i in used])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            salt = TaskContext.get().partitionId() % FIRST_LEVEL
            store = _Store(room)
            alone, together = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                infinite = np.isinf(x).any(axis=0)
                bounded = np.where(np.isinf(x), np.nan, x) if infinite.any() else x
                for i, parts in intervals.items():
                    column = (bounded if finite_only else x)[:, place[i]]
                    store.add_values(i, column[~np.isnan(column)], parts)
                for which, is_paired in ((single, False), (paired, True)):
                    if which:
                        at = [place[i] for i in which]
                        part = PairMoments.of(bounded[:, at], is_paired)
                        if is_paired:
                            together = part if together is None else together.joined(part)
                        else:
                            alone = part if alone is None else alone.joined(part)
                        for k, i in zip(at, which):
                            store.add_extremes(i, bounded[:, k], bool(infinite[k]))
            for which, moments in ((single, alone), (paired, together)):
                if moments is not None:
                    for k, i in enumerate(which):
                        store.moments[i] = PairMoments.from_row(moments.row(k))
            yield from store.partial(salt)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _Store(room).taken(batches).partial(0)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _Store(room).taken(batches).answers(probabilities, intervals)

        partial = values.mapInArrow(measure, _PARTIAL)
        if reckoned_bytes(values) > SMALL_BYTES:
            partial = partial.repartition("i", "k", "salt").mapInArrow(merge, _PARTIAL)
        return partial.repartition("i", "k").mapInArrow(finish, _ANSWER).collect()


class _Store:
    """What a task holds, by column and interval."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.summaries: dict[tuple[int, int], RankSummary] = {}
        self.below: dict[tuple[int, int], int] = {}
        self.extremes: dict[int, tuple[float, float, bool]] = {}
        self.moments: dict[int, PairMoments] = {}

    def _summary(self, key: tuple[int, int]) -> RankSummary:
        if key not in self.summaries:
            self.summaries[key], self.below[key] = RankSummary(self.room), 0
        return self.summaries[key]

    def add_values(self, i: int, x: np.ndarray, parts: list[Interval]) -> None:
        for k, (low, high, _) in enumerate(parts):
            summary, inside = self._summary((i, k)), x
            if low is not None:
                self.below[i, k] += int(np.count_nonzero(x <= low))
                inside = inside[inside > low]
            summary.add(inside if high is None else inside[inside <= high])

    def add_extremes(self, i: int, x: np.ndarray, infinite: bool) -> None:
        low, high = np.fmin.reduce(x, initial=np.nan), np.fmax.reduce(x, initial=np.nan)
        self._widen(i, float(low), float(high), infinite)

    def _widen(self, i: int, low: float, high: float, infinite: bool) -> None:
        a, b, c = self.extremes.get(i, (math.nan, math.nan, False))
        self.extremes[i] = float(np.fmin(a, low)), float(np.fmax(b, high)), c or infinite

    def taken(self, batches: Iterator[pa.RecordBatch]) -> _Store:
        for batch in batches:
            for row in batch.to_pylist():
                i, k = row["i"], row["k"]
                if k == MOMENTS:
                    part = PairMoments.from_row(row["moments"])
                    self.moments[i] = self.moments[i].joined(part) if i in self.moments else part
                    self._widen(i, row["low"], row["high"], row["infinite"])
                else:
                    point, weight = np.frombuffer(row["point"]), np.frombuffer(row["weight"], np.int64)
                    self._summary((i, k)).take(point, weight, row["error"])
                    self.below[i, k] += row["below"]
        return self

    def partial(self, salt: int) -> Iterator[pa.RecordBatch]:
        rows = [
            (i, MOMENTS, salt, *self.extremes[i], m.row(0), None, None, None, None)
            for i, m in self.moments.items()
        ]
        for (i, k), summary in self.summaries.items():
            point, weight, error = summary.result()
            cells = point.tobytes(), weight.astype(np.int64).tobytes(), error
            rows.append((i, k, salt, None, None, None, None, self.below[i, k], *cells))
        yield _batch(rows, _PARTIAL)

    def answers(
        self, probabilities: dict[int, list[float]], intervals: dict[int, list[Interval]]
    ) -> Iterator[pa.RecordBatch]:
        rows = [(i, MOMENTS, *self.extremes[i], m.row(0), None, None, None) for i, m in self.moments.items()]
        for (i, k), summary in self.summaries.items():
            point, weight, error = summary.result()
            n = int(weight.sum())
            ranks = intervals[i][k][2]
            if not ranks and n:  # the first pass, which also counts
                ranks = sorted({f((n - 1) * p) for p in probabilities[i] for f in (math.floor, math.ceil)})
            for rank in ranks:
                inside = rank - self.below[i, k]
                if not 0 <= inside < n:
                    raise ValueError("the table gave other values than it did before")
                value, low, high = locate(point, weight, error, inside)
                rows.append((i, k, low, high, None, None, n, rank, value))
        yield _batch(rows, _ANSWER)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), _TYPES[kind], from_pandas=False) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _disjoint(ranks: dict[int, tuple[float | None, float | None]]) -> list[Interval]:
    """Intervals that share values are one; None is no bound."""
    bounds = sorted(
        (-math.inf if low is None else low, math.inf if high is None else high, low is None, rank)
        for rank, (low, high) in ranks.items()
    )
    out: list[list] = []
    for low, high, unbounded, rank in bounds:
        if out and (low < out[-1][1] or unbounded and out[-1][2]):
            out[-1][1] = max(out[-1][1], high)
            out[-1][2] = out[-1][2] or unbounded
            out[-1][3].append(rank)
        else:
            out.append([low, high, unbounded, [rank]])
    return [
        (None if unbounded else low, None if high == math.inf else high, tuple(ranks))
        for low, high, unbounded, ranks in out
    ]


def _interpolated(found: dict[tuple[int, int], float], i: int, position: float) -> float:
    low, high = math.floor(position), math.ceil(position)
    a, b = found[i, low], found[i, high]
    return a if low == high or a == b else (high - position) * a + (position - low) * b


def reckoned_bytes(df: DataFrame) -> int:
    """The planner's own estimate; very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def select_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], room: int | None = None
) -> dict[str, list[float] | None]:
    """Exact interpolated quantiles of columns; infinite values count, missing ones do not."""
    asked = Requests(df, finite_only=False, room=room)
    asked.quantiles(columns, probabilities)
    answers = asked.answer()
    return {c: answers.quantiles(c, probabilities) for c in columns}
