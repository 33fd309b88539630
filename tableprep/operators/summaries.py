"""Summaries of columns that tasks make on their own and that merge into one.

``RankSummary`` stands for the values of a column in sorted order. It is exact
while the distinct values fit into its room, and otherwise knows by how much a
rank may be off. ``FrequentItems`` keeps the items that may be frequent and
knows how often any other occurs at most. ``PairMoments`` holds counts, means and centred sums of
products by pair of columns, so that nothing is ever the difference of two
large sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# -- ranks --------------------------------------------------------------------

# Values that are collected before they are sorted, in rooms.
COLLECTED = 8


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their weights."""
    values = np.concatenate([v for v, _ in parts])
    weights = np.concatenate([w for _, w in parts])
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.add.reduceat(weights, starts)


def _compacted(
    values: np.ndarray, weights: np.ndarray, room: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """At most about ``room`` values, and by how much that moves a rank at most.

    Neighbours of together about an equal share of the weight become the
    heaviest of them, so a value of more than a share stays itself.
    """
    if len(values) <= room:
        return values, weights, 0
    before = np.cumsum(weights) - weights
    group = (before * (room / weights.sum())).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(values)))
    heaviest = np.repeat(np.maximum.reduceat(weights, starts), sizes)
    hits = np.flatnonzero(weights == heaviest)
    chosen = hits[np.searchsorted(hits, starts)]
    totals = np.add.reduceat(weights, starts)
    under = before[chosen] - before[starts]
    over = totals - under - weights[chosen]
    return values[chosen], totals, int(np.maximum(under, over).max())


class RankSummary:
    """Weighted values in order; ``error`` bounds how far the rank of any value may be off.

    Parts of equal level are merged in pairs, so a value is compacted as often
    as the number of parts has binary digits.
    """

    def __init__(self, room: int) -> None:
        self.room, self.error = room, 0
        self._parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self._collected: list[np.ndarray] = []
        self._n = 0

    def add(self, values: np.ndarray) -> None:
        self._collected.append(values)
        self._n += len(values)
        if self._n >= COLLECTED * self.room:
            self._sort()

    def take(self, values: np.ndarray, weights: np.ndarray, error: int) -> None:
        """Another summary of other values."""
        self.error += error
        if len(values):
            self._push(0, values, weights)

    def _sort(self) -> None:
        if self._n:
            values, weights = np.unique(np.concatenate(self._collected), return_counts=True)
            self._push(0, values, weights)
        self._collected, self._n = [], 0

    def _push(self, level: int, values: np.ndarray, weights: np.ndarray) -> None:
        values, weights, error = _compacted(values, weights, self.room)
        self.error += error
        while self._parts and self._parts[-1][0] <= level:
            other, *part = self._parts.pop()
            values, weights, error = _compacted(*_combined([tuple(part), (values, weights)]), self.room)
            self.error += error
            level = max(level, other) + 1
        self._parts.append((level, values, weights))

    def result(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Values, weights and error."""
        self._sort()
        if not self._parts:
            return np.zeros(0), np.zeros(0, np.int64), self.error
        merged = _combined([(v, w) for _, v, w in self._parts])
        values, weights, error = _compacted(*merged, self.room)
        return values, weights, self.error + error


def locate(
    values: np.ndarray, weights: np.ndarray, error: int, rank: int
) -> tuple[float | None, float | None, float | None]:
    """The value of a rank (from 0) if that is certain, else bounds: above the first, up to the second.

    A bound is None where the summary gives none.
    """
    upto = np.cumsum(weights)
    if error == 0:
        return float(values[np.searchsorted(upto, rank, "right")]), None, None
    below = int(np.searchsorted(upto + error, rank, "right"))
    above = int(np.searchsorted(upto - error, rank + 1, "left"))
    low = float(values[below - 1]) if below else None
    return None, low, float(values[above]) if above < len(values) else None


# -- frequent items -----------------------------------------------------------


class FrequentItems:
    """Hashes of items that may be frequent, by Misra and Gries; any other occurs at most ``error`` times."""

    def __init__(self, room: int) -> None:
        self.room, self.error = room, 0
        self.items, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, items: np.ndarray) -> None:
        self.take(*np.unique(items, return_counts=True), 0)

    def take(self, items: np.ndarray, counts: np.ndarray, error: int) -> None:
        """Another summary, of other rows."""
        self.error += error
        if not len(items):
            return
        items, counts = _combined([(self.items, self.counts), (items, counts)])
        if len(items) > self.room:
            # The largest count that does not fit in is taken off all.
            off = int(np.partition(counts, -self.room - 1)[-self.room - 1])
            self.error += off
            kept = counts > off
            items, counts = items[kept], counts[kept] - off
        self.items, self.counts = items, counts


# -- moments ------------------------------------------------------------------

# The scale of a column without any value.
UNSEEN = -4000.0
# Values of a batch from which a value near its middle is taken.
MIDDLE = 999
# A pair's mean this many of its deviations off a batch's middle is summed again around the mean.
FAR = 100.0
# A deviation this small against the mean's distance from the origin is rounding.
ROUNDING = 8 * np.finfo(float).eps


def _scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """``x`` in units of two to the power of ``scale``."""
    return np.ldexp(x, -scale.astype(np.int64))


def _units(scale, origin, other_scale, other_origin):
    """Common scale and origin; factor and shift for either side."""
    unit = np.maximum(scale, other_scale)
    start = np.where(scale == UNSEEN, other_origin, origin)
    base = _scaled(start, unit)
    sides = []
    for s, o in ((scale, origin), (other_scale, other_origin)):
        sides.append((np.ldexp(1.0, (s - unit).astype(np.int64)), _scaled(o, unit) - base))
    return unit, start, sides


# By pair of columns, then by row. Tasks get classes by value, where a dataclass does not know its fields.
_BY_PAIR = ("n", "mean", "mean_of", "squares", "products", "scale", "origin")
_PARTS = (*_BY_PAIR, "row_scale", "row_origin")


@dataclass
class PairMoments:
    """Rows are columns of the table, and so are their partners; sums run over the table's rows that have both.

    ``mean`` and ``squares`` are the row's, ``mean_of`` the partner's. All are
    in units of two to a power, distances from an origin, by column.
    """

    n: np.ndarray
    mean: np.ndarray
    mean_of: np.ndarray
    squares: np.ndarray
    products: np.ndarray
    scale: np.ndarray
    origin: np.ndarray
    row_scale: np.ndarray
    row_origin: np.ndarray

    @classmethod
    def empty(cls, rows: int, partners: int) -> PairMoments:
        zeros = [np.zeros((rows, partners)) for _ in range(5)]
        ends = [np.full((rows, n), x) for n in (partners, 1) for x in (UNSEEN, 0.0)]
        return cls(*zeros, *ends)

    @classmethod
    def of(cls, x: np.ndarray, paired: bool) -> PairMoments:
        """Of one batch; NaN is missing, and infinite values are to be left out before."""
        mask = ~np.isnan(x)
        filled = np.where(mask, x, 0.0)
        seen = mask.any(axis=0)
        scale = np.where(seen, np.frexp(np.abs(filled).max(axis=0))[1] + 1.0, UNSEEN)
        origin = np.array([_middle(column[m]) for column, m in zip(x.T, mask.T)])
        unit = np.where(seen, scale, 0.0)
        y = np.where(mask, _scaled(filled, unit) - _scaled(origin, unit), 0.0)
        m = mask.astype(float)
        n, mean, squares, products = _paired(y, m) if paired else _single(y, m)
        width = x.shape[1]
        if paired:
            scales, origins = (np.tile(a, (width, 1)) for a in (scale, origin))
            return cls(n, mean, mean.T.copy(), squares, products, scales, origins, scale[:, None], origin[:, None])
        scale, origin = scale[:, None], origin[:, None]
        return cls(n, mean, mean, squares, squares, scale, origin, scale, origin)

    def joined(self, other: PairMoments) -> PairMoments:
        """Of both parts' rows, by the formula of Chan, Golub and LeVeque."""
        scale, origin, ((f1, s1), (f2, s2)) = _units(self.scale, self.origin, other.scale, other.origin)
        row_scale, row_origin, ((g1, t1), (g2, t2)) = _units(
            self.row_scale, self.row_origin, other.row_scale, other.row_origin
        )
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        mean, mean_2 = self.mean * g1 + t1, other.mean * g2 + t2
        mean_of, mean_of_2 = self.mean_of * f1 + s1, other.mean_of * f2 + s2
        apart, apart_of = mean_2 - mean, mean_of_2 - mean_of
        both = self.n * share
        return PairMoments(
            n,
            np.where(self.n == 0, mean_2, mean + apart * share),
            np.where(self.n == 0, mean_of_2, mean_of + apart_of * share),
            self.squares * g1**2 + other.squares * g2**2 + apart**2 * both,
            self.products * f1 * g1 + other.products * f2 * g2 + apart * apart_of * both,
            scale,
            origin,
            row_scale,
            row_origin,
        )

    def row(self, i: int) -> bytes:
        return np.concatenate([getattr(self, name)[i] for name in _PARTS]).tobytes()

    @classmethod
    def from_row(cls, data: bytes) -> PairMoments:
        flat = np.frombuffer(data)
        partners = (len(flat) - 2) // len(_BY_PAIR)
        ends = np.cumsum([partners] * len(_BY_PAIR) + [1])
        return cls(*(part[None, :] for part in np.split(flat, ends)))

    @classmethod
    def stacked(cls, rows: list[PairMoments]) -> PairMoments:
        return cls(*(np.concatenate([getattr(r, name) for r in rows]) for name in _PARTS))

    def varied(self) -> np.ndarray:
        """Where the row's values differ by more than rounding."""
        with np.errstate(all="ignore"):
            return self.squares > self.n * (ROUNDING * self.mean) ** 2

    def deviations(self) -> np.ndarray:
        """Sample deviation of each row by itself, for moments without pairs; NaN below two values."""
        with np.errstate(all="ignore"):
            deviation = np.sqrt(self.squares / (self.n - 1))[:, 0]
            return np.where(self.n[:, 0] > 1, np.ldexp(deviation, self.row_scale[:, 0].astype(np.int64)), np.nan)

    def correlations(self) -> np.ndarray:
        """NaN where a pair shares fewer than two rows or either column is constant there."""
        varied = self.varied()
        with np.errstate(all="ignore"):
            found = self.products / (np.sqrt(self.squares) * np.sqrt(self.squares.T))
        known = (self.n >= 2) & varied & varied.T
        return np.where(known, np.clip(found, -1, 1), np.nan)

    def diagonal(self) -> PairMoments:
        """Each column by itself."""
        at = np.arange(len(self.n))
        own = [getattr(self, name)[at, at][:, None] for name in _BY_PAIR]
        return PairMoments(*own, self.row_scale, self.row_origin)


def _middle(values: np.ndarray) -> float:
    """A value about which most of the others lie; one far-off value does not move it."""
    values = np.sort(values[:MIDDLE])
    return float(values[len(values) // 2]) if len(values) else 0.0


def _single(y: np.ndarray, m: np.ndarray):
    n = m.sum(axis=0)
    safe = np.maximum(n, 1)
    mean = y.sum(axis=0) / safe
    z = (y - mean) * m
    rest = z.sum(axis=0) / safe
    squares = (z * z).sum(axis=0) - n * rest * rest
    return n[:, None], (mean + rest)[:, None], np.maximum(squares, 0)[:, None], None


def _paired(y: np.ndarray, m: np.ndarray):
    """Counts, means of the row's column, its squares and the products, by pair."""
    n = m.T @ m
    safe = np.maximum(n, 1)
    mean = (y.T @ m) / safe
    raw = (y * y).T @ m
    squares = raw - n * mean**2
    products = y.T @ y - n * mean * mean.T
    # Where the shared rows lie far from the middle, the sums above cancel.
    off = (n > 0) & (raw > FAR**2 * np.maximum(squares, 0))
    for j in np.flatnonzero(off.any(axis=0) | off.any(axis=1)):
        both = m * m[:, j : j + 1]
        z = (y - mean[:, j]) * both
        rest = z.sum(axis=0) / safe[:, j]
        mean[:, j] += rest
        squares[:, j] = (z * z).sum(axis=0) - n[:, j] * rest**2
        # One factor is centred, so the other's distance adds rounding only.
        around = z.T @ y[:, j] - mean[j] * n[:, j] * rest
        products[:, j] = np.where(off[:, j] | off[j], around, products[:, j])
        products[j] = products[:, j]
    return n, mean, np.maximum(squares, 0), products
