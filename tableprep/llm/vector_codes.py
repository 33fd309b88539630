"""Vectors as one code per part, from codebooks learned in whole numbers.

Every part of a vector lies in a cell of a coarse grid. A cell's hash key
leads to the codebook entries that can be nearest to anything in the cell:
those whose least distance to the cell's box is not above the least of all
greatest distances. That list is worked out when a task first meets the cell
and kept; a part is then measured exactly against the entries of its cell
only. The lists are by whole numbers and so are the distances, hence ties are
true ties and the codes are those of a full comparison.

A codebook is a few thousand numbers whatever the table's size. It goes to the
tasks with the function, and a task returns one sum per entry, so a round is
one scan and a shuffle of small rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, map_rows, stage_table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Numbers up to this keep all distances far below the end of 64 bits.
PLAIN = 1 << 24
#: Plain numbers are no nearer to a number beyond this than to this one.
FAR = 1 << 100
#: Most cells a task keeps for a part; beyond it starts over.
CELLS = 1 << 16
#: Parts that are worked on at a time.
BLOCK = 1 << 12
MOST_LONG = 2**63 - 1

Vector = list[int]


def scaled(values: np.ndarray) -> list[Vector]:
    """``floor(SCALE * x)`` of finite numbers, whatever their size."""
    return [[math.floor(Fraction(x) * SCALE) for x in row] for row in values.tolist()]


def cuts(width: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts; of equal width if that divides."""
    ends = [width * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def distance(a: Vector, b: Vector) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


class PartBook:
    """The entries of one part position, and the cells met so far."""

    def __init__(self, entries: list[Vector], cells: int = CELLS) -> None:
        self.entries, self.most = entries, cells
        small = [i for i, e in enumerate(entries) if all(abs(x) <= PLAIN for x in e)]
        self.places = np.array(small, np.int64)
        self.wide = sorted(set(range(len(entries))) - set(small))
        self.plain = np.array([entries[i] for i in small], np.int64).reshape(len(small), len(entries[0]) if entries else 0)
        self.shift = self._shift()
        self.cells: dict[bytes, np.ndarray] = {}

    def _shift(self) -> int:
        """The power of two nearest to a quarter of the entries' mean deviation; any gives the same codes."""
        if self.plain.size == 0:
            return 0
        spread = float(np.mean(np.std(self.plain, axis=0))) / 4
        return max(0, round(math.log2(spread))) if spread >= 1 else 0

    def _open(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the places of the plain entries that no other entry dominates in its box."""
        least = np.zeros((len(cells), len(self.plain)), np.int64)
        most = np.zeros_like(least)
        for j in range(cells.shape[1]):
            # Cells share few coordinates, so distances are taken once for each.
            coordinates, which = np.unique(cells[:, j], return_inverse=True)
            low = (coordinates << self.shift)[:, None]
            high = low + (1 << self.shift) - 1
            below, above = low - self.plain[:, j], self.plain[:, j] - high
            least += (np.maximum(np.maximum(below, above), 0) ** 2)[which]
            most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[which]
        kept = least <= most.min(axis=1, keepdims=True)
        return [np.flatnonzero(row) for row in kept]

    def _candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rows in the order of their cells, the rows in each cell, and each cell's entries."""
        cells = x >> self.shift
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, inverse, size = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        names = [keys[i].tobytes() for i in first]
        missing = [i for i, name in enumerate(names) if name not in self.cells]
        found = dict(zip(missing, self._open(cells[first[missing]]), strict=True)) if missing else {}
        lists = [found[i] if i in found else self.cells[name] for i, name in enumerate(names)]
        if len(self.cells) + len(missing) > self.most:
            self.cells = {}
        self.cells.update((names[i], entries) for i, entries in found.items())
        return np.argsort(inverse, kind="stable"), size, lists

    def _plain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest plain entry and its distance, for rows of plain numbers."""
        order, size, lists = self._candidates(x)
        widths = np.repeat([len(entries) for entries in lists], size)
        tried = np.concatenate([np.tile(entries, n) for entries, n in zip(lists, size.tolist(), strict=True)])
        rows = np.repeat(order, widths)
        apart = x[rows] - self.plain[tried]
        apart = np.einsum("ij,ij->i", apart, apart)
        begins = np.cumsum(widths) - widths
        best = np.minimum.reduceat(apart, begins)
        # Entries of a cell ascend, so the first of the nearest is the lowest.
        hit = np.flatnonzero(apart == np.repeat(best, widths))
        winner = tried[hit[np.searchsorted(hit, begins)]]
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        index[order], error[order] = self.places[winner], best
        return index, error

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, ties to the lower index, for plain rows."""
        if x.shape[1] == 0:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not len(self.places):
            pairs = [self.nearest_wide(row) for row in x.tolist()]
            return np.array([i for i, _ in pairs], np.int64), np.array([d for _, d in pairs], object)
        found = [self._plain(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
        index, error = (np.concatenate(parts) for parts in zip(*found))
        for i in self.wide:
            # Such an entry is far from nearly all rows; the others are measured in full.
            entry = [float(max(-FAR, min(FAR, c))) for c in self.entries[i]]
            bound = np.sum((x - np.array(entry)) ** 2, axis=1) * (1 - 1e-9)
            for row in np.flatnonzero(bound <= error):
                d = distance(x[row].tolist(), self.entries[i])
                if (d, i) < (int(error[row]), int(index[row])):
                    index[row], error[row] = i, d
        return index, error

    def nearest_wide(self, row: Vector) -> tuple[int, int]:
        """The same for a row of any numbers."""
        d, i = min((distance(row, e), i) for i, e in enumerate(self.entries))
        return i, d


@dataclass
class Batch:
    """Vectors of one batch: plain ones as an array, others as lists, and where they stand."""

    plain: np.ndarray
    wide: list[Vector]
    is_wide: np.ndarray


def whole_numbers(column: pa.Array, width: int) -> Batch:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) if width else np.zeros((len(column), 0))
    is_wide = (np.abs(values) > PLAIN // SCALE - 1).any(axis=1)
    plain = np.floor(values[~is_wide] * SCALE).astype(np.int64)
    return Batch(plain, scaled(values[is_wide]), is_wide)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components."""
    infinite = F.lit(float("inf"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    value = F.col(column).cast("array<double>")
    return vectors.where(F.col(column).isNotNull() & F.forall(value, finite))


def seeds(rows: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, ties by the vectors; ids first, so that tasks send few vectors."""
    order = F.col("vec_id").asc_nulls_last()
    ids = [r[0] for r in rows.select("vec_id").orderBy(order).limit(entries).collect()]
    if ids and ids[-1] is not None:
        rows = rows.where(F.col("vec_id") <= ids[-1])
    return [r[0] for r in rows.orderBy(order, "vector").limit(entries).select("vector").collect()]


def _round(rows: DataFrame, books: list[list[Vector]], width: int) -> dict[tuple[int, int], tuple[int, Vector]]:
    """How many parts each entry is nearest to, and their sums."""
    schema = "part int, entry int, n bigint, sums array<string>"
    out = arrow_schema(schema)
    slices = cuts(width, len(books))

    def emit(held: dict[tuple[int, int], tuple[int, Vector]]) -> pa.RecordBatch:
        lists = [
            [p for p, _ in held], [e for _, e in held], [n for n, _ in held.values()],
            [[str(x) for x in sums] for _, sums in held.values()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(lists, out, strict=True)], schema=out)

    def add(held: dict, key: tuple[int, int], n: int, sums: Vector) -> None:
        m, before = held.get(key, (0, [0] * len(sums)))
        held[key] = m + n, [a + b for a, b in zip(before, sums, strict=True)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [PartBook(entries) for entries in books]
        held: dict[tuple[int, int], tuple[int, Vector]] = {}
        for batch in batches:
            numbers = whole_numbers(batch.column("vector"), width)
            for p, (book, cut) in enumerate(zip(parts, slices, strict=True)):
                if len(numbers.plain):
                    x = numbers.plain[:, cut]
                    index, _ = book.nearest(x)
                    n = np.bincount(index, minlength=len(book.entries))
                    sums = np.zeros((len(book.entries), x.shape[1]), np.int64)
                    np.add.at(sums, index, x)
                    for e in np.flatnonzero(n).tolist():
                        add(held, (p, e), int(n[e]), sums[e].tolist())
                for row in numbers.wide:
                    add(held, (p, book.nearest_wide(row[cut])[0]), 1, row[cut])
        yield emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, Vector]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                add(held, (row["part"], row["entry"]), row["n"], [int(x) for x in row["sums"]])
        yield emit(held)

    sums = rows.select("vector").mapInArrow(assign, schema).repartition("part", "entry").mapInArrow(merge, schema)
    return {(r.part, r.entry): (r.n, [int(x) for x in r.sums]) for r in sums.collect()}


def learn(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[Vector]]:
    """The codebooks, by part and entry. Rows are ``vec_id``, ``vector`` of one width."""
    found = seeds(rows, entries)
    first = scaled(np.array(found, float).reshape(len(found), width))
    books = [[row[cut] for row in first] for cut in cuts(width, parts)]
    for _ in range(rounds if first else 0):
        for (p, e), (n, sums) in _round(rows, books, width).items():
            books[p][e] = [x // n for x in sums]  # towards the smaller number
    return books


def digest(books: list[list[Vector]]) -> str:
    numbers = (str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def encode(rows: DataFrame, books: list[list[Vector]], width: int) -> DataFrame:
    """``vec_id, label, code, error`` of each row."""
    schema = "vec_id bigint, label bigint, code string, error bigint"
    out = arrow_schema(schema)
    slices = cuts(width, len(books))
    digits = max(2, len(f"{max(1, len(books[0])) - 1:x}"))
    held: list[list[PartBook]] = []

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append([PartBook(entries) for entries in books])
        numbers = whole_numbers(batch.column("vector"), width)
        index = np.zeros((batch.num_rows, len(books)), np.int64)
        errors: list[int] = [0] * batch.num_rows
        plain, wide = np.flatnonzero(~numbers.is_wide), np.flatnonzero(numbers.is_wide)
        for p, (book, cut) in enumerate(zip(held[0], slices, strict=True)):
            if len(plain):
                found, error = book.nearest(numbers.plain[:, cut])
                index[plain, p] = found
                for i, e in zip(plain.tolist(), error.tolist(), strict=True):
                    errors[i] += e
            for i, row in zip(wide.tolist(), numbers.wide, strict=True):
                index[i, p], e = book.nearest_wide(row[cut])
                errors[i] += e
        codes = ["".join(f"{x:0{digits}x}" for x in row) for row in index.tolist()]
        fitting = [e if e <= MOST_LONG else None for e in errors]
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(fitting, pa.int64())],
            schema=out,
        )

    return map_rows(rows, assign, schema)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, column: str = "embedding"
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row.

    Vectors that are null or hold null or non-finite components are dropped,
    and so are those of another width than most have (of equally many, the
    smaller width). A width that does not divide gives parts that differ by one.
    Repeated ids each give a row and count as often as they stand; where they
    are among the smallest, their vectors' order decides. Rows without an id
    come last there. With fewer rows than entries the codebooks are that
    short; with no rows the result is empty. Components may have any finite
    size. An error beyond a long is null, and so is a label's error with such
    an addend or sum. Other columns are not read.
    """
    rows = usable(vectors, column).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col(column).cast("array<double>").alias("vector"),
    )
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = widths.orderBy(F.desc("n"), "width").first()
    width = common.width if common else 0
    rows = rows.where(F.size("vector") == width)
    books = learn(rows, width, parts, entries, rounds)
    coded = stage_table(encode(rows, books, width))
    # A sum is null if an addend is, or if a long can't hold it.
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    by_label = coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
