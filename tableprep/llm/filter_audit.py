"""How five document filters interact, over every order in which they can be applied.

A text is read once, as UTF-8 bytes, by a finite-state transducer given as two
tables: the state after a byte depends on the byte's class, and the state
before it together with its class gives the actions (a word begins, a word
ends, a code point, a capital, a symbol). Both are numpy look-ups over many
texts at once. The word spans go into a hash table with open addressing. A
slot stands for a word only once the bytes of both spans were compared, so
words are told apart by their bytes, not by their hashes.

The five results of a document are a number below 32. Counts by that number
settle every order, so the orders multiply a few counts for each part and not
the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, map_rows, stage_table, text_of
from tableprep.llm.words import PIECE, mixed, pieces, powers

# The thresholds of the filters and the symbols.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_CAPITALS = 5  # percent of the code points
SYMBOLS = b"#$%&*|"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))

# Classes of bytes, and the states: outside of a word, or inside.
OTHER, BLANK, CAPITAL, SYMBOL, CONTINUED = range(5)
OUTSIDE, INSIDE = range(2)
CLASSES = 5
# Actions, one bit each.
BEGINS, ENDS, POINT, CAPITALS, MARKS = (1 << i for i in range(5))


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = BLANK
    out[0x41:0x5B] = CAPITAL
    out[list(SYMBOLS)] = SYMBOL
    out[0x80:0xC0] = CONTINUED
    return out


def _actions() -> np.ndarray:
    """What a byte does, by ``state * CLASSES + class``."""
    out = np.zeros((2, CLASSES), np.uint8)
    out[:, [OTHER, BLANK, CAPITAL, SYMBOL]] |= POINT
    out[:, CAPITAL] |= CAPITALS
    out[:, SYMBOL] |= MARKS
    out[OUTSIDE, [OTHER, CAPITAL, SYMBOL, CONTINUED]] |= BEGINS
    out[INSIDE, BLANK] |= ENDS
    return out.ravel()


CLASS = _classes()
#: The state after a byte of a class, whatever the state before it.
NEXT = np.array([INSIDE, OUTSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
ACTION = _actions()

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64), 13)


class WordTable:
    """Slots of a hash table over the word spans of one stretch of bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, text: np.ndarray) -> None:
        self.data, self.start, self.size, self.text = data, start, stop - start, text

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of spans of equal size hold the same bytes."""
        out = np.empty(len(a), bool)
        ends = np.cumsum(self.size[a])
        first = 0
        while first < len(a):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            x, y, size = a[first:last], b[first:last], self.size[a[first:last]]
            before = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(before, size)
            differ = self.data[np.repeat(self.start[x], size) + within] != self.data[np.repeat(self.start[y], size) + within]
            out[first:last] = np.add.reduceat(differ, before) == 0
            first = last
        return out

    def first_ones(self, hashes: np.ndarray) -> np.ndarray:
        """Which spans are the first inserted of their word in their text.

        Every round puts each open span to its next slot. It ends there if it
        took the slot, or if the span that has it is proven to be the same
        word of the same text.
        """
        n = len(hashes)
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        slots = np.full(mask + 1, -1, np.int64)
        keys = mixed(hashes ^ mixed(self.text.astype(np.uint64), 7))
        at = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(n)
        taken = np.zeros(n, bool)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            owner = slots[at]
            own = owner == left
            taken[left[own]] = True
            same = (
                ~own & (keys[owner] == keys[left]) & (self.text[owner] == self.text[left])
                & (self.size[owner] == self.size[left])
            )
            same[same] = self._same_bytes(owner[same], left[same])
            stay = ~(own | same)
            left, at = left[stay], (at[stay] + 1) & mask
        return taken


class Transducer:
    """Words, distinct words, code points, capitals and symbols of texts; keeps powers between calls."""

    def __init__(self) -> None:
        self.up, self.down = powers(FACTOR, 1 << 10), powers(INVERSE, 1 << 10)

    def _hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.up, self.down = powers(FACTOR, len(data)), powers(INVERSE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * self.up[: len(data)], out=sums[1:])
        return (sums[stop] - sums[start]) * self.down[start]

    def _pass(self, texts: list[bytes]) -> tuple[np.ndarray, WordTable, np.ndarray]:
        """A row of counts for each text, its word spans, and which of them come first."""
        data = np.frombuffer(b"".join(x + b" " for x in texts), np.uint8)
        kind = CLASS[data]
        state = np.empty(len(data), np.uint8)
        state[:1] = OUTSIDE
        state[1:] = NEXT[kind[:-1]]
        action = ACTION[state * np.uint8(CLASSES) + kind]
        start, stop = np.flatnonzero(action & BEGINS), np.flatnonzero(action & ENDS)
        ends = np.cumsum([len(x) + 1 for x in texts])
        begins = ends - [len(x) + 1 for x in texts]
        text = np.searchsorted(ends, start, "right")
        table = WordTable(data, start, stop, text)
        first = table.first_ones(self._hashes(data, start, stop)) if len(start) else np.zeros(0, bool)
        counted = [np.bincount(text, minlength=len(texts)), np.bincount(text[first], minlength=len(texts))]
        # The blank put behind a text is a code point that it does not have.
        for bit, extra in ((POINT, 1), (CAPITALS, 0), (MARKS, 0)):
            counted.append(np.add.reduceat((action & bit) != 0, begins, dtype=np.int64) - extra)
        return np.column_stack(counted), table, first

    def _long(self, text: bytes) -> np.ndarray:
        """A text of more than a piece, cut at blanks; its distinct words are held as bytes."""
        total, seen = np.zeros(5, np.int64), set()
        for part in blank_cuts(text, PIECE):
            counts, table, first = self._pass([part])
            total += counts[0]
            seen.update(part[a : a + n] for a, n in zip(table.start[first].tolist(), table.size[first].tolist(), strict=True))
        total[1] = len(seen)
        return total

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Words, distinct words, code points, capitals and symbols, a row for each text."""
        out = np.zeros((len(texts), 5), np.int64)
        for first, piece in pieces(texts):
            if len(piece) == 1 and len(piece[0]) > PIECE:
                out[first] = self._long(piece[0])
            else:
                out[first : first + len(piece)] = self._pass(piece)[0]
        return out


def blank_cuts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end behind a blank, or at a longer word's end."""
    data = np.frombuffer(text, np.uint8)
    start = 0
    while start < len(text):
        stop = start + size
        while stop < len(text):
            blanks = np.flatnonzero(CLASS[data[stop : stop + size]] == BLANK)
            if len(blanks):
                stop += int(blanks[0]) + 1
                break
            stop += size
        yield text[start:stop]
        start = stop


def failures(counts: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 for the filters A to D."""
    words, distinct, points, capitals, symbols = counts.T
    tests = (
        words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * words,
        100 * capitals > MOST_CAPITALS * points,
        symbols > 0,
    )
    return sum(test.astype(np.int64) << i for i, test in enumerate(tests))


def measure(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text, and ``fails`` (bits 0 to 3) of every row."""
    schema = "doc_id bigint, part string, digest string, fails int"
    out = arrow_schema(schema)
    machine: list[Transducer] = []

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not machine:
            machine.append(Transducer())
        counts = machine[0].counts(batch.column("text").to_pylist())
        columns = [*(batch.column(c) for c in ("doc_id", "part", "digest")), pa.array(failures(counts), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        text.cast("binary").alias("text"),
    )
    return map_rows(rows, count, schema)


def _has(mask: Column, bits: Column) -> Column:
    return mask.bitwiseAND(bits) != 0


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, filter order and step, with what the step's filter does there.

    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; ``part`` is the text of the column
    ``part``, a null being the empty text. A null text is the empty one: it
    fails A only, and E if a smaller id has such a text too. Filter E looks
    for smaller ids in the whole table; rows of one id are no copies of each
    other, and a row without an id neither fails E nor makes others fail it.
    Every row counts, so repeated rows count as often as they stand. A
    document is good or toxic if any label row of its id says so; rows
    without an id have no labels. No documents give no rows. Other columns are
    not read.

    The text is read by one scan, which writes a narrow row for each
    document. Only rows of texts that stand more than once, and the labels,
    are joined to those.
    """
    measured = stage_table(measure(docs, part))
    # Written, so that the join deals both sides anew and can split a text of many copies.
    repeated = stage_table(
        measured.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    )
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    counted = (
        measured.join(repeated, "digest", "left")
        .join(marks, "doc_id", "left")
        .groupBy("part", (F.col("fails") + 16 * copied).alias("mask"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("quality")).alias("good"),
            F.count_if(F.col("toxic")).alias("toxic"),
        )
    )
    return _orders(counted)


def _orders(counted: DataFrame) -> DataFrame:
    """From counts by part and mask to a row for each order and step.

    What a step does depends on its filter and on the set applied before,
    so the sums are taken for those 80 pairs and then told to the orders.
    """
    n_filters = len(FILTERS)
    pair = F.explode(
        F.array(*(
            F.struct(F.lit(i).alias("place"), F.lit(before).alias("before"))
            for i in range(n_filters) for before in range(1 << n_filters) if not before >> i & 1
        ))
    )
    mask = F.col("mask")
    fails, earlier = _has(mask, F.col("bit")), _has(mask, F.col("before"))
    # A document falls to each filter it fails in an equal share of the orders.
    share = F.lit([0, *(factorial(n_filters) // n for n in range(1, n_filters + 1))])[F.bit_count(mask)]

    def total(condition: Column, value: str | Column = "n") -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.sum(F.when(condition, value).otherwise(0))

    sums = (
        counted.select("*", pair.alias("pair"))
        .select("part", "mask", "n", "good", "toxic", "pair.place", "pair.before", F.expr("1 << pair.place").alias("bit"))
        .groupBy("part", "place", "before")
        .agg(
            total(~fails & ~earlier).alias("kept"),
            total(fails & ~earlier).alias("removed"),
            total(fails & earlier).alias("redundant"),
            total(mask == F.col("bit")).alias("unique_fails"),
            total(fails & ~earlier, "good").alias("good_lost"),
            total(fails & ~earlier, "toxic").alias("toxic_lost"),
            total(fails, F.col("n") * share).alias("shapley"),
        )
    )
    bits = {name: 1 << i for i, name in enumerate(FILTERS)}
    uses: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in ORDERS:
        for step, name in enumerate(order):
            before = sum(bits[x] for x in order[:step])
            uses.setdefault((FILTERS.index(name), before), []).append((order, step + 1))
    steps = [(place, before, order, step) for (place, before), all_of in uses.items() for order, step in all_of]
    plan = counted.sparkSession.createDataFrame(steps, "place int, before int, filter_order string, step int")
    return sums.join(plan, ["place", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
