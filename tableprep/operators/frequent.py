"""The most frequent values of text columns, without a shuffle of the texts.

Tasks summarise the hashes of their cells by the Misra-Gries method: a fixed
number of items that may be frequent, and how often any other can occur at
most. The merged summary proposes values, and a recount of the proposals alone
gives their exact counts. If the last wanted one occurs more often than
anything that was not proposed can, the list is complete. A column that this
does not settle is proposed more of, and in the end counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.names import quoted
from tableprep.operators.summaries import FrequentItems

# Items that a summary holds, round by round.
ROOMS = (4096, 65_536)

_SUMMARY = "i int, items binary, counts binary, error bigint"


def propose(df: DataFrame, columns: Sequence[str], room: int) -> dict[int, tuple[np.ndarray, int]]:
    """For each column, by position, hashes of values that may be frequent and how often others occur at most."""
    hashed = df.select(*[F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c))).alias(f"h{i}") for i, c in enumerate(columns)])

    def rows(held: dict[int, FrequentItems]) -> pa.RecordBatch:
        arrays = [
            pa.array(list(held), pa.int32()),
            pa.array([s.items.tobytes() for s in held.values()], pa.binary()),
            pa.array([s.counts.tobytes() for s in held.values()], pa.binary()),
            pa.array([s.error for s in held.values()], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["i", "items", "counts", "error"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, FrequentItems] = {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                held.setdefault(i, FrequentItems(room)).add(column.drop_null().to_numpy())
        yield rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, FrequentItems] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts = (np.frombuffer(row[name], np.int64) for name in ("items", "counts"))
                held.setdefault(row["i"], FrequentItems(room)).take(*parts, row["error"])
        yield rows(held)

    merged = hashed.mapInArrow(summarise, _SUMMARY).repartition("i").mapInArrow(merge, _SUMMARY)
    return {r.i: (np.frombuffer(r["items"], np.int64), r.error) for r in merged.collect()}


def recount(df: DataFrame, proposed: dict[str, np.ndarray]) -> DataFrame:
    """``(column, value, n)`` of the proposed values; Spark sizes the join with their hashes."""
    names = list(proposed)
    hashes = [(c, int(h)) for c in names for h in proposed[c]]
    wanted = df.sparkSession.createDataFrame(hashes, "column string, hash bigint")
    cells = df.select(*[quoted(c) for c in names]).unpivot([], [quoted(c) for c in names], "column", "value")
    return (
        cells.where(F.col("value").isNotNull())
        .withColumn("hash", F.xxhash64("value"))
        .join(wanted, ["column", "hash"], "left_semi")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def settled(
    df: DataFrame, columns: Sequence[str], top_n: int, rooms: Sequence[int] = ROOMS
) -> tuple[list[DataFrame], list[str]]:
    """Exact counts of all values that can be among the first ``top_n``, and the columns left unsettled.

    Each column needs ``top_n`` values that occur more often than any value
    that was not proposed can, or all its values proposed.
    """
    found, left = [], list(columns)
    for room in rooms:
        if not left or room < top_n:
            continue
        proposals = propose(df, left, room)
        bounds = {c: proposals[i] for i, c in enumerate(left) if i in proposals}
        bounds = {c: (items, error) for c, (items, error) in bounds.items() if error == 0 or len(items) >= top_n}
        if not bounds:
            continue
        counts = recount(df, {c: items for c, (items, _) in bounds.items()})
        errors = df.sparkSession.createDataFrame([(c, e) for c, (_, e) in bounds.items()], "column string, error bigint")
        above = (
            counts.join(errors, "column")
            .groupBy("column", "error")
            .agg(F.count_if(F.col("n") > F.col("error")).alias("above"))
            .collect()
        )
        sure = {r.column for r in above if r.error == 0 or r.above >= top_n}
        sure |= {c for c, (items, error) in bounds.items() if error == 0 and not len(items)}
        if sure:
            found.append(counts.where(F.col("column").isin(*sure)))
        left = [c for c in left if c not in sure]
    return found, left
