"""Shards of nearly equal bytes by minimax contiguous partition.

Rows of equal text form one atomic group. Groups stand in the order of the
digest of their text, and a shard is a stretch of that order. The smallest
capacity for which a greedy walk needs no more shards than there are is found
by search over the running bytes, many capacities at a time; the walk looks up
one cut of every capacity per pass. The stretches of that capacity are the
shards.

A group larger than an even share of what is left gets a shard of its own
before the others are cut, as else it would leave the later shards empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import documents, stage_table
from tableprep.llm.ordered import running_totals

LAW = "bytes"
#: Capacities tried at a time.
TRIED = 64


def _alone(groups: DataFrame, shards: int) -> tuple[list[bytes], int, int, int]:
    """Digests of groups with a shard of their own; bytes, shards and largest group of the rest."""
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    alone: list[bytes] = []
    for group in largest:
        if shards == 1 or group.bytes * shards <= left:
            return alone, left, shards, group.bytes
        alone.append(bytes(group.digest))
        left -= group.bytes
        shards -= 1
    return alone, left, shards, 0


def _walk(
    ends: DataFrame, capacities: list[int], shards: int, start: int, total: int, widest: int
) -> list[list[int]]:
    """The cuts of the greedy walk for each capacity: the last end of a group within reach."""
    cuts = [[start] for _ in capacities]
    for _ in range(shards):
        # No further than the last end, so that there is an end less than one group below each point.
        reach = [min(c[-1] + size, start + total) for c, size in zip(cuts, capacities, strict=True)]
        points = sorted(set(reach))
        # The rest of the table is skipped.
        stretches = [[points[0] - widest, points[0]]]
        for r in points[1:]:
            if r - widest <= stretches[-1][1]:
                stretches[-1][1] = r
            else:
                stretches.append([r - widest, r])
        near = reduce(or_, (F.col("end").between(x, y) for x, y in stretches))
        below = F.size(F.filter(F.lit(points), lambda r: r < F.col("end")))
        rows = ends.where(near).groupBy(below.alias("i")).agg(F.max("end").alias("end")).collect()
        last = {row.i: row.end for row in rows}
        found, latest = {}, start
        for i, r in enumerate(points):
            latest = max(latest, last.get(i, start))
            found[r] = latest
        for c, r in zip(cuts, reach, strict=True):
            c.append(max(found[r], c[-1]))
        if all(c[-1] == c[-2] for c in cuts):
            break
    return cuts


def _cuts(ends: DataFrame, total: int, shards: int, start: int, widest: int) -> list[int]:
    """The cuts for the smallest capacity that needs no more than the given shards."""
    # An even share may do; an even share and one more group always does.
    low, high = max(widest, -(-total // shards)), -(-total // shards) + widest
    # Where groups are small the answer is close to an even share: widening steps first.
    steps = [1 << i for i in range((high - low).bit_length())]
    tried = [low, *(low + x for x in steps if low + x < high), high] if high > low else [low]
    while True:
        walks = _walk(ends, tried, shards, start, total, widest)
        best = next(i for i, w in enumerate(walks) if w[-1] == start + total)
        if best == 0 or tried[best] - tried[best - 1] == 1:
            return walks[best] + [start + total] * (shards + 1 - len(walks[best]))
        low, span = tried[best - 1] + 1, tried[best] - tried[best - 1] - 1
        tried = sorted({low + span * i // (TRIED - 1) for i in range(TRIED)})


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """A row for each row: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The size is the UTF-8 bytes of the text plus 1. A null text counts as the
    empty text, and so belongs to its group. Rows without an id come first
    within their group; repeated rows stay together, each with its own slot.
    Slots count from 0 without gaps. An empty table gives an empty result.
    """
    raw = F.col("text").cast("binary")
    rows = stage_table(
        documents(docs).select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("digest"),
        )
    )
    groups = stage_table(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    alone, total, rest, widest = _alone(groups, shards)
    rank = F.lit(len(alone))
    for i, digest in enumerate(alone):
        rank = F.when(F.col("digest") == F.lit(digest), i).otherwise(rank)
    order = [F.col("rank"), F.col("digest"), F.col("doc_id"), F.col("size")]
    placed = running_totals(
        rows.withColumn("rank", rank), order, {"end": F.col("size"), "row": F.lit(1).cast("long")}
    )
    number = F.col("rank")
    if total:
        start = groups.agg(F.sum("bytes")).first()[0] - total
        ends = placed.where(F.col("rank") == len(alone)).groupBy("digest").agg(F.max("end").alias("end"))
        ends = stage_table(ends.select("end").repartitionByRange("end").sortWithinPartitions("end"))
        for cut in _cuts(ends, total, rest, start, widest)[1:-1]:
            number = number + (F.col("end") > cut).cast("int")
    numbered = placed.withColumn("shard", number.cast("int"))
    first = numbered.groupBy("shard").agg(F.min("row").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select(  # a row for each shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
