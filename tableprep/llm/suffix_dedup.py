"""Repeated byte strings across documents by merging Burrows-Wheeler transforms.

Documents are packed in shards. A string of ``LENGTH`` bytes is represented by
an anchor, the least hash of its ``GRAM``-byte strings; equal strings have
equal anchors. Neighbouring strings with one anchor form a segment. A segment
whose anchor occurs in one document only cannot repeat and is left out; the
others meet in buckets by anchor, so equal strings meet in one bucket.

In a bucket the distinct segments that have an anchor and the bytes on one side
of it in common with another one are cut into blocks of bounded size, each
block is sorted once to its Burrows-Wheeler transform, and the transforms are
merged: from an interleave that is sorted by the first d bytes, one stable pass
over the transformed bytes gives the interleave by d + 1 bytes, and marks where
neighbours differ. No suffix is sorted again. After ``LENGTH`` passes the
intervals between marks are the equal strings (the places where the common
prefix is at least that long), and each interval knows its smallest id.

The shards get back one bit for each string that also starts in a smaller id,
and cut their documents. Only hashes, segments with repeated anchors and these
bits are shuffled besides the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, documents, map_rows, stage_table
from tableprep.llm.words import mixed

LENGTH, GRAM = 50, 16
#: Bytes beside an anchor that are compared first: at most half of those that a string has besides, and a multiple of eight.
SIDE = (LENGTH - GRAM) // 2 // 8 * 8
#: Bytes of a shard, of a bucket's text before repetition is known, and of a block that is sorted.
SHARD, BUCKET, BLOCK = 1 << 20, 4 << 20, 1 << 18
#: Rows without an id stand behind all others.
LAST = np.iinfo(np.int64).max

SHARDS = "shard bigint, ids array<bigint>, sizes array<bigint>, data binary"
ANCHORS = "shard bigint, bucket int, hashes binary, several binary"
REPEATS = "shard bigint, bucket int, bits binary"
SEGMENTS = "anchor bigint, shard bigint, segment int, least bigint, text binary"
COVERED = "shard bigint, segment int, bits bigint"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def packed(docs: DataFrame) -> DataFrame:
    """Whole documents joined to shards, compressed and written, so that later passes see the same shards."""
    out = arrow_schema(SHARDS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        n, size, ids, texts = 0, 0, [], []
        pack = zstandard.ZstdCompressor().compress

        def row() -> pa.RecordBatch:
            cells = [[first + n], [ids], [[len(x) for x in texts]], [pack(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, out, strict=True)], schema=out)

        for batch in batches:
            for own, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py().encode()
                if texts and size + len(data) > SHARD:
                    yield row()
                    n, size, ids, texts = n + 1, 0, [], []
                ids.append(own)
                texts.append(data)
                size += len(data)
        if texts:
            yield row()

    return stage_table(docs.select("doc_id", "text").mapInArrow(gather, SHARDS))


def _hashes(data: bytes, width: int) -> np.ndarray:
    """A hash of the string of some bytes, a multiple of eight, that starts at each place."""
    n = len(data)
    raw = np.frombuffer(data + bytes(16), np.uint8)
    eight = np.empty(n + 8, np.uint64)
    for o in range(8):
        part = raw[o : o + (n + 8 - o + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view("<u8")
        eight[o::8] = part[: len(eight[o::8])]
    grams = n - width + 1
    hashes = eight[:grams]
    for k in range(8, width, 8):
        hashes = mixed(hashes, 11) ^ eight[k : k + grams]
    return mixed(hashes)


class Runs:
    """The segments of a shard: first byte, number of strings, anchor and document of each."""

    def __init__(self, data: bytes, sizes: list[int], ids: list[int | None]) -> None:
        self.data = data
        self.ids = np.array([LAST if x is None else x for x in ids], np.int64)
        self.stops = np.cumsum(np.array(sizes, np.int64))
        n = len(data)
        self.start = self.count = self.document = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n >= LENGTH:
            self._find(n)
        self.unique, self.which = np.unique(self.anchor, return_inverse=True)

    def _find(self, n: int) -> None:
        grams = n - GRAM + 1
        hashes = _hashes(self.data, GRAM)
        # The upper half decides, and of equal ones the first place.
        low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        width, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: reach - width], low[width - reach :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        strings = np.arange(len(place))
        document = np.repeat(np.arange(len(self.stops)), np.diff(self.stops, prepend=0))[: len(place)]
        valid = strings + LENGTH <= self.stops[np.minimum(document, len(self.stops) - 1)]
        fresh = np.r_[True, (place[1:] != place[:-1]) | (document[1:] != document[:-1]) | ~valid[:-1]] & valid
        self.start = np.flatnonzero(fresh)
        ends = np.flatnonzero(valid & np.r_[fresh[1:] | ~valid[1:], True])
        self.count = ends - self.start + 1
        self.document = document[self.start]
        self.anchor = hashes[place[self.start]]

    def segments(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Runs with a repeated anchor, their segments, the segments once each, and the least id of each."""
        runs = np.flatnonzero(repeated[self.which])
        known: dict[bytes, int] = {}
        data = self.data
        start, stop = self.start[runs].tolist(), (self.start[runs] + self.count[runs] + LENGTH - 1).tolist()
        segment = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(start, stop, strict=True)], np.int64)
        least = np.full(len(known), LAST, np.int64)
        np.minimum.at(least, segment, self.ids[self.document[runs]])
        return runs, segment, list(known), least


def anchor_rows(shards: DataFrame, buckets: int) -> DataFrame:
    """The distinct anchors of each shard by bucket, and whether several of its documents have them."""
    out = arrow_schema(ANCHORS)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], []]
        for shard, runs in _runs(batch):
            low, high = np.full(len(runs.unique), LAST), np.full(len(runs.unique), -1)
            np.minimum.at(low, runs.which, runs.document)
            np.maximum.at(high, runs.which, runs.document)
            to = runs.unique % np.uint64(buckets)
            for b in np.unique(to):
                at = np.flatnonzero(to == b)
                rows[0].append(shard)
                rows[1].append(int(b))
                rows[2].append((runs.unique[at] >> np.uint64(32)).astype(np.uint32).tobytes())
                rows[3].append(np.packbits(high[at] > low[at]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out, strict=True)], schema=out)

    return map_rows(shards, measure, ANCHORS)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Runs]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for i in range(batch.num_rows):
        shard, data, sizes, ids = (batch.column(c)[i].as_py() for c in ("shard", "data", "sizes", "ids"))
        yield shard, Runs(unpack(data), sizes, ids)


def _among(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are among known ones, given in order."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


def repeats(anchors: DataFrame) -> DataFrame:
    """For each shard and bucket a bit for each anchor: whether another document may have it."""

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, np.uint32) for x in group["hashes"]]
        several = [x[np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)) > 0] for x, y in zip(each, group["several"], strict=True)]
        # In place, as this holds all of a bucket; the shards then look theirs up one by one.
        found = np.concatenate(each)
        found.sort()
        found = np.unique(np.concatenate([found[1:][found[1:] == found[:-1]], *several]))
        bits = [_among(x, found) for x in each]
        return pd.DataFrame({"shard": group["shard"].to_numpy(), "bucket": group["bucket"].to_numpy(), "bits": [np.packbits(x).tobytes() for x in bits]})

    return anchors.groupBy("bucket").applyInPandas(decide, REPEATS)


def _repeated(runs: Runs, bits: list[dict], buckets: int) -> np.ndarray:
    out = np.zeros(len(runs.unique), bool)
    to = runs.unique % np.uint64(buckets)
    for x in bits or []:
        at = np.flatnonzero(to == x["bucket"])
        out[at] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(at))
    return out


def segment_rows(shards: DataFrame, buckets: int) -> DataFrame:
    """The distinct segments of each shard with a repeated anchor."""
    out = arrow_schema(SEGMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (shard, runs) in enumerate(_runs(batch)):
                bits = batch.column("repeats")[i].as_py()
                at, segment, texts, least = runs.segments(_repeated(runs, bits, buckets))
                anchor = np.zeros(len(texts), np.uint64)
                anchor[segment] = runs.anchor[at]
                cells = [anchor.view(np.int64), np.full(len(texts), shard), np.arange(len(texts)), least, texts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, out, strict=True)], schema=out)

    return shards.mapInArrow(cut, SEGMENTS)


# -- Burrows-Wheeler transforms ------------------------------------------------

#: Stands behind each segment; no byte of UTF-8.
END = 255


def transform(symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rotations in the order of their first bytes (more than ``LENGTH``).

    Further their transformed symbols, the row one byte before, and their first eight bytes.
    """
    n = len(symbols)
    key, wide = np.zeros(n, np.uint64), symbols.astype(np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.roll(wide, -i)
    eight, depth = key, 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]], dtype=np.uint64)
        if depth > LENGTH:
            break
        key = (rank << np.uint64(32)) | np.roll(rank, -depth)
        depth *= 2
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    return order, symbols[order - 1], row[order - 1], eight[order]


def _holds_end(eight: np.ndarray) -> np.ndarray:
    """Whether one of eight bytes is ``END``, all of whose bits are set."""
    rest = ~eight
    return (rest - np.uint64(0x0101010101010101)) & ~rest & np.uint64(0x8080808080808080) != 0


def merge(blocks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all blocks (numbered through) that share their first ``LENGTH`` bytes, and where an interval starts.

    The first interleave is that by eight bytes, which merges lists that are
    sorted already; each pass then refines it by one. A row whose bytes so far
    are its own, or reach beyond its segment, is left out from then on: so are
    they with one more byte in front.
    """
    base = np.cumsum([0, *(len(b[0]) for b in blocks)])
    symbols = np.concatenate([b[1] for b in blocks])
    before = np.concatenate([b[2] + base[i] for i, b in enumerate(blocks)]).astype(np.int32)
    eight = np.concatenate([b[3] for b in blocks])
    rows = np.argsort(eight, kind="stable")
    rows = rows[~_holds_end(eight[rows])].astype(np.int32)
    rows, starts = _shared(rows, np.diff(eight[rows], prepend=np.uint64(0)) != 0)
    for _ in range(LENGTH - 8):
        interval = np.cumsum(starts, dtype=np.int32)
        symbol = symbols[rows]
        inside = symbol != END
        rows, symbol, interval = before[rows[inside]], symbol[inside], interval[inside]
        order = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[order], interval[order]
        starts = np.ones(len(order), bool)
        starts[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        rows, starts = _shared(rows[order], starts)
    return rows, starts


def _shared(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows that are alone in their interval."""
    if not len(rows):
        return rows, starts
    starts[0] = True
    kept = ~(starts & np.r_[starts[1:], True])
    return rows[kept], starts[kept]


def least_ids(texts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each text in turn the smallest id that has it; where the strings of a text start."""
    sizes = np.array([len(x) for x in texts], np.int64)
    first = np.r_[0, np.cumsum(sizes - LENGTH + 1)]
    blocks, owner, offset = [], [], []
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:] + 1), BLOCK, side="right")) + a)
        symbols = np.full(int((sizes[a:b] + 1).sum()), END, np.uint8)
        body = np.ones(len(symbols), bool)
        stops = np.cumsum(sizes[a:b] + 1)
        body[stops - 1] = False
        symbols[body] = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        blocks.append(transform(symbols))
        order = blocks[-1][0]
        text = np.searchsorted(stops, order, side="right")
        owner.append(text + a)
        offset.append(order - np.r_[0, stops[:-1]][text])
        a = b
    out = np.repeat(least, sizes - LENGTH + 1)
    rows, starts = merge(blocks)
    if len(rows):
        owner, offset = np.concatenate(owner)[rows], np.concatenate(offset)[rows]
        at = np.flatnonzero(starts)
        smallest = np.minimum.reduceat(least[owner], at)
        out[first[owner] + offset] = np.repeat(smallest, np.diff(np.r_[at, len(rows)]))
    return out, first


def may_share(texts: list[bytes]) -> np.ndarray:
    """Which of some distinct segments may have a string in common with another one.

    Equal strings have their anchor at one place, and more than ``SIDE`` bytes
    of them stand before or behind it. So of two segments that share a string
    the anchors and the ``SIDE`` bytes on one side of them are equal.
    """
    data = b"".join(texts)
    sizes = np.array([len(x) for x in texts], np.int64)
    start = np.cumsum(sizes) - sizes
    # The first string has the anchor of all; the upper half decides, and of equal ones the first place.
    hashes = _hashes(data, GRAM)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    place = upper[start[:, None] + np.arange(LENGTH - GRAM + 1)].argmin(axis=1)
    anchor = upper[start + place]
    side = hashes if SIDE == GRAM else _hashes(data, SIDE)
    out = np.zeros(len(texts), bool)
    for at in (place - SIDE, place + GRAM):
        there = np.flatnonzero((at >= 0) & (at + SIDE <= sizes))
        key = mixed(side[start[there] + at[there]] ^ mixed(anchor[there].astype(np.uint64), 13))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[there] |= count[which] > 1
    return out


def covered(segments: DataFrame, buckets: int) -> DataFrame:
    """For each segment of a shard a bit for each string that a smaller id has than any of the shard's own."""

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(x, len(known)) for x in group["text"]], np.int64)
        own = group["least"].to_numpy()
        least = np.full(len(known), LAST, np.int64)
        np.minimum.at(least, which, own)
        texts = list(known)
        # Others have their strings for themselves, so these are not sorted.
        meet = np.flatnonzero(may_share(texts))
        first = np.cumsum([0, *(len(x) - LENGTH + 1 for x in texts)])
        found = np.repeat(least, np.diff(first))
        if len(meet):
            among, part = least_ids([texts[i] for i in meet.tolist()], least[meet])
            found[np.repeat(first[meet] - part[:-1], np.diff(part)) + np.arange(part[-1])] = among
        count = (first[1:] - first[:-1])[which]
        row = np.repeat(np.arange(len(which)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        set_ = (found[first[which[row]] + inner] < own[row]).astype(np.int64) << inner
        bits = np.add.reduceat(set_, np.cumsum(count) - count)  # each bit once
        keep = bits != 0
        return pd.DataFrame({"shard": group["shard"].to_numpy()[keep], "segment": group["segment"].to_numpy()[keep], "bits": bits[keep]})

    # The anchor only names the bucket, and is not shuffled.
    dealt = segments.select(F.pmod("anchor", F.lit(buckets)).cast("int").alias("bucket"), "shard", "segment", "least", "text")
    return dealt.groupBy("bucket").applyInPandas(decide, COVERED)


def _cut(batch: pa.RecordBatch, buckets: int, out: pa.Schema) -> pa.RecordBatch:
    """Cuts the documents of shards that have their bits."""
    rows: list[list] = [[], [], [], [], []]
    for i, (_, runs) in enumerate(_runs(batch)):
        at, segment, texts, least = runs.segments(_repeated(runs, batch.column("repeats")[i].as_py(), buckets))
        bits = np.zeros(len(texts), np.int64)
        for x in batch.column("covered")[i].as_py() or []:
            bits[x["segment"]] = x["bits"]
        # A string of a shard's own segment is removed behind the least id that has the segment.
        count = runs.count[at]
        later = runs.ids[runs.document[at]] > least[segment] if len(at) else np.zeros(0, bool)
        run = np.repeat(np.arange(len(at)), count)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        gone = later[run] | ((bits[segment[run]] >> inner) & 1).astype(bool)
        place = runs.start[at][run[gone]] + inner[gone]
        n = len(runs.data)
        change = np.bincount(place, minlength=n + LENGTH + 1) - np.bincount(place + LENGTH, minlength=n + LENGTH + 1)
        removed = np.cumsum(change)[:n] > 0
        raw = np.frombuffer(runs.data, np.uint8)
        start = 0
        for own, stop in zip(batch.column("ids")[i].as_py(), runs.stops.tolist(), strict=True):
            mask = removed[start:stop]
            rows[0].append(own)
            rows[1].append(stop - start)
            rows[2].append(int(mask.sum()))
            rows[3].append(int(np.count_nonzero(mask & ~np.r_[False, mask[:-1]])))
            rows[4].append(raw[start:stop][~mask].tobytes())
            start = stop
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out, strict=True)], schema=out)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) of every row.

    A byte is removed if a string of ``LENGTH`` bytes covers it that also
    starts in a row with a smaller id. A null text is the empty one. Rows
    without an id stand behind all others, so they lose what others have and
    take nothing from them; rows of one id take nothing from each other. With
    ``digest`` the kept bytes are given by their SHA-256 as ``kept_sha256``.
    Other columns are not read. An empty table gives an empty result.
    """
    docs = documents(docs)
    shards = packed(docs)
    total = shards.select(F.explode("sizes").alias("size")).agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (16 * BUCKET)))
    found = repeats(anchor_rows(shards, buckets)).groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("repeats"))
    with_repeats = shards.join(found, "shard", "left")
    cover = covered(segment_rows(with_repeats, buckets), max(1, -(-total // BUCKET)))
    cover = cover.groupBy("shard").agg(F.collect_list(F.struct("segment", "bits")).alias("covered"))  # bits of one shard
    full = with_repeats.join(cover, "shard", "left")
    out = arrow_schema(RESULT)
    if not digest:
        return map_rows(full, lambda batch: _cut(batch, buckets, out), RESULT)
    schema = RESULT.replace("kept binary", "kept_sha256 string")
    hashed_out = arrow_schema(schema)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _cut(batch, buckets, out)
        names = pa.array([sha256(x.as_py()).hexdigest() for x in rows.column("kept")], pa.string())
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], names], schema=hashed_out)

    return map_rows(full, hashed, schema)
