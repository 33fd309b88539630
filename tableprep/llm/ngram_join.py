"""Jaccard self-join of documents on word shingles by parity sketches.

A sketch has blocks of 2**64 bits. A shingle flips one bit: its hash gives
block and bit. So two sketches differ in no more bits, and in no more blocks,
than the sets differ in shingles. Of a block only its number of shingles and
the exclusive-or of their hashes are kept, which are equal where the blocks are.

Sets of sizes a and b with a Jaccard index of at least t differ in at most
(1 - t) / (1 + t) * (a + b) shingles. If blocks stand in one order for all
sketches, the first blocks of two such sketches, one more than that bound, have
one in common. Blocks of most shingles stand first: they are shared by chance
least. Sets are joined per band of sizes, in their own band and, if a partner
can lie there, the next one. A parity sketch of ``BITS`` bits then bounds the
difference of each candidate pair, and those within the bound are compared
shingle by shingle.

Equal sets are one class from the start. In a bucket of equal blocks the
members are compared with one leader, not with each other; the components that
this gives merge most groups. Buckets that still hold several components get
other leaders, first the most central member: copies of one text are often too far
from each other to link, but each links to the text they were made from, which
shares most buckets with most of them. At last all pairs across components
within the size and sketch bounds are compared, so no link between components
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import arrow_schema, documents, map_batches, map_rows, stage_table
from tableprep.llm.components import components
from tableprep.llm.words import HASHED, Hasher, mixed, pieces

#: Shingles of a block in the largest sets of a band.
FILL = 2.2
#: Bits of the parity sketch that goes with the members of a bucket, and of that which pairs are tested by.
BITS, WIDE = 1024, 4096
#: Rows packed together, at most 2**16, and bytes of packed buckets that a task should hold.
LISTED, PART_BYTES = 1 << 14, 16 << 20
#: Rows measured, and pairs compared, at a time; bytes of packed buckets sent on, and of compressed texts compared, at a time.
AT_ONCE, BYTES = 1 << 10, 2 << 20
#: Ranges of keys by which the lists of a part are unpacked.
RANGES = 8
#: Rounds of leaders before the pairs across components are tested.
ROUNDS = 6

PROFILE = "doc_id bigint, set_id bigint, n_shingles bigint, sketch array<bigint>, wide array<bigint>"
BLOCKS = "part bigint, entries binary, sets binary, several binary, bucket bigint, set_id bigint, leader bigint"


def _shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    hasher = Hasher()
    for _, some in pieces(texts, HASHED):
        yield from hasher.shingles(some, width)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    hasher = Hasher()
    for a in range(0, len(texts), AT_ONCE):  # few texts at a time stand beside the batch
        for _, some in pieces(texts.slice(a, AT_ONCE).cast(pa.binary()).to_pylist(), HASHED):
            yield from hasher.shingles(some, width)


def set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    digest = blake2b(np.ascontiguousarray(shingles).tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def sketch(shingles: np.ndarray, bits: int) -> list[int]:
    """The parity of the shingles at each of some bits, as 64-bit numbers."""
    at = (mixed(shingles, 1) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def profile(docs: DataFrame, width: int) -> DataFrame:
    """Set, size and parity sketch of each row; the set of a text without words is null."""
    out = arrow_schema(PROFILE)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, sketches, wide = [], [], [], []
        for x in _sets(batch.column("text"), width):
            sizes.append(len(x))
            ids.append(set_id(x) if len(x) else None)
            sketches.append(sketch(x, BITS) if len(x) else None)
            wide.append(sketch(x, WIDE) if len(x) else None)
        columns = [batch.column("doc_id"), ids, sizes, sketches, wide]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
        )

    return map_rows(docs, measure, PROFILE, AT_ONCE)


def bands(largest: int) -> list[int]:
    """Sizes at which a band starts, up to beyond ``largest``; a band doubles the size."""
    out = [1]
    while out[-1] <= largest:
        out.append(2 * out[-1])
    return out


def block_keys(shingles: np.ndarray, threshold: float) -> np.ndarray:
    """The keys of the first blocks of a set in each band where it can have a partner."""
    n = len(shingles)
    reach = int(n / threshold + 1e-9)
    band = n.bit_length() - 1  # as in bands()
    keys = []
    for b in range(band, reach.bit_length()):
        top = (2 << b) - 1
        partner = min(reach, top)
        differ = int((1 - threshold) / (1 + threshold) * (n + partner) + 1e-9)
        # In small sets a block has one shingle mostly, else too few blocks would have any.
        blocks = max(1, int(top / FILL) if top > 256 else 4 * top)
        at = (mixed(shingles, 2) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        number, first, count = np.unique(at[order], return_index=True, return_counts=True)
        value = np.bitwise_xor.reduceat(mixed(shingles, 3)[order], first)
        key = mixed(value ^ mixed((number * 256 + np.minimum(count, 255)).astype(np.uint64), b + 16))
        best = np.lexsort((key, -count))[: differ + 1]
        keys.append(key[best])
        missing = differ + 1 - len(best)
        if missing > 0:  # then blocks without shingles are compared too, by their place
            empty = np.setdiff1d(np.arange(blocks, dtype=np.int64), number)
            key = np.sort(mixed(mixed((empty * 256).astype(np.uint64), b + 16)))
            keys.append(key[:missing])
    return np.concatenate(keys)


def block_rows(docs: DataFrame, width: int, threshold: float, parts: int) -> DataFrame:
    """The buckets of each set, reduced and packed within a batch before they are shuffled.

    Of the sets of a batch in one bucket, the least one goes to the part of the
    bucket, packed with the others that go there: 48 bits of the bucket and 16
    for the place of the set in a list. The other sets of the bucket already
    have their leader and go anywhere as rows, so a bucket that many sets share
    sends one entry per batch to its task.
    """
    out = arrow_schema(BLOCKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, LISTED):
                yield from _packed(batch.column("text")[a : a + LISTED])

    def _packed(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for x in _sets(texts, width):
            if len(x):
                own = set_id(x)
                if own not in seen:
                    seen[own] = block_keys(x, threshold)
        if not seen:
            return
        sets = np.sort(np.array(list(seen), np.int64))
        sizes = np.array([len(seen[x]) for x in sets.tolist()])
        place = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        key = np.empty(len(place), np.uint64)
        for x, end, size in zip(sets.tolist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            key[end - size : end] = seen.pop(x)
        # Dealt to the parts first and sorted by part, as this holds all buckets of a batch.
        part = ((key >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)
        key &= np.uint64((1 << 48) - 1)
        order = np.argsort(part, kind="stable")
        key, place = key[order], place[order]
        del order
        ends = np.cumsum(np.bincount(part, minlength=parts))
        del part
        rows, more, size = [], [], 0
        for at, (start, end) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
            if start == end:
                continue
            row, settled = _packed_part(at, key[start:end], place[start:end], sets)
            rows.append(row)
            more.append(settled)
            size += sum(len(x) for x in row[1:]) + sum(x.nbytes for x in settled)
            if size >= BYTES:
                yield from _sent(rows, more)
                rows, more, size = [], [], 0
        yield from _sent(rows, more)

    def _packed_part(at: int, key: np.ndarray, place: np.ndarray, sets: np.ndarray) -> tuple[tuple, tuple]:
        """The list of a part, its keys ascending, and bucket, set, leader and target of the sets that have their leader."""
        order = np.argsort(key, kind="stable")  # by key and place, which ascends already
        key, place = key[order], place[order]
        first = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(key)])
        own, p = np.unique(place[start], return_inverse=True)  # a list names the sets of its part only
        entries = (key[start] << np.uint64(16)) | p.astype(np.uint64)
        row = (at, entries.tobytes(), sets[own].tobytes(), np.packbits(size > 1).tobytes())
        more = ~first
        leader = np.repeat(sets[place[start]], size)[more]
        anywhere = (mixed(key[more], 7) % np.uint64(parts)).astype(np.int64)
        return row, (anywhere, _bucket(np.full(len(leader), at), key[more]), sets[place[more]], leader)

    def _sent(rows: list[tuple], more: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            none = [None] * len(rows)
            yield _block_batch(*zip(*rows, strict=True), none, none, none)
            anywhere, bucket, own, leader = (np.concatenate(x) for x in zip(*more, strict=True))
            if len(own):
                none = [None] * len(own)
                yield _block_batch(anywhere, none, none, none, bucket, own, leader)

    def _block_batch(*cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, out, strict=True)], schema=out)

    return map_batches(docs.select("text"), cut, BLOCKS)


def _bucket(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for part and key of a bucket."""
    return mixed(key ^ mixed(part.astype(np.uint64), 9)).view(np.int64)


def _unpacked(entries: bytes, sets: bytes, several: bytes, which: int) -> tuple[np.ndarray, ...]:
    """Bucket, set and whether the bucket has several sets, of each entry of a list in one range of keys."""
    entry = np.frombuffer(entries, np.uint64)
    several = np.unpackbits(np.frombuffer(several, np.uint8), count=len(entry))
    # Keys ascend in a list, so a range of them is a run.
    low, high = ((1 << 64) * x // RANGES for x in (which, which + 1))
    run = slice(np.searchsorted(entry, np.uint64(low)), np.searchsorted(entry, np.uint64(high - 1), side="right"))
    own = np.frombuffer(sets, np.int64)[(entry[run] & np.uint64(0xFFFF)).astype(np.int64)]
    return entry[run] >> np.uint64(16), own, several[run].astype(bool)


MEMBERS = "bucket bigint, set_id bigint, leader bigint, more boolean"


def members(blocks: DataFrame, parts: int) -> DataFrame:
    """``bucket``, ``set_id`` and ``leader`` of the buckets with several sets.

    Buckets without ``more`` have two sets, the leader and the other one.
    """
    out = arrow_schema(MEMBERS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            settled = batch.filter(batch.column("leader").is_valid())
            if settled.num_rows:
                cells = [*settled.select(["bucket", "set_id", "leader"]).columns, pa.array(np.ones(settled.num_rows, bool))]
                yield pa.RecordBatch.from_arrays(cells, schema=out)
            for row in batch.filter(batch.column("entries").is_valid()).select(["part", "entries", "sets", "several"]).to_pylist():
                held.setdefault(row["part"], []).append((row["entries"], row["sets"], row["several"]))
        while held:
            part, each = held.popitem()
            for which in range(RANGES):  # only one range of one part is unpacked at a time
                yield from _met(part, *(np.concatenate(x) for x in zip(*(_unpacked(*x, which) for x in each), strict=True)))

    def _met(part: int, key: np.ndarray, own: np.ndarray, several: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key)
        fresh = np.r_[True, np.diff(key[order]) != 0, True]
        order = order[~(fresh[:-1] & fresh[1:]) | several[order]] if len(key) else order  # most are alone in their bucket
        key, own, several = key[order], own[order], several[order]
        order = np.lexsort((own, key))
        key, own, several = key[order], own[order], several[order]
        if not len(key):
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        once = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        sets, packed = np.add.reduceat(once, start, dtype=np.int64), np.logical_or.reduceat(several, start)
        kept = once & np.repeat((sets > 1) | packed, size)  # one set may come from several batches
        leader, more = np.repeat(own[start], size)[kept], np.repeat((sets > 2) | packed, size)[kept]
        cells = [_bucket(np.full(len(more), part), key[kept]), own[kept], leader, more]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], schema=out)

    return map_batches(blocks.repartition(parts, "part"), meet, MEMBERS)


def _within(threshold: float, a: str, b: str, sketch: str) -> Column:
    """Whether sizes and sketches allow a link."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    x, y = F.col(f"{a}.{sketch}"), F.col(f"{b}.{sketch}")
    if sketch == "sketch":  # few enough numbers for generated code
        differ = reduce(add, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(BITS // 64)))
    else:
        differ = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (
        (F.least(n, m) + 1e-6 >= threshold * F.greatest(n, m))
        & (differ <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-6)
    )


def _near(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs that sizes and sketches allow."""
    a = sets.select(F.col("set_id").alias("a"), F.struct("n_shingles", "wide").alias("x"))
    b = sets.select(F.col("set_id").alias("b"), F.struct("n_shingles", "wide").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(_within(threshold, "x", "y", "wide")).select("a", "b")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch a few at a time, so that their different texts have about ``BYTES`` bytes, or one pair's."""
    sizes = [pc.binary_length(batch.column(x)).to_pylist() for x in ("text_a", "text_b")]
    start, size, known = 0, 0, set()
    for i, pair in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
        more = {x: y[i] for x, y in zip(pair, sizes, strict=True)}
        new = sum(n for x, n in more.items() if x not in known)
        if i > start and size + new > BYTES:
            yield batch.slice(start, i - start)
            start, size, known, new = i, 0, set(), sum(more.values())
        size += new
        known.update(pair)
    if start < batch.num_rows:
        yield batch.slice(start)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of sets whose Jaccard index, in whole numbers, reaches the percentage."""
    schema = "a bigint, b bigint"

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for some in _runs(batch):
            known: dict[int, np.ndarray] = {}
            unpack = zstandard.ZstdDecompressor().decompress
            for side, text in (("a", "text_a"), ("b", "text_b")):
                ids = some.column(side).to_pylist()
                new = {x: i for i, x in enumerate(ids) if x not in known}
                column = some.column(text)
                found = _shingles([unpack(column[i].as_py()) for i in new.values()], width)
                known.update(zip(new, found, strict=True))
            for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True):
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return map_rows(pairs.join(one, "a").join(other, "b"), compare, schema, AT_ONCE)


def link(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    The component is the smallest id that links reach, its own included. A
    null or blank text has no shingles and is linked with nothing; its
    component is its own id. Rows of equal sets, repeated rows among them, are
    linked. Rows without an id link others but name no component. Other
    columns are not read. An empty table gives an empty result.
    """
    threshold = percent / 100
    docs = documents(docs)
    rows = stage_table(profile(docs, width))
    sets = stage_table(
        rows.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(*(F.first(c).alias(c) for c in ("n_shingles", "sketch", "wide")), F.min("doc_id").alias("least"))
    )
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(1, 4 * total // PART_BYTES)  # about half a bucket for each shingle
    shared = stage_table(members(block_rows(docs, width, threshold, parts), parts))
    pairs = shared.where("leader <> set_id").select(F.least("leader", "set_id").alias("a"), F.greatest("leader", "set_id").alias("b")).distinct()
    near = stage_table(_near(pairs, sets, threshold))
    # Two sets of a bucket of their own are settled when they are compared; buckets of more may need other pairs.
    shared = shared.where("more").select("bucket", "set_id")
    # One text for each set that is compared, or may be.
    texts = _texts(docs, near.select("a").union(near.select("b")).union(shared.select("set_id")).toDF("set_id").distinct(), width)
    tested = None
    roots = None
    for turn in range(ROUNDS):
        if tested is not None:
            near = stage_table(_near(pairs, sets, threshold).join(tested, ["a", "b"], "left_anti"))
        found = stage_table(verified(near, texts, width, percent))
        tested = near if tested is None else tested.union(near)
        roots = _merged(roots, found)
        placed = shared.join(roots, shared["set_id"] == roots["node"], "left").select(
            "bucket", "set_id", F.coalesce("root", "set_id").alias("root")
        )
        split = placed.groupBy("bucket").agg(F.min("root").alias("m"), F.max("root").alias("n"), F.count("*").alias("members")).where("m <> n")
        open_buckets = stage_table(placed.join(split.select("bucket", "members"), "bucket"))
        if open_buckets.isEmpty():
            break
        shared = open_buckets.select("bucket", "set_id")  # components grow, so others stay settled
        # Leaders go on while they merge many; then the pairs across components are tested.
        merged, undecided = found.count(), open_buckets.select("set_id").distinct().count()
        if turn == 0 or (turn < ROUNDS - 1 and 20 * merged > undecided):
            pairs = _other_leader(open_buckets, turn)
        else:
            pairs = _across(open_buckets, sets, threshold)
            last = stage_table(_near(pairs, sets, threshold).join(tested, ["a", "b"], "left_anti"))
            roots = _merged(roots, stage_table(verified(last, texts, width, percent)))
            break
    return _labelled(rows, sets, roots)


def _merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components of the links found, on top of those known."""
    return components(found if roots is None else roots.select("node", "root").union(found))


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One text of each wanted set, compressed, as it is shuffled several times."""
    schema = "set_id bigint, text binary"

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [set_id(x) if len(x) else None for x in _sets(batch.column("text"), width)]
        first = {x: i for i, x in reversed(list(enumerate(ids))) if x is not None}
        pack = zstandard.ZstdCompressor(level=6).compress
        texts = [pack(batch.column("text")[i].as_py().encode()) for i in first.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(first), pa.int64()), pa.array(texts, pa.binary())], ["set_id", "text"]
        )

    texts = map_rows(docs.select("doc_id", "text"), keyed, schema)
    return stage_table(texts.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]))


def _other_leader(placed: DataFrame, turn: int) -> DataFrame:
    """Members of a bucket with another leader of it, where their components differ.

    In even turns that is the member which meets most others in its buckets, by chance the more the
    later the turn; in odd ones a member of any component with equal chance.
    """
    if turn % 2 == 0:
        central = placed.groupBy("set_id").agg(F.sum("members").alias("central"))
        chance = F.pmod(F.xxhash64("set_id", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        placed = placed.join(central, "set_id")
        rank = F.struct((-F.col("central") * F.pow(chance, F.lit(turn / 2))).alias("by"), "set_id", "root")
    else:
        rank = F.struct(F.xxhash64("root", F.lit(turn)), F.xxhash64("set_id", F.lit(turn)), "set_id", "root")
    leader = placed.groupBy("bucket").agg(F.min(rank).alias("lead"))
    return (
        placed.join(leader.select("bucket", F.col("lead.set_id").alias("leader"), F.col("lead.root").alias("other")), "bucket")
        .where("root <> other")
        .select(F.least("leader", "set_id").alias("a"), F.greatest("leader", "set_id").alias("b"))
        .distinct()
    )


def _across(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a bucket across components that sizes and sketches allow."""
    full = placed.join(sets.select("set_id", "n_shingles", "sketch"), "set_id")
    x, y = full.alias("x"), full.alias("y")
    return (
        x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & _within(threshold, "x", "y", "sketch"))
        .select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))
        .distinct()
    )


def _labelled(rows: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    placed = sets.join(roots, sets["set_id"] == roots["node"], "left").select(
        "set_id", "least", F.coalesce("root", "set_id").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("set_id", "component_id")
    return rows.join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
