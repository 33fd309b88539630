import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate, pairwise

import numpy as np
from conftest import SCHEMA

from tableprep.llm import mixing, sharding
from tableprep.llm.ordered import running_totals


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Reshares the excess round by round, as the words of the contract go."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_copies_meet_their_targets(docs, corpus, empty):
    got = mixing.copies(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in corpus:
        sizes[source] += size_of(text)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size_of(t)) for i, t, s in corpus)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for source, target in targets(sizes).items():
        assert np.isclose(next(r.target for r in got if r.source == source), target)
        assert abs(taken[source] - target) <= largest[source] + 1e-6
    assert mixing.copies(empty).collect() == []
    again = mixing.copies(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_rounding_keeps_expectations(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = np.zeros(150)
    for seed in range(4):
        for r in mixing.copies(df, seed=seed).collect():
            seen[r.doc_id] += r.copies
    each = {s: targets({s: sum(size_of(t) for _, t, x in rows if x == s) for s in "abc"})[s] / sum(size_of(t) for _, t, x in rows if x == s) for s in "abc"}
    for k, s in enumerate("abc"):
        assert abs(seen[k::3].mean() / 4 - each[s]) < 0.05


def test_mix_repeats_rows_with_all_columns(docs, empty):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, size_of(r.text)) for r in out.select("doc_id", "source", "text").collect())
    assert got == +want
    assert mixing.mix(empty).collect() == []


def greedy(sizes, capacity):
    n, room = 0, 0
    for s in sizes:
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


def test_shards_are_minimax(docs, corpus, empty):
    got = sharding.shard(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corpus
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # The long text has a shard of its own; the others are the best cut of what is left.
    import hashlib

    groups = Counter()
    for _, t, _ in corpus:
        groups[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]
    alone = max(sizes)
    rest = [s for s in sizes if s != alone]
    best = next(c for c in range(max(rest), sum(rest) + 1) if greedy(rest, c) <= 3)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert sorted(load.values())[-1] == alone
    assert sorted(load.values())[-2] == best
    assert sharding.shard(empty).collect() == []


def test_equal_texts_share_a_shard(docs, corpus):
    where = defaultdict(set)
    text = {i: t or "" for i, t, _ in corpus if i is not None}
    for r in sharding.shard(docs).collect():
        if r.doc_id is not None:
            where[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


def test_cuts_are_minimax_for_groups_of_like_size(spark):
    random_ = random.Random(5)
    kinds = {
        "equal": [100] * 300,
        "near": [random_.randint(95, 105) for _ in range(300)],
        "uniform": [random_.randint(1, 200) for _ in range(300)],
    }
    start = 70
    for kind, sizes in kinds.items():
        ends = [(start + x,) for x in accumulate(sizes)]
        total, widest = sum(sizes), max(sizes)
        cuts = sharding._cuts(spark.createDataFrame(ends, "end long"), total, 16, start, widest)
        best = next(c for c in range(widest, total + 1) if greedy(sizes, c) <= 16)
        assert len(cuts) == 17 and cuts[0] == start and cuts[-1] == start + total, kind
        assert max(b - a for a, b in pairwise(cuts)) == best, kind
        assert {(c,) for c in cuts[1:]} <= set(ends), kind


def test_texts_of_equal_size_are_sharded_evenly(spark):
    rows = [(i, f"text {i:04d}", "s") for i in range(320)]
    load = Counter(r.shard for r in sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect())
    assert load == {i: 20 for i in range(16)}


def test_few_rows_leave_shards_empty(spark):
    rows = [(1, "a", "s"), (2, "bb", "s"), (3, "a", "s")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.shard for r in got}) == 2 and all(0 <= r.shard < 16 for r in got)


def test_running_totals(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id")
    got = running_totals(df, [F.col("k"), F.col("id")], {"n": F.lit(1), "s": F.col("id")}).collect()
    total = 0
    for i, r in enumerate(sorted(got, key=lambda r: (r.k, r.id))):
        total += r.id
        assert (r.n, r.s) == (i + 1, total)
