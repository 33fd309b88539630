import random
from collections import Counter

import numpy as np
import pytest
from helpers import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.operators import frequent, typos
from tableprep.operators.summaries import FrequentItems


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 12), st.integers(1, 5))
def test_no_item_is_more_frequent_than_its_bound(items, room, pieces):
    whole = FrequentItems(room)
    for part in range(pieces):
        one = FrequentItems(room)
        for x in np.array_split(np.array(items[part::pieces], np.int64), 3):
            one.add(x)
        whole.take(one.items, one.counts, one.error)
    held = dict(zip(whole.items.tolist(), whole.counts.tolist()))
    assert len(held) <= room and whole.error * (room + 1) <= max(len(items), 0)
    for item, n in Counter(items).items():
        assert held.get(item, 0) <= n <= held.get(item, 0) + whole.error


def by_hand(values, top_n):
    counts = Counter(v for v in values if v is not None)
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top_n]
    return [(v, n, i + 1) for i, (v, n) in enumerate(ranked)]


def tables(seed, n=3000):
    random_ = random.Random(seed)
    hot = [f"w{min(int(random_.paretovariate(0.9)), 900)}" if random_.random() < 0.9 else None for _ in range(n)]
    tied = [f"t{i % 300:03}" for i in range(n)]  # all equally frequent: ties at every rank
    unique = [f"long free text number {i}" * 5 for i in range(n)]
    return {"hot": hot, "tied": tied, "unique": unique, "none": [None] * n, "k": ["", "a"] * (n // 2)}


@pytest.mark.parametrize("rooms", [(4096, 65_536), (8, 64), (30,), (5000,)])
@pytest.mark.parametrize("top_n", [1, 20, 301])
def test_top_values_equal_a_full_count(spark, monkeypatch, rooms, top_n):
    """Frequent values, ties at the last rank, unique texts; columns that the rooms settle or do not."""
    columns = tables(1)
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns)).repartition(4)
    monkeypatch.setattr(frequent.settled, "__defaults__", (rooms,))
    found = {}
    for r in typos.top_values(df, top_n=top_n).orderBy("column", "rank").collect():
        found.setdefault(r["column"], []).append((r["value"], r["n"], r["rank"]))
    assert found == {c: expected for c, v in columns.items() if (expected := by_hand(v, top_n))}


def test_unfrequent_texts_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 20_000, 1, 4).selectExpr("if(id % 4 = 0, concat('hot', id % 3), concat('unique text ', id)) v").write.parquet(path)
    df = spark.read.parquet(path)
    found, left = frequent.settled(df, ["v"], 3)
    assert left == [] and len(found) == 1
    text = plan(found[0])
    assert "LeftSemi" in text and found[0].count() < 5000
    hot = Counter(f"hot{i % 3}" for i in range(0, 20_000, 4))
    top = [(r["value"], r["n"]) for r in typos.top_values(df, top_n=3).orderBy("rank").collect()]
    assert top == sorted(hot.items(), key=lambda x: (-x[1], x[0]))
    assert frequent.settled(df, ["v"], 4, (4096,))[1] == ["v"]  # the fourth is one of thousands that occur once


def test_tables_without_text_or_rows(spark):
    assert rows(typos.top_values(spark.range(3))) == []
    assert rows(typos.top_values(spark.createDataFrame([], "a string, b string"))) == []
