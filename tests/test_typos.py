import random
from collections import Counter

import numpy as np
import pytest
from helpers import plan, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tableprep.operators import typos


@pytest.fixture
def cities(spark):
    values = ["london"] * 5 + ["londn"] + ["paris"] * 3 + [None] * 2
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, city string")


def distance(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    table[:, 0], table[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = min(
                table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y)
            )
    return table[-1, -1]


def brute_force(values, threshold, top_n):
    counts = {v: values.count(v) for v in set(values)}
    top = sorted(counts, key=lambda v: (-counts[v], v.encode()))[:top_n]
    found = {v: [t for t in top if t != v and distance(v, t) <= threshold] for v in counts}
    return {v: (close, counts[v]) for v, close in found.items() if close}


def test_close_values_flag_each_other(cities):
    assert rows(typos.find_typos(cities)) == [("city", "londn", ["london"])] + [
        ("city", "london", ["londn"])
    ] * 5
    assert rows(typos.typo_summary(cities)) == [("city", 2, 6)]
    assert typos.find_typos(cities, limit=2).count() == 2


def test_columns_without_text_are_skipped(cities):
    assert typos.find_typos(cities, ["k"]).collect() == []
    assert typos.find_typos(cities.select("k")).collect() == []
    assert typos.typo_summary(cities, ["k"]).collect() == []


def test_top_values_leave_out_null_and_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,)], "s string")
    assert rows(typos.top_values(df, top_n=2)) == [("s", "a", 1, 2), ("s", "c", 2, 1)]


def test_only_top_values_are_suggested(spark):
    df = spark.createDataFrame([("aaaa",)] * 3 + [("aaab",)] * 2 + [("aaac",)], "s string")
    found = {v: close for _, v, close, _ in typos.typo_values(df, top_n=1).collect()}
    assert found == {"aaab": ["aaaa"], "aaac": ["aaaa"]}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text("abé", min_size=0, max_size=6), min_size=1, max_size=25),
    st.sampled_from([0, 1, 2]),
    st.sampled_from([1, 3, 100]),
    st.sampled_from([{"array_bytes": x} for x in (0, 64, 1200, 1 << 20)] + [{"most_deletions": x} for x in (0, 12, 600)]),
)
def test_every_bound_gives_the_brute_force_result(spark, values, threshold, top_n, bounds):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    found = typos.typo_values(df, None, threshold, top_n, **bounds)
    assert {v: (close, n) for _, v, close, n in found.collect()} == brute_force(
        values, threshold, top_n
    )


def test_a_hot_value_is_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(typos, "REPEAT_CHUNK", 10)
    df = spark.range(1000).selectExpr("if(id < 995, 'london', 'londn') city")
    found = typos.find_typos(df)
    assert found.groupBy("value").count().collect() in (
        [("london", 995), ("londn", 5)],
        [("londn", 5), ("london", 995)],
    )
    per_task = found.selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(per_task) > 1


def test_ranking_many_values_in_steps(spark, monkeypatch):
    monkeypatch.setattr(typos, "PARTIAL_LIMIT", 2)
    df = spark.range(200).selectExpr("cast(id % 50 as string) s")
    assert typos.top_values(df, top_n=7).count() == 7


def test_one_scan_and_no_join_by_force(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "b")], "s string, t string").write.parquet(path)
    flagged = typos.typo_values(spark.read.parquet(path))
    flagged.collect()
    text = plan(flagged)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    final = text[text.index("Final Plan") :]
    assert "ReusedExchange" in final
    executed = final.split("== Initial Plan ==")
    # Both branches and the top values share one scan and one count.
    assert sum(part.count("FileScan") for part in executed[:1]) <= 1
    assert "hint" not in flagged._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("bound", [typos.MOST_DELETIONS, 60])
def test_long_and_short_values_against_many_top_values(spark, bound):
    """Edited texts around the length at which the index changes, all of them top values."""
    random_ = random.Random(4)
    values = []
    for length in (3, 8, 9, 10, 11, 12, 33, 34, 35, 36, 37, 90):
        for _ in range(2):
            text = "".join(random_.choice("abc de") for _ in range(length))
            values.append(text)
            for edits in (1, 2, 2, 3):
                edited = text
                for _ in range(edits):
                    at = random_.randrange(len(edited) + 1)
                    edited = edited[:at] + random_.choice(["", "x", "yz"]) + edited[at + random_.choice([0, 1]) :]
                values.append(edited)
    df = spark.createDataFrame([(v,) for v in values], "s string")
    found = typos.typo_values(df, top_n=100_000, most_deletions=bound)
    counts = Counter(values)
    ranked = sorted(counts, key=lambda v: (-counts[v], v))
    near = {v: [t for t in ranked if t != v and abs(len(t) - len(v)) < 3 and distance(v, t) <= 2] for v in ranked}
    assert {v: (close, n) for _, v, close, n in found.collect()} == {v: (c, counts[v]) for v, c in near.items() if c}
    assert typos._short_length(2, 600) == 34 and typos._short_length(1, 600) == 599 and typos._short_length(2, 0) == 0
