import math

import numpy as np
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprep.operators.statistics import Requests, _disjoint, select_quantiles
from tableprep.operators.summaries import PairMoments, RankSummary, locate
from tableprep.plans.cleaning import clean
from tableprep.plans.report import report

NAN = float("nan")
values = st.lists(st.integers(-30, 30) | st.floats(allow_nan=False), min_size=1, max_size=200)


@settings(max_examples=150, deadline=None)
@given(values, st.integers(2, 20), st.integers(1, 5))
def test_ranks_lie_within_the_bounds(data, room, pieces):
    """However the values are dealt to summaries and these are merged."""
    data = [float(x) for x in data]
    whole = RankSummary(room)
    for part in range(pieces):
        one = RankSummary(room)
        for x in np.array_split(np.array(data[part::pieces]), 3):
            one.add(x)
        whole.take(*one.result())
    point, weight, error = whole.result()
    assert weight.sum() == len(data) and (error > 0 or len(set(data)) <= max(len(point), room))
    for rank, true in enumerate(sorted(data)):
        value, low, high = locate(point, weight, error, rank)
        assert value is None or value == true
        assert (low is None or low < true) and (high is None or true <= high)


def test_a_summary_keeps_to_its_room_and_error():
    draw = np.random.default_rng(1)
    summary = RankSummary(256)
    for _ in range(100):
        summary.add(draw.normal(size=10_000))
    point, weight, error = summary.result()
    assert len(point) <= 257 and weight.sum() == 1_000_000
    assert error < 0.12 * 1_000_000
    hot = RankSummary(256)
    hot.add(np.concatenate([np.full(500_000, 3.5), draw.normal(size=500_000)]))
    point, weight, error = hot.result()
    assert weight[point == 3.5] >= 500_000  # a frequent value stays itself


@pytest.mark.parametrize("room", [16, 8192])
def test_quantiles_are_exact_at_any_room(spark, room):
    draw = np.random.default_rng(2)
    n = 3000
    table = {
        "a": draw.normal(size=n), "b": np.round(draw.exponential(size=n), 1), "c": np.where(draw.random(n) < 0.4, 7.0, draw.random(n)),
        "d": np.full(n, 2.0), "e": np.where(draw.random(n) < 0.3, math.inf, -draw.random(n)), "f": np.where(np.arange(n) < 2, 1.0, NAN),
        "g": np.full(n, NAN), "h": draw.normal(size=n) * 1e300,
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*table.values())], ", ".join(f"{c} double" for c in table)).repartition(5)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = select_quantiles(df, list(table), shares, room)
    for name, x in table.items():
        x = np.sort(x[~np.isnan(x)])
        if not len(x):
            assert found[name] is None
            continue
        for share, got in zip(shares, found[name]):
            at = (len(x) - 1) * share
            a, b = x[math.floor(at)], x[math.ceil(at)]
            expected = a if a == b or at == math.floor(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
            assert got == expected, (name, share)


def test_intervals_that_share_values_are_one():
    assert _disjoint({3: (1.0, 2.0), 4: (1.5, 3.0), 9: (3.0, 4.0)}) == [(1.0, 3.0, (3, 4)), (3.0, 4.0, (9,))]
    assert _disjoint({0: (None, 2.0), 1: (None, None)}) == [(None, None, (0, 1))]
    assert _disjoint({5: (-math.inf, 1.0), 0: (None, 2.0)}) == [(None, 2.0, (5, 0))]


def moments_of(x, batches, paired):
    parts = [PairMoments.of(p, paired) for p in np.array_split(x, batches)]
    order = np.random.default_rng(batches).permutation(len(parts))
    total = PairMoments.empty(x.shape[1], x.shape[1] if paired else 1)
    for k in order:
        total = total.joined(PairMoments.stacked([PairMoments.from_row(parts[k].row(i)) for i in range(x.shape[1])]))
    return total


@pytest.mark.parametrize("batches", [1, 7])
def test_moments_do_not_cancel(batches):
    """Far origins, far-off values, holes, tiny and huge scales, columns constant where shared."""
    draw = np.random.default_rng(3)
    n = 700
    base = draw.normal(size=n)
    x = np.column_stack([
        base, 1e15 + np.round(base * 64), np.where(draw.random(n) < 0.5, NAN, base * 1e-200), base * 1e250 + draw.normal(size=n) * 1e250,
        np.where(np.arange(n) < 50, 1e9 + base, np.where(np.arange(n) < 60, NAN, base)), np.where(np.arange(n) < 55, draw.normal(size=n), NAN),
        np.full(n, 0.1), np.where(np.arange(n) < 300, 5.0, base), np.where(np.arange(n) < 200, base, NAN), np.full(n, NAN),
        np.where(np.arange(n) == 13, 1e12, base),
    ])
    found = moments_of(x, batches, True).correlations()
    for i in range(x.shape[1]):
        for j in range(x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
                assert math.isnan(found[i, j]), (i, j)
                continue
            a, b = ((c - c[0]) / np.abs(c - c[0]).max() for c in (a, b))
            assert found[i, j] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9), (i, j)
    alone = moments_of(x, batches, False)
    expected = [np.nanstd(c / s, ddof=1) * s if (~np.isnan(c)).any() else NAN for c, s in ((c, np.nanmax(np.abs(c)) if (~np.isnan(c)).any() else 1) for c in x.T)]
    assert alone.deviations()[[0, 2, 3, 7, 8]] == pytest.approx(np.array(expected)[[0, 2, 3, 7, 8]])
    assert alone.deviations()[1] == pytest.approx(np.std(np.round(base * 64), ddof=1))


def counted(spark, df):
    """The table, and a function that says how often it was read so far."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = df.count()
    return df.mapInArrow(watch, df.schema), lambda: seen.value / n


def test_a_report_reads_each_table_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(4000).selectExpr("id", "id % 40 k", "sin(id) a", "if(id % 3 = 0, null, id * id) b", "cast(id % 7 as string) s")
    df.write.parquet(path)
    raw = spark.read.parquet(path)
    result = clean(raw, "id", order_by=["id"])
    result.cleaned.write.parquet(f"{path}-cleaned")
    original, reads = counted(spark, raw)
    cleaned, reads_cleaned = counted(spark, spark.read.parquet(f"{path}-cleaned"))
    artefacts = report(original, result, cleaned)
    for artefact in artefacts.values():
        artefact.collect()
    assert len(artefacts) == 8
    assert (reads(), reads_cleaned()) == (2, 2)


def test_survivors_are_the_same_in_all_artefacts(spark):
    """Without an order any row of a key may survive, but in one reading only."""
    df = spark.range(600).selectExpr("id % 50 k", "rand() x", "id y")
    result = clean(df, "k")
    artefacts = report(df, result)
    assert {n for _, n in artefacts["distributions_after_cleaning"].groupBy("column").sum("n").collect()} == {50}


def test_report_of_a_table_without_numbers_and_of_nothing(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    found = report(texts, clean(texts, "k"))
    assert rows(found["distributions_after_cleaning"]) == rows(found["densities_after_cleaning"]) == rows(found["correlation_heatmap"]) == []
    none = spark.createDataFrame([], "k long, v double")
    found = report(none, clean(none, "k"))
    assert rows(found["missing_values_before_cleaning"]) == [("k", None), ("v", None)]
    assert rows(found["correlation_heatmap"]) == [("v", "v", None)]


def test_requests_of_two_artefacts_share_answers(spark, jobs):
    df = spark.range(100).selectExpr("id a", "id * 2.0D b", "if(id > 5, double('infinity'), 1D) c")
    asked = Requests(df)
    asked.spread(["a"])
    asked.quantiles(["a"], (0.5,))
    asked.quantiles(["b", "a"], (0.25,))
    asked.pairs(["a", "b", "c"])
    answers = asked.answer()
    assert answers.quantiles("a", (0.25, 0.5)) == [24.75, 49.5] and answers.quantiles("b", (0.25,)) == [49.5]
    assert answers.spread["a"].deviation == pytest.approx(np.std(np.arange(100), ddof=1))
    assert answers.correlations["a", "b"] == pytest.approx(1) and answers.correlations["a", "c"] is None
    assert answers.spread["c"].infinite and answers.spread["c"].n == 6


def test_summaries_of_many_tasks_are_merged_in_two_levels(spark, monkeypatch):
    from tableprep.operators import statistics

    monkeypatch.setattr(statistics, "SMALL_BYTES", 0)
    df = spark.range(0, 20_000, 1, 50).selectExpr("id * 1.5D a", "if(id % 3 = 0, null, sin(id)) b")
    asked = Requests(df, room=100)
    asked.quantiles(["a", "b"], (0.25, 0.5))
    asked.pairs(["a", "b"])
    found = asked.answer()
    assert found.quantiles("a", (0.25, 0.5)) == df.selectExpr("percentile(a, array(0.25, 0.5))").first()[0]
    assert found.quantiles("b", (0.25, 0.5)) == pytest.approx(df.selectExpr("percentile(b, array(0.25, 0.5))").first()[0])
    assert found.correlations["a", "b"] == pytest.approx(df.selectExpr("corr(a, b)").first()[0])
    assert found.spread["b"].n == 13_333
