import math
import random

import numpy as np
import pytest
from helpers import plan, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tableprep import catalog
from tableprep.operators import outliers, quantiles

NAN = float("nan")


def doubles(spark, *columns):
    schema = ", ".join(f"x{i} double" for i in range(len(columns)))
    return spark.createDataFrame(list(zip(*columns)), schema)


def test_exact_and_approximate_quartiles(spark):
    df = doubles(spark, [float(i) for i in range(1, 9)])
    assert rows(outliers.bounds(df)) == [("x0", 2.75, 6.25, -2.5, 11.5)]
    assert rows(outliers.quartiles(df, method="approx")) == [("x0", 2.0, 6.0)]
    with pytest.raises(ValueError):
        outliers.quartiles(df, method="other")


def test_nan_does_not_reach_the_quartiles(spark):
    df = doubles(spark, [1.0, 2.0, NAN])
    for limit in (None, 0):
        assert rows(outliers.quartiles(df, room=limit)) == [("x0", 1.25, 1.75)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.one_of(
            st.none(), st.integers(-5, 5).map(float), st.floats(-1e9, 1e9), st.just(NAN)
        ),
        min_size=1,
        max_size=60,
    ),
    st.sampled_from([0, 1, 3]),
)
def test_narrowing_equals_the_quantiles_of_the_sorted_values(spark, values, limit):
    df = doubles(spark, values)
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = quantiles.quantiles(df, ["x0"], probabilities, room=limit)["x0"]
    present = [v for v in values if v is not None and not math.isnan(v)]
    if present:
        assert found == pytest.approx(np.quantile(present, probabilities).tolist(), abs=1e-6)
    else:
        assert found is None


@pytest.mark.parametrize("room", [2, 20, 300])
def test_narrowing_with_little_room(spark, room):
    """Skew, ties and rare values: the summary says little, the counts correct it."""
    rng = random.Random(3)
    hot = [7.0 if rng.random() < 0.4 else rng.lognormvariate(0, 3) for _ in range(5000)]
    rare = [rng.random() if i % 500 == 0 else None for i in range(5000)]
    far = [rng.choice([-1e300, 0.0, 1e300, math.inf]) for _ in range(5000)]
    df = doubles(spark, hot, rare, far).repartition(8).cache()
    found = quantiles.quantiles(df, ["x0", "x1", "x2"], (0.25, 0.75), room=room)
    assert found["x0"] == pytest.approx(np.quantile(hot, (0.25, 0.75)).tolist())
    assert found["x1"] == pytest.approx(
        np.quantile([v for v in rare if v is not None], (0.25, 0.75)).tolist()
    )
    ranks = sorted(far)
    assert found["x2"][0] == ranks[1250] and found["x2"][1] == ranks[3749]
    df.unpersist()


def test_narrowing_takes_few_passes(spark, jobs):
    df = spark.range(0, 300_000, 1, 8).selectExpr("rand(1) x", "cast(id % 3 as double) y")
    with jobs() as counted:
        quantiles.quantiles(df, ["x", "y"], (0.25, 0.75), room=10_000)
    assert counted.count <= 8  # three passes, two stages each under adaptive execution


def test_zero_iqr_keeps_only_the_common_value(spark):
    df = doubles(spark, [1.0, 1.0, 1.0, 1.0, 0.0])
    assert rows(outliers.drop_outliers(df)) == [(1.0,)] * 4
    assert outliers.drop_outliers(df, skip_zero_iqr=True).count() == 5


def test_all_null_column_is_skipped_and_null_rows_are_dropped(spark):
    df = doubles(spark, [1.0, 2.0, None, NAN], [None] * 4)
    assert rows(outliers.drop_outliers(df)) == [(1.0, None), (2.0, None)]
    assert outliers.drop_outliers(df.limit(0)).count() == 0


def test_bounds_are_inclusive(spark):
    df = doubles(spark, [float(i) for i in range(1, 9)] + [])
    low, high = -2.5, 11.5
    fence = outliers.Fence("x0", 2.75, 6.25, low, high)
    edge = doubles(spark, [low, high, high + 0.1])
    assert rows(edge.where(fence.holds(edge.schema["x0"]))) == [(low,), (high,)]
    assert outliers.drop_outliers(df).count() == 8


def test_sequential_takes_fences_from_the_filtered_table(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 200.0]
    y = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 1.0]
    df = doubles(spark, x, y)

    def pandas_way(order):
        kept = list(zip(x, y))
        for c in order:
            q1, q3 = np.quantile([r[c] for r in kept], (0.25, 0.75))
            spread = 1.5 * (q3 - q1)
            kept = [r for r in kept if q1 - spread <= r[c] <= q3 + spread]
        return sorted(kept)

    for order in ((0, 1), (1, 0)):
        result = outliers.drop_outliers(df, [f"x{c}" for c in order], mode="sequential")
        assert sorted(map(tuple, result.collect())) == pandas_way(order)
    with pytest.raises(ValueError):
        outliers.drop_outliers(df, mode="other")


@pytest.mark.parametrize("ahead", [1, 2, 8])
def test_looking_ahead_changes_nothing(spark, monkeypatch, ahead):
    monkeypatch.setattr(outliers, "LOOK_AHEAD", ahead)
    rng = np.random.default_rng(7)
    table = rng.normal(size=(300, 7))
    table[:, [0, 2, 3]] = rng.uniform(size=(300, 3))  # these columns drop no row
    table[5, 2] = NAN  # but for a missing value
    kept = table
    for c in range(7):
        q1, q3 = np.nanquantile(kept[:, c], (0.25, 0.75))
        spread = 1.5 * (q3 - q1)
        kept = kept[(kept[:, c] >= q1 - spread) & (kept[:, c] <= q3 + spread)]
    df = spark.createDataFrame(table.tolist(), [f"x{c}" for c in range(7)])
    result = outliers.drop_outliers(df, mode="sequential")
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, kept.tolist()))
    assert 0 < len(kept) < 300


def test_fences_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("cast(id as double) x", "id").write.parquet(path)
    kept = outliers.drop_outliers(spark.read.parquet(path), ["x"])
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in text and "LessThanOrEqual(x" in text


def test_integers_and_decimals_have_fences(spark):
    df = spark.range(1, 9).selectExpr("id b", "cast(id as int) i", "cast(id as decimal(20,0)) d")
    assert {tuple(r)[1:] for r in outliers.bounds(df).collect()} == {(2.75, 6.25, -2.5, 11.5)}
    assert outliers.drop_outliers(df).count() == 8


def test_fences_of_integers_and_decimals_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "typed")
    spark.range(100).selectExpr(
        "id", "cast(id as int) i", "cast(id / 4 as decimal(12,2)) d", "cast(id % 5 as tinyint) t"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    for column, bounds in {
        "id": ("GreaterThanOrEqual(id,-49)", "LessThanOrEqual(id,148)"),
        "i": ("GreaterThanOrEqual(i,-49)", "LessThanOrEqual(i,148)"),
        "d": ("GreaterThanOrEqual(d,-12.37)", "LessThanOrEqual(d,37.12)"),
        "t": ("GreaterThanOrEqual(t,-2)", "LessThanOrEqual(t,6)"),
    }.items():
        pushed = plan(outliers.drop_outliers(df.select(column))).split("PushedFilters: ")[1]
        assert all(b in pushed for b in bounds), pushed[:300]


def test_fences_of_whole_numbers_include_their_edges(spark):
    # Quartiles 2 and 4, fences -1 and 7.
    df = spark.createDataFrame([(v,) for v in [-2, -1, 2, 2, 3, 3, 4, 4, 7, 8]], "x bigint")
    (b,) = outliers.bounds(df).collect()
    kept = [r.x for r in outliers.drop_outliers(df).collect()]
    assert sorted(kept) == [v for v in [-2, -1, 2, 2, 3, 3, 4, 4, 7, 8] if b.lower <= v <= b.upper]
    wide = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (0,), (None,)], "x bigint")
    assert outliers.drop_outliers(wide).count() == 3


def test_equal_neighbours_are_returned_as_they_are():
    from tableprep.operators.statistics import _interpolated

    assert _interpolated({("x", 3): 0.1, ("x", 4): 0.1}, "x", 3.3) == 0.1


def test_sketched_ranks_keep_their_error(spark):
    """Sorted, skewed and hot columns in many tasks, far more rows than the sketch holds."""
    n = 200_000
    df = spark.range(0, n, 1, 40).selectExpr("double(id) a", "exp(10 * rand(3)) b", "if(rand(4) < 0.4, 7D, rand(5)) c", "cast(null as double) d")
    found = quantiles.quantiles(df, df.columns, (0.0, 0.25, 0.5, 0.75, 1.0), "approx", accuracy=200)
    assert quantiles.sketch_size(200) < 1200 and found["d"] is None
    for name in "abc":
        for share, x in zip((0.0, 0.25, 0.5, 0.75, 1.0), found[name]):
            below, upto = df.selectExpr(f"count_if({name} < {x!r})", f"count_if({name} <= {x!r})").first()
            assert below / n - 0.015 <= share <= upto / n + 0.015, (name, share)


def test_sketches_of_many_columns_and_sizes(spark, monkeypatch):
    assert [quantiles.sketch_size(a) for a in (1, 10**9)] == [8, 65_535]
    monkeypatch.setattr(quantiles, "SKETCH_BYTES", 16 * 65_535 * 2)
    df = spark.range(101).selectExpr(*[f"id * {i} c{i}" for i in range(1, 6)])
    assert quantiles.quantiles(df, df.columns, (0.5,), "approx") == {f"c{i}": [50.0 * i] for i in range(1, 6)}
    with pytest.raises(ValueError):
        quantiles.quantiles(df, ["c1"], (0.5,), "nearest")


def test_rows_do_not_meet_by_column_to_be_ranked(spark, tmp_path):
    """A shuffle by column would send all rows to one task a column."""
    lineitem = spark.range(300).selectExpr("id AS l_orderkey", "cast(id % 7 as double) AS l_extendedprice")
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = catalog.quartiles_sketched(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan(found)
        assert rows(found) == [("l_extendedprice", 300, True), ("l_orderkey", 300, True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
