import math

import numpy as np
import pytest
from helpers import plan, rows

from tableprep.operators import distributions
from tableprep.operators.correlation import correlation

NAN = float("nan")


def test_correlation_uses_rows_where_both_are_present(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 5.0, 5.0), (4.0, 1.0, 5.0)],
        "a double, b double, c double",
    )
    found = {(x, y): v for x, y, v in correlation(df).collect()}
    assert found["a", "b"] == found["b", "a"] == pytest.approx(-0.0524142418)
    assert found["a", "a"] == pytest.approx(1) and found["b", "b"] == pytest.approx(1)
    assert [found[k] for k in (("a", "c"), ("c", "b"), ("c", "c"))] == [None] * 3
    assert len(found) == 9


def test_correlation_of_columns_that_never_meet(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, NAN)], "a double, b double")
    found = {(x, y): v for x, y, v in correlation(df).collect()}
    assert found["a", "b"] is None and len(found) == 4
    assert correlation(df.select(), []).collect() == []


def test_correlation_is_the_same_at_any_width(spark):
    df = spark.range(200).selectExpr(
        "rand(1) a", "rand(2) + id b", "id c", "if(id % 5 = 0, null, sqrt(id)) d", "1.5D e",
        "id * 1e-9D f", "if(id < 3, 5D + id, if(id < 100, null, 5D)) g", "id * 1e200D h",
        *[f"if(id % {i + 2} = 0, null, sin(id * {i + 1})) x{i}" for i in range(8)],
    )
    wide = {(x, y): v for x, y, v in correlation(df).collect()}
    data = df.toPandas().astype(float)
    for x in data:
        for y in data:
            both = data[x].notna() & data[y].notna()
            a, b = data[x][both].to_numpy(), data[y][both].to_numpy()
            if len(set(a)) < 2 or len(set(b)) < 2:
                assert wide[x, y] is None, (x, y)
            else:
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                assert wide[x, y] == pytest.approx(np.corrcoef(a, b)[0, 1]), (x, y)
    narrow = {(x, y): v for x, y, v in correlation(df, ["a", "f", "d", "g"]).collect()}
    assert all(wide[k] == (None if v is None else pytest.approx(v)) for k, v in narrow.items())


def test_correlation_where_shared_rows_hardly_vary(spark):
    """The rows that both have lie far from the others, so sums over all rows cancel."""
    rows_ = [(1e6 + i, float(i % 7)) if i < 50 else (float(i), None) for i in range(100)]
    df = spark.createDataFrame(rows_, "a double, b double")
    found = {(x, y): v for x, y, v in correlation(df).collect()}
    x, y = np.array([(a, b) for a, b in rows_ if b is not None]).T
    assert found["a", "b"] == pytest.approx(np.corrcoef(x - 1e6, y)[0, 1])


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "x int")
    assert rows(distributions.histogram(df, bins=4)) == [
        ("x", 1, 0.0, 0.5, 1),
        ("x", 3, 1.0, 1.5, 1),
        ("x", 4, 1.5, 2.0, 1),
    ]


def test_histogram_of_constants_missing_and_infinite_values(spark):
    df = spark.createDataFrame(
        [(3.0, None, 1.0), (3.0, None, math.inf), (NAN, None, 2.0)],
        "x double, y double, z double",
    )
    assert rows(distributions.histogram(df, bins=2)) == [
        ("x", 1, 3.0, 3.0, 2),
        ("z", 1, 1.0, 1.5, 1),
        ("z", 2, 1.5, 2.0, 1),
    ]
    assert distributions.histogram(df, ["y"]).collect() == []


def test_histogram_counts_sum_to_the_present_values(spark):
    df = spark.range(1000).selectExpr("if(id % 4 = 0, null, sqrt(id)) x", "id * id y")
    sums = dict(
        distributions.histogram(df).groupBy("column").sum("n").collect()
    )
    assert sums == {"x": 750, "y": 1000}


def test_automatic_bins_follow_numpy(spark):
    values = np.random.default_rng(5).gamma(2.0, size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    edges = np.histogram_bin_edges(values, "auto")
    counts, _ = np.histogram(values, edges)
    found = {r["bin"]: r["n"] for r in distributions.histogram(df).collect()}
    assert found == {i + 1: n for i, n in enumerate(counts.tolist()) if n}


def test_columns_that_bins_do_not_fit(spark):
    heavy = [math.exp(math.exp(0.2 * i)) for i in range(32)]
    far = [-1.7e308, 1.7e308, *range(30)]
    df = spark.createDataFrame(
        [(h, float(f), float(i)) for i, (h, f) in enumerate(zip(heavy, far))],
        "heavy double, far double, x double",
    )
    found = {}
    for r in distributions.histogram(df).collect():
        found.setdefault(r["column"], []).append((r["bin"], r["n"]))
    assert found["heavy"] == [(None, 32)] and found["far"] == [(None, 32)]
    assert sum(n for _, n in found["x"]) == 32 and all(b for b, _ in found["x"])


def test_density_of_tiny_values(spark):
    df = spark.createDataFrame([(1e-200,), (2e-200,), (4e-200,)], "x double")
    tiny = sorted((r["x"], r["density"]) for r in distributions.kde(df, points=4).collect())
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    plain = sorted((r["x"], r["density"]) for r in distributions.kde(df, points=4).collect())
    assert [x * 1e200 for x, _ in tiny] == pytest.approx([x for x, _ in plain])
    assert [d * 1e-200 for _, d in tiny] == pytest.approx([d for _, d in plain])


def test_densities_share_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id a", "id * 2.5 b", "sqrt(id) c").write.parquet(path)
    assert plan(distributions.kde(spark.read.parquet(path))).split("Physical Plan")[1].count("Scan parquet") == 1


def test_density_equals_the_direct_sum(spark):
    values = np.array([1.0, 2.0, 2.5, 7.0, 7.0])
    df = spark.createDataFrame([(float(v),) for v in values] + [(NAN,)], "x double")
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(1.0, 7.0, 5)
    expected = [
        np.exp(-0.5 * ((g - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        for g in grid
    ]
    found = sorted((x, d) for _, x, d in distributions.kde(df, points=5).collect())
    assert [x for x, _ in found] == pytest.approx(grid.tolist())
    assert [d for _, d in found] == pytest.approx(expected)


def test_no_density_without_two_distinct_values(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "x double, y double")
    assert distributions.kde(df).collect() == []


def test_boxplot_numbers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 50]], "x double")
    (row,) = distributions.boxplot_stats(df).collect()
    assert tuple(row) == ("x", 9, 1.0, 1.0, 3.0, 5.0, 7.0, 8.0, 50.0, 1)
    assert rows(distributions.boxplot_outliers(df)) == [("x", 50.0)]


def test_whiskers_end_at_the_box_when_nothing_lies_between(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 10.0, 10.0, 10.0, 10.0, 20.0]], "x double")
    (row,) = distributions.boxplot_stats(df).collect()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (10.0, 10.0, 2)


@pytest.mark.parametrize("bandwidth", ["scott", 0.003])
def test_densities_of_many_values_equal_the_direct_sum(spark, bandwidth):
    """Clusters, a far tail, ties and many values, at points with and without values near."""
    draw = np.random.default_rng(6)
    values = np.concatenate([draw.normal(size=3000), np.full(500, 0.25), 50 + draw.normal(size=20) * 1e-3, [-400.0, 1e3]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    h = values.std(ddof=1) * len(values) ** -0.2 if bandwidth == "scott" else bandwidth
    found = sorted((x, d) for _, x, d in distributions.kde(df, points=300, bandwidth=bandwidth).collect())
    grid = np.array([x for x, _ in found])
    assert grid == pytest.approx(np.linspace(-400, 1e3, 300))
    height = 1 / (h * math.sqrt(2 * math.pi))
    expected = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).mean(axis=1) * height
    assert np.abs(np.array([d for _, d in found]) - expected).max() <= 1e-9 * height
