import pytest
from helpers import plan, rows

from tableprep import CleanConfig, clean, report
from tableprep.operators import quantiles
from tableprep.operators.profile import timing_summary

NAN = float("nan")


def test_key_by_raw_or_normalized_name_and_never_fenced(spark):
    raw = [(i, 10.0 + i % 3) for i in range(20)] + [(1000, 10.0), (1000, 11.0)]
    df = spark.createDataFrame(raw, ["Customer ID", "Amount ($)"])
    for key in ("Customer ID", "customer_id"):
        result = clean(df, key, order_by=["Amount ($)"])
        assert result.keys == ["customer_id"]
        assert (1000, 10.0) in rows(result.cleaned) and result.cleaned.count() == 21
        assert [r["column"] for r in result.fences.collect()] == ["amount_"]
    assert df.columns == ["Customer ID", "Amount ($)"]


@pytest.fixture
def raw(spark):
    """Ten rows by hand: see the expected numbers in the test below."""
    return spark.createDataFrame(
        [
            (1, "  New York ", 1.0, None),
            (2, "new  york!", 2.0, None),
            (3, "Boston", 3.0, None),
            (3, "Chicago", 4.0, None),
            (4, "Boston", 5.0, "x"),
            (5, "Bostn", 100.0, None),
            (6, None, None, None),
            (7, "Dallas", NAN, None),
            (None, None, 2.0, None),
            (8, "Dallas", 2.5, "y"),
        ],
        "ID int, City string, `Amount.$` double, Notes string",
    )


def test_every_step(raw):
    result = clean(raw, "ID", order_by=["Amount.$"])
    assert result.dropped_columns == ["notes"]
    assert rows(result.nonconforming) == [
        ("Amount.$", 2), ("City", 2), ("ID", 1), ("Notes", 8),
    ]
    assert rows(result.cleaned) == [
        (1, "new york", 1.0), (2, "new york", 2.0), (3, "boston", 3.0), (4, "boston", 5.0),
        (8, "dallas", 2.5),
    ]
    steps = [(r["step"], r["rows"], r["columns"]) for r in result.step_counts.collect()]
    assert steps == [
        ("initial", 10, 4),
        ("drop sparse columns", 10, 3),
        ("drop sparse rows", 8, 3),
        ("drop rows with missing values", 7, 3),
        ("clean columns", 7, 3),
        ("drop outliers", 6, 3),
        ("drop duplicates", 5, 3),
    ]
    assert rows(result.removed) == [(5, 1)]
    assert rows(result.typos.select("value", "possible_typos", "n")) == [
        ("Bostn", ["Boston"], 1),
        ("Boston", ["Bostn"], 2),
    ]
    assert "possible_typos" not in result.cleaned.columns


def test_timings_name_every_step(raw):
    timings = clean(raw, "ID").timings
    assert [r["step"] for r in timings.collect()] == [
        "normalize headers", "count cells", "drop sparse columns", "drop sparse rows",
        "drop rows with missing values", "clean column city", "drop outliers", "drop duplicates",
    ]
    total = {r["kind"]: r["seconds"] for r in timing_summary(timings).collect()}
    assert total["total"] == pytest.approx(total["main"] + total["column"])


def test_one_scan_without_python(raw):
    text = plan(clean(raw, "ID").cleaned)
    assert "Python" not in text and "Join" not in text


def test_complete_tables_need_no_second_count(spark, jobs):
    df = spark.range(100).selectExpr("id", "cast(id as string) name")
    with jobs() as counted:
        result = clean(df, "id")
    assert counted.count <= 2
    assert result.cleaned.count() == 100
    assert "Filter" not in result.cleaned._jdf.queryExecution().optimizedPlan().toString()


def test_sequential_and_joint_modes_differ(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 200.0]
    y = [1.0, 2.0, 3.0, 4.0, 5.0, 11.0, 30.0]
    df = spark.createDataFrame(list(zip(range(7), x, y)), "k int, x double, y double")
    kept = {
        mode: clean(df, "k", CleanConfig(outlier_mode=mode)).cleaned.count()
        for mode in ("sequential", "joint")
    }
    # Both fences leave out the last row. Without it, the fence of y falls from 16.25 to 8.5.
    assert kept == {"sequential": 5, "joint": 6}
    approx = clean(df, "k", CleanConfig(quantile_method="approx")).cleaned
    # The nearest ranks of x are 2 and 100, so none is outside; those of y are 2 and 11.
    assert approx.count() == 6


def test_all_null_numbers_are_noted(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "b", None)], "k int, s string, x double"
    )
    result = clean(df, "k", CleanConfig(column_threshold=0.0, row_threshold=0.0))
    assert result.skipped_outlier_columns == ["x"]
    assert result.cleaned.count() == 2


def test_empty_table(spark):
    result = clean(spark.createDataFrame([], "k int, x double, s string"), "k")
    assert result.cleaned.columns == ["k", "x", "s"] and result.cleaned.count() == 0
    assert {r["rows"] for r in result.step_counts.collect()} == {0}


def test_nothing_but_sparse_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, "a")], "A int, B string")
    result = clean(df, "A")
    assert rows(result.cleaned) == rows(df)
    assert result.metrics["all_columns_sparse"] == ["a", "b"]
    assert rows(result.removed) == [(0, 0)]


def test_a_sparse_key_is_an_error(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "a int, b int")
    with pytest.raises(ValueError, match="too sparse"):
        clean(df, "a")
    with pytest.raises(ValueError, match="no column"):
        clean(df, "c")


def test_unknown_types_pass_through(spark):
    df = spark.sql(
        "select id k, date'2020-01-01' d, array(id) a, map('x', id) m, true b, "
        "timestamp_ntz'2020-01-01 00:00:00' t from range(3)"
    )
    assert clean(df, "k").cleaned.count() == 3


def test_hot_keys_and_values_survive_whole(spark):
    df = spark.range(0, 30_000, 1, 6).selectExpr(
        "if(id % 3 = 0, 0, id) k", "id v", "if(id % 3 = 1, 5.0, cast(id % 1000 as double)) x"
    )
    narrowed = clean(df, "k", CleanConfig(quantile_room=50), order_by=["v"]).cleaned
    gathered = clean(df, "k", order_by=["v"]).cleaned
    assert narrowed.exceptAll(gathered).count() == gathered.exceptAll(narrowed).count() == 0
    assert quantiles.quantiles(df, ["x"], (0.5,), room=50)["x"] == [
        df.selectExpr("percentile(x, 0.5)").first()[0]
    ]


def test_a_text_key_is_compared_as_normalized(spark):
    df = spark.createDataFrame(
        [(" Rome!", 1, "A b"), ("rome", 2, "C"), ("Oslo", 3, "D ")], "City string, v int, t string"
    )
    result = clean(df, "City", order_by=["v"])
    assert rows(result.cleaned) == [("oslo", 3, "d"), ("rome", 1, "a b")]
    assert result.step_counts.where("step = 'drop duplicates'").first()["rows"] == 2


def test_report_holds_every_artefact(raw):
    artefacts = report(raw, clean(raw, "ID"), grid=5)
    assert sorted(artefacts) == [
        "boxplots_before_cleaning", "column_schemas", "correlation_heatmap",
        "densities_after_cleaning", "distributions_after_cleaning",
        "missing_values_before_cleaning", "nonconforming_cells", "process_times",
    ]
    assert rows(artefacts["column_schemas"]) == [("Double", 1), ("Integer", 1), ("String", 1)]
    assert [r["column"] for r in artefacts["boxplots_before_cleaning"].collect()] == ["Amount.$"]
    assert rows(artefacts["missing_values_before_cleaning"])[0] == ("Amount.$", 20.0)
    assert artefacts["densities_after_cleaning"].count() == 5
