import datetime as dt
from decimal import Decimal

import pytest
from helpers import rows

from tableprep.operators import completeness, profile

NAN = float("nan")


@pytest.fixture
def thresholds(spark):
    return spark.createDataFrame([(1, 1), (None, 2), (None, 3)], "a int, b int")


def test_column_ratio_must_reach_the_threshold(thresholds):
    assert completeness.drop_sparse_columns(thresholds).columns == ["b"]


def test_floor_rounding_is_laxer(thresholds):
    assert completeness.drop_sparse_columns(thresholds, rounding="floor").columns == ["a", "b"]
    with pytest.raises(ValueError):
        completeness.drop_sparse_columns(thresholds, rounding="up")


def test_row_threshold_ratio_and_floor(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, 2, None), (3, 3, 3)], "a int, b int, c int"
    )
    assert rows(completeness.drop_sparse_rows(df)) == [(2, 2, None), (3, 3, 3)]
    assert len(rows(completeness.drop_sparse_rows(df, rounding="floor"))) == 3


def test_row_filter_is_monotone_in_the_threshold(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (1, 2, None, None), (1, 2, 3, None), (1, 2, 3, 4)],
        "a int, b int, c int, d int",
    )
    kept = [completeness.drop_sparse_rows(df, t / 10).count() for t in range(11)]
    assert kept == sorted(kept, reverse=True)


def test_a_column_called_valid_count_is_kept(spark):
    df = spark.createDataFrame([(5,)], "valid_count int")
    assert rows(completeness.drop_sparse_rows(df)) == [(5,)]


def test_nan_and_null_are_missing(spark):
    df = spark.createDataFrame([(NAN, 1.0), (2.0, None), (3.0, 4.0)], "a double, b double")
    assert rows(profile.nonconforming_cells(df)) == [("a", 1), ("b", 1)]
    assert rows(completeness.drop_na_rows(df)) == [(3.0, 4.0)]
    assert completeness.drop_na_rows(df, nan_is_missing=False).count() == 2
    assert completeness.drop_sparse_rows(df, 0.6).count() == 1
    assert completeness.drop_sparse_rows(df, 0.6, nan_is_missing=False).count() == 2


def test_na_rows_only_look_at_columns_filled_above_the_threshold(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (3, None), (4, 2)], "a int, b int")
    # b is filled to exactly one half, which is not above the threshold.
    assert rows(completeness.drop_na_rows(df)) == [(1, None), (3, None), (4, 2)]


def test_every_type_can_be_profiled(spark):
    df = spark.createDataFrame(
        [
            (1, 2, Decimal(3), 4.0, True, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1),
             dt.datetime(2020, 1, 1), "NaN", ["x"]),
            (None,) * 10,
        ],
        "i int, b bigint, d decimal(20,0), x double, flag boolean, day date, at timestamp, "
        "ntz timestamp_ntz, s string, a array<string>",
    )
    assert {n for _, n in profile.nonconforming_cells(df).collect()} == {1}
    assert {p for _, p in profile.missing_percent(df).collect()} == {50.0}
    assert rows(profile.column_types(df.select("i", "b", "x", "s", "ntz", "a"))) == [
        ("Array", 1), ("Double", 1), ("Integer", 1), ("Long", 1), ("String", 1),
        ("Timestamp_ntz", 1),
    ]


def test_headers_with_dots_and_back_ticks(spark):
    df = spark.createDataFrame([(1, None), (2, 2)], ["a.b", "c`d"])
    assert rows(profile.nonconforming_cells(df)) == [("a.b", 0), ("c`d", 1)]
    assert completeness.drop_sparse_columns(df, 0.6).columns == ["a.b"]
    assert completeness.drop_na_rows(df, 0.4).count() == 1


def test_an_empty_table_keeps_all_columns(spark):
    df = spark.createDataFrame([], "a int, b double")
    assert rows(completeness.fill_ratio(df)) == [("a", 0, 0, None), ("b", 0, 0, None)]
    assert rows(profile.missing_percent(df)) == [("a", None), ("b", None)]
    assert completeness.drop_sparse_columns(df).columns == ["a", "b"]
    assert completeness.drop_na_rows(df).count() == 0
    assert rows(profile.shape(df)) == [(0, 2, 0)]


def test_counting_is_one_job_whatever_the_width(spark, jobs):
    df = spark.range(100).selectExpr(*[f"if(id % 7 = {i % 7}, null, id) c{i}" for i in range(40)])
    with jobs() as counted:
        counts = completeness.count_cells(df)
    assert counted.count <= 2  # the stages of one aggregate
    assert counts.rows == 100
    assert counts.nulls["c3"] == 14


def test_complete_columns_are_not_read(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(10).selectExpr("id a", "if(id > 3, id, null) b", "cast(id as string) t") \
        .write.parquet(path)
    df = spark.read.parquet(path)
    counts = completeness.count_cells(df)
    kept = completeness.drop_sparse_rows(df, 0.7, complete=counts.complete())
    kept = completeness.drop_na_rows(kept, counts=counts).select("a")
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint,b:bigint>" in text
    assert "IsNotNull(b)" in text
    assert kept.count() == 6


def test_missing_tokens(spark):
    df = spark.createDataFrame([("NA", 1), ("x", 2), ("", 3), (None, 4)], "s string, k int")
    result = {k: s for s, k in completeness.null_tokens(df).collect()}
    assert result == {1: None, 2: "x", 3: None, 4: None}
    assert completeness.null_tokens(df, columns=[]).where("s is null").count() == 1


def test_rows_and_columns_share_one_arithmetic(spark):
    """7 of 100 at a threshold of 0.07, by row and by column."""
    row = tuple(1 if i < 7 else None for i in range(100))
    wide = spark.createDataFrame([row], ", ".join(f"c{i} int" for i in range(100)))
    assert completeness.drop_sparse_rows(wide, 0.07).count() == 1
    tall = spark.createDataFrame([(x,) for x in row], "c int")
    assert completeness.drop_sparse_columns(tall, 0.07).columns == ["c"]
