import pytest
from hypothesis import given
from hypothesis import strategies as st
from helpers import rows

from tableprep.operators import schema

MIXED = (
    "i int, b bigint, d decimal(20,0), x double, f float, flag boolean, day date, "
    "at timestamp, ntz timestamp_ntz, s string, a array<string>"
)


def test_headers_are_normalized_by_position(spark):
    raw = ["First Name", "Amount ($)", "a_b", "A b", "###"]
    df = schema.normalize_headers(spark.createDataFrame([(1, 2, 3, 4, 5)], raw))
    assert df.columns == ["first_name", "amount_", "a_b", "a_b_2", "col_5"]
    assert rows(df) == [(1, 2, 3, 4, 5)]


def test_a_suffix_never_meets_a_real_header():
    assert schema.normalized_names(["a", "a_2", "A", "A!"]) == ["a", "a_2", "a_3", "a_4"]


@given(st.lists(st.text(max_size=6), max_size=12))
def test_normalizing_headers_twice_changes_nothing(names):
    once = schema.normalized_names(names)
    assert len(set(once)) == len(once)
    assert schema.normalized_names(once) == once


def test_columns_resolve_by_raw_and_by_normalized_name():
    raw = ["Customer ID", "a_b", "A b"]
    assert schema.resolve_columns(raw, ["Customer ID", "customer_id"]) == ["customer_id"] * 2
    assert schema.resolve_columns(raw, ["A b", "a_b_2"]) == ["a_b_2", "a_b_2"]
    with pytest.raises(ValueError):
        schema.resolve_columns(raw, ["missing"])


def test_every_number_type_is_numeric_and_boolean_is_not(spark):
    df = spark.createDataFrame([], MIXED)
    assert schema.numeric_columns(df) == ["i", "b", "d", "x", "f"]
    assert schema.numeric_columns(df, exclude=["i"]) == ["b", "d", "x", "f"]
    assert schema.key_candidates(df) == ["i", "b", "d", "x", "f"]
    assert schema.string_columns(df) == ["s"]


def test_coercion_turns_bad_text_into_null(spark):
    df = spark.createDataFrame(
        [(1, "1.5"), (2, " 7 "), (3, "7d"), (4, "0x1p3"), (5, "abc"), (6, "-1e3"), (7, None)],
        "k int, v string",
    )
    result = dict(schema.coerce_numeric(df, ["v"]).collect())
    assert result == {1: 1.5, 2: 7.0, 3: None, 4: None, 5: None, 6: -1000.0, 7: None}


def test_coercion_keeps_number_types(spark):
    df = spark.createDataFrame([(1, True)], "k int, flag boolean")
    assert [f.dataType.simpleString() for f in schema.coerce_numeric(df).schema] == [
        "int",
        "double",
    ]


def test_types_are_inferred_from_all_values_in_one_aggregate(spark, jobs):
    df = spark.createDataFrame(
        [("1", "1.5", "True", "x", "2020-01-01", None), (None, "2", "FALSE", "1", "b", None)],
        "a string, b string, c string, d string, e string, f string",
    )
    with jobs() as counted:
        typed = schema.infer_types(df)
    assert counted.count <= 2  # the stages of one aggregate
    assert [f.dataType.simpleString() for f in typed.schema] == [
        "bigint", "double", "boolean", "string", "string", "string",
    ]
    assert rows(typed) == [
        (1, 1.5, True, "x", "2020-01-01", None),
        (None, 2.0, False, "1", "b", None),
    ]


def test_coercion_leaves_dates_and_nested_values(spark):
    df = spark.sql("SELECT '12' s, true b, DATE'2024-01-02' d, TIMESTAMP_NTZ'2024-01-02 03:04:05' t, array(1) a, 3 i")
    out = schema.coerce_numeric(df)
    assert [t for _, t in out.dtypes] == ["double", "double", "date", "timestamp_ntz", "array<int>", "int"]
    assert tuple(out.first())[:2] == (12.0, 1.0)


def test_operators_take_headers_that_differ_in_case(spark):
    from tableprep.operators import completeness, dedup, outliers, typos
    from tableprep.operators.correlation import correlation

    df = spark.createDataFrame(
        [(1.0, 2.0, "ab", "NA"), (2.0, None, "ab", "x"), (3.0, 9.0, "ac", None)], ["v", "V", "t", "T.x"]
    )
    assert completeness.drop_sparse_columns(df, 0.5).columns == df.columns
    assert completeness.drop_sparse_rows(df, 1.0).count() == 1
    assert completeness.drop_na_rows(df, 0.5).count() == 1
    assert [r[3] for r in completeness.null_tokens(df, ["NA"]).collect()] == [None, "x", None]
    assert {r.column for r in outliers.quartiles(df).collect()} == {"v", "V"}
    assert outliers.drop_outliers(df, ["v"]).columns == df.columns
    assert {r.column for r in typos.value_counts(df).collect()} == {"t", "T.x"}
    assert {(r.col_x, r.col_y) for r in correlation(df).collect()} == {(a, b) for a in "vV" for b in "vV"}
    assert dedup.dedup_by_key(df, ["t"]).columns == df.columns
