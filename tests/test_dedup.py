from helpers import rows
from pyspark.sql import functions as F

from tableprep.operators.dedup import dedup_by_key


def test_first_by_order_and_null_keys_are_one_key(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (None, "d"), (None, "c")], "k int, v string"
    )
    assert rows(dedup_by_key(df, ["k"], order_by=["v"])) == [(1, "a"), (None, "c")]
    assert rows(dedup_by_key(df, ["k"], order_by=[F.desc("v")])) == [(1, "b"), (None, "d")]


def test_any_row_survives_without_order(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) k", "id v")
    kept = dedup_by_key(df, ["k"])
    assert kept.count() == kept.select("k").distinct().count() == 667


def test_compound_key(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, 1), (1, 2, 3)], "a int, b int, v int")
    assert rows(dedup_by_key(df, ["a", "b"], order_by=["v"])) == [(1, 1, 1), (1, 2, 3)]


def test_a_hot_key_shrinks_before_the_shuffle(spark):
    df = spark.range(0, 9000, 1, 6).selectExpr("if(id % 3 = 0, 0, id) k", "id v")
    kept = dedup_by_key(df, ["k"], order_by=["v"])
    text = kept._jdf.queryExecution().executedPlan().toString()
    limit, shuffle = text.index("row_number(), 1, Partial"), text.index("Exchange")
    assert shuffle < limit  # printed from the result down: the limit runs first
    assert kept.where("k = 0").collect() == [(0, 0)]
    any_row = dedup_by_key(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert any_row.count("Aggregate") >= 2


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_keys_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 5000, 1, 4).selectExpr("id k", "id * 2 v", "cast(id as string) s").write.parquet(path)
    df = spark.read.parquet(path)
    kept = dedup_by_key(df, ["k"])
    assert "Exchange" not in physical(kept) and rows(kept) == rows(df)
    assert "Exchange" not in physical(dedup_by_key(df, ["k", "s"], order_by=["v"]))
    assert "Exchange hashpartitioning" in physical(dedup_by_key(df, ["k"], spare_unique=False))


def test_only_rows_of_repeated_keys_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    unique = spark.range(0, 5000, 1, 4).selectExpr("if(id = 7, null, id) k", "0 v", "double(if(id % 2 = 0, id, -id)) x")
    more = spark.createDataFrame([(3, 1, 1.0), (3, -1, 2.0), (None, -5, 3.0), (4000, 9, 4.0)], "k long, v int, x double")
    unique.unionByName(more).write.parquet(path)
    df = spark.read.parquet(path)
    kept = dedup_by_key(df, ["k"], order_by=["v"])
    text = physical(kept)
    assert "LeftAnti" in text and "LeftSemi" in text and "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning") == 1  # that of the few rows
    assert rows(kept) == rows(dedup_by_key(df, ["k"], order_by=["v"], spare_unique=False))
    assert kept.where("k = 3").first()["v"] == -1 and kept.where("k is null").first()["v"] == -5
    assert kept.count() == 5000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "LeftSemi" not in physical(dedup_by_key(df, ["k"]))  # too large: all rows are shuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_that_compare_as_equal(spark):
    nan, zero = float("nan"), -0.0
    table = [(nan, 1), (nan, 2), (0.0, 3), (zero, 4), *((float(i), i) for i in range(10, 60))]
    df = spark.createDataFrame(table, "k double, v int")
    kept = rows(dedup_by_key(df, ["k"], order_by=["v"]).select("v"))
    assert kept == rows(dedup_by_key(df, ["k"], order_by=["v"], spare_unique=False).select("v"))
    assert len(kept) == 52


def test_headers_that_differ_in_case_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), *((i, i) for i in range(5, 40))], "a int, b int").toDF("k", "K")
    assert len(rows(dedup_by_key(df, ["k"], order_by=["K"]))) == 36
    assert rows(dedup_by_key(spark.createDataFrame([], "k int"), ["k"])) == []
