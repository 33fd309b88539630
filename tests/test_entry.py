import __spark_entry__ as entry_points


def test_the_flagship_query_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == [
        "event_id", "ts", "user_id", "event_type", "value_", "value_sq", "propsjson",
    ]
    assert df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
