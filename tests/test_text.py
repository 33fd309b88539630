import pytest
from pyspark.sql import functions as F

from tableprep.functions import normalize_text


def normalized(spark, text, **options):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(normalize_text(F.col("s"), **options)).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("\tHi  There &", " hi there "),
        ("Café X", "caf x"),
        ("a & b", "a  b"),
        ("&&&", ""),
        ("a_b/c:d.e-f", "ab/c:d.e-f"),
        ("  2020-01-01 10:00  ", "2020-01-01 10:00"),
        (None, None),
    ],
)
def test_steps_run_in_order(spark, text, expected):
    assert normalized(spark, text) == expected


def test_unicode_space(spark):
    text = " \tHi  There　"
    assert normalized(spark, text, unicode_ws=True) == "hi there"
    assert normalized(spark, "\x1cHi\x1d\x1eB\x1f", unicode_ws=True) == "hi b"


def test_squeeze_after(spark):
    assert normalized(spark, " a & b ! ", squeeze_after=True) == "a b"
