import random

import pytest

#: Names that the operators use inside, as further columns of their input.
CLASHING = ("key", "size", "row", "shard", "n", "part", "leader", "set_id", "place", "rank", "x", "spans", "lines", "_n", "end")
WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ha", "ki", "lo", "mu", "ne") for b in ("ra", "se", "ti", "vo", "zu", "an", "el", "is")]


def prose(seed: int, n: int) -> str:
    random_ = random.Random(seed)
    out = [random_.choice(WORDS) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") + ("\n" if i % 27 == 26 else "") for i, w in enumerate(out)).replace("\n ", "\n")


def edited(text: str, seed: int, share: float) -> str:
    random_ = random.Random(seed)
    return " ".join("other" if random_.random() < share else w for w in text.split(" "))


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def corpus():
    """Rows (id, text, source): prose, exact and near copies, shared passages, edge cases, repeated rows."""
    rows = [(i, prose(i, 30 + 7 * i), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, prose(3, 51), "s0") for i in range(5)]
    rows += [(110 + i, edited(prose(30, 240), i, 0.02), None) for i in range(12)]
    rows += [(130 + i, prose(200 + i, 40) + "\n" + prose(5, 65) + "\n" + prose(300 + i, 40), "s9") for i in range(6)]
    rows += [
        (150, None, "s1"), (151, "", "s1"), (152, " \t\n ", None), (153, "one two", "s2"), (154, "ONE two", "s2"),
        (155, prose(77, 30_000), "s3"), (156, "é" * 60 + " ünï", "s3"), (157, "a b c d e", "s3"), (157, "a b c d e", "s3"),
        (None, prose(8, 86), "s1"), (None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The corpus with further columns whose names clash, written as a table."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("corpus") / "docs")
    df = spark.createDataFrame(corpus, SCHEMA).withColumns({c: F.lit(7) for c in CLASHING})
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
