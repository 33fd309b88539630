"""One row per key.

Rows of a key that stands once need no shuffle. A count of rows and an
estimate of distinct keys, from one scan of the keys, tell whether most keys
stand once. If so, the keys that stand more than once are counted exactly and
written. None of them: the table is the result. Few of them: Spark joins them
to the table by broadcast, going by the written size, and only their rows are
shuffled. Otherwise all rows are shuffled.

Wherever rows are shuffled they are first reduced on the map side: every task
sends at most one row per key, so a key that holds a third of the table costs
no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tableprep.functions.names import any_headers, quoted
from tableprep.operators.statistics import reckoned_bytes
from tableprep.sources.tables import stage_table

_RANK = "__rank_in_key"

# Distinct keys per row from which on keys that stand once are spared the shuffle.
MOSTLY_UNIQUE = 0.8


@any_headers
def dedup_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column] | None = None,
    spare_unique: bool = True,
) -> DataFrame:
    """Keep one row for each key; all NULL keys count as one key.

    With ``order_by`` the first row in that order survives, otherwise any.
    ``spare_unique`` reads the keys once or twice before, so the table has to
    give the same rows each time; without it the result is planned only.
    """
    keys = list(keys)
    if not spare_unique or not keys or not _mostly_unique(df, keys):
        return _shuffled(df, keys, order_by)
    repeated = repeated_keys(df, keys)
    if not repeated.count():
        return df
    if reckoned_bytes(repeated) > _threshold(df):
        return _shuffled(df, keys, order_by)
    same = reduce(and_, (quoted(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    once = df.join(repeated, same, "left_anti")
    more = df.join(repeated, same, "left_semi")
    return once.unionByName(_shuffled(more, keys, order_by))


def _shuffled(df: DataFrame, keys: list[str], order_by: Sequence[str | Column] | None) -> DataFrame:
    if not order_by:
        return df.dropDuplicates(keys)
    order = [quoted(c) if isinstance(c, str) else c for c in order_by]
    # Spark turns "row_number() = 1" into a limit per key before the shuffle.
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order)
    ranked = df.withColumn(_RANK, F.row_number().over(window))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK)


def _mostly_unique(df: DataFrame, keys: list[str]) -> bool:
    """Tasks send a count and a sketch; no key is shuffled."""
    if any(isinstance(df.schema[k].dataType, (MapType, VariantType)) for k in keys):
        return False  # such keys can't be hashed
    hashed = F.xxhash64(*[quoted(k) for k in keys])
    rows, distinct = df.agg(F.count(F.lit(1)), F.approx_count_distinct(hashed, 0.02)).first()
    return distinct >= MOSTLY_UNIQUE * rows


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``_k0, _k1, ...``: the keys of more than one row, written in the shared folder."""
    named = [quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    counted = df.select(*named).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return stage_table(counted.where("_n > 1").select(*names))


def _threshold(df: DataFrame) -> int:
    """The session's bound on what is broadcast; below zero nothing is."""
    value = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(value)
