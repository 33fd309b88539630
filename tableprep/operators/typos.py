"""Likely typos: values close to a much used value of the same column.

The rows are reduced to distinct values with their counts, in one scan and one
shuffle for all columns. Each distinct value is then compared with the top
values of its column. Few top values go to every value as one small array with
a proven byte bound and need no join; most are ruled out by lengths and
character counts. Values too long for that bound are joined on their length.

For many top values an index finds those a distinct value can be close to, so
that values meet by equality and not in pairs of all. Two texts within an edit distance have a text in common that each becomes by
deleting at most that many characters. Short values and top values are
therefore joined on the hashes of what they become by deletions. A long text
has too many of those. Of a long top value, cut into one segment more than
edits are allowed, some segment stands unchanged in the other value, moved by
at most the edits; long values are joined on the hashes of such segments. The
edit distance decides on what met.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.functions.names import any_headers, quoted
from tableprep.operators.frequent import settled
from tableprep.operators.schema import string_columns

# Most top values that every value is compared with; of more, an index is made.
MOST_COMPARED = 1000
# Most bytes of top values that are handed to every task.
ARRAY_BYTES = 32 * 1024 * 1024
# A character takes at most this many bytes in UTF-8.
CHARACTER_BYTES = 4
# Most deletions that are tried of one value; longer values are joined by segments.
MOST_DELETIONS = 600
# Groups of characters that are counted in each value. An edit changes the count
# of at most two groups, each by one.
CHARACTER_GROUPS = ("aeiouAEIOU", "nrstNRST", "dhlcmDHLCM", "0", "12", "34", "56", "789")
# Counting characters of longer values costs more than it saves.
COUNTED_LENGTH = 256
# Rows of one repeated value that one task writes out.
REPEAT_CHUNK = 1_000_000
# Spark limits a ranked group before the shuffle up to this rank by default.
PARTIAL_LIMIT = 1000
RANK_SALTS = 256


@any_headers
def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` for text columns, NULL left out."""
    columns = _text_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    cells = df.select(*[quoted(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value"
    )
    return (
        cells.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@any_headers
def top_values(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 100) -> DataFrame:
    """``(column, value, n, rank)``: the most frequent values, ties by value.

    Summaries propose values and a recount decides, so texts that are not
    frequent are never shuffled. Columns whose frequent values do not stand
    out, as where nearly every value is unique, are counted in full.
    """
    columns = _text_columns(df, columns)
    found, left = settled(df, columns, top_n)
    if left or not columns:
        found.append(value_counts(df, left))
    return _rank(reduce(DataFrame.unionByName, found), top_n)


def _text_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    text = string_columns(df)
    return text if columns is None else [c for c in columns if c in text]


def _rank(counts: DataFrame, top_n: int) -> DataFrame:
    order = [F.desc("n"), F.asc("value")]
    if top_n > PARTIAL_LIMIT:
        salt = F.pmod(F.xxhash64("value"), F.lit(RANK_SALTS))
        counts = (
            counts.withColumn("salt", salt)
            .withColumn(
                "rank", F.row_number().over(Window.partitionBy("column", "salt").orderBy(*order))
            )
            .where(F.col("rank") <= top_n)
            .drop("salt", "rank")
        )
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= top_n)


def _traits(value: Column) -> Column:
    """What is compared before the edit distance."""
    length = F.length(value)
    counted = [length - F.length(F.translate(value, group, "")) for group in CHARACTER_GROUPS]
    groups = F.when(length <= COUNTED_LENGTH, F.array(*counted))
    return F.struct(length.alias("length"), groups.alias("groups"))


def _close(
    value: Column, traits: Column, other: Column, other_traits: Column, threshold: int
) -> Column:
    """Different, and within the edit distance."""
    moved = sum(
        (
            F.abs(traits["groups"][i] - other_traits["groups"][i])
            for i in range(len(CHARACTER_GROUPS))
        ),
        F.lit(0),
    )
    return (
        (F.abs(traits["length"] - other_traits["length"]) <= threshold)
        & F.coalesce(moved <= 2 * threshold, F.lit(True))
        & (value != other)
        & (F.levenshtein(value, other, threshold) >= 0)
    )


def _short_length(threshold: int, most: int) -> int:
    """The greatest length of a text that has at most so many deletions of up to ``threshold`` characters."""
    length = 0
    while length <= most and sum(math.comb(length + 1, k) for k in range(threshold + 1)) <= most:
        length += 1
    return length


def _deletions(value: Column, threshold: int) -> Column:
    """Hashes of the texts that a value becomes by deleting up to ``threshold`` characters, from left to right."""
    level = F.array(F.struct(F.lit(1).alias("at"), value.alias("text")))
    levels = [level]
    for _ in range(threshold):
        level = F.flatten(F.transform(level, _one_less))
        levels.append(level)
    return F.array_distinct(F.transform(F.flatten(F.array(*levels)), lambda x: F.xxhash64(x["text"])))


def _one_less(x: Column) -> Column:
    """The text without one character from its place on; nothing at its end."""
    text = x["text"]
    rest = F.sequence(x["at"], F.greatest(F.length(text), x["at"]))
    inside = F.filter(rest, lambda i: i <= F.length(text))
    return F.transform(
        inside, lambda i: F.struct(i.alias("at"), F.overlay(text, F.lit(""), i, F.lit(1)).alias("text"))
    )


def _segment_starts(length: Column, threshold: int) -> list[Column]:
    """Where the segments of a text of this length begin, from 0, and where the last one ends."""
    return [F.floor(length * F.lit(i) / F.lit(threshold + 1)).cast("int") for i in range(threshold + 2)]


def _segments(value: Column, threshold: int) -> Column:
    """Hashes of a top value's segments, each with its number and the value's length."""
    length = F.length(value)
    starts = _segment_starts(length, threshold)
    return F.array(*(
        F.xxhash64(length, F.lit(i), F.substring(value, start + 1, stop - start))
        for i, (start, stop) in enumerate(pairwise(starts))
    ))


def _probes(value: Column, threshold: int) -> Column:
    """Hashes of what can be a segment of a top value of a length near this value's."""
    moves = F.sequence(F.lit(-threshold), F.lit(threshold))

    def of_segment(i: int, start: Column, stop: Column, length: Column) -> Column:
        inside = F.filter(moves, lambda m: start + m >= 0)
        return F.transform(
            inside, lambda m: F.xxhash64(length, F.lit(i), F.substring(value, start + m + 1, stop - start))
        )

    def of_length(length: Column) -> Column:
        ends = pairwise(_segment_starts(length, threshold))
        return F.flatten(F.array(*(of_segment(i, start, stop, length) for i, (start, stop) in enumerate(ends))))

    lengths = F.sequence(F.greatest(F.length(value) - threshold, F.lit(0)), F.length(value) + threshold)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


@any_headers
def typo_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: int = 2,
    top_n: int = 100,
    array_bytes: int = ARRAY_BYTES,
    most_deletions: int | None = None,
) -> DataFrame:
    """``(column, value, possible_typos, n)``: each flagged distinct value.

    ``possible_typos`` lists the close top values, most frequent first. Two
    frequent values close to each other flag each other. Columns that hold no
    text are skipped. An index is made if ``top_n`` is large, or if
    ``most_deletions`` is given, which bounds what a value is indexed by
    before it counts as long. That and ``array_bytes`` change the work, not
    the result.
    """
    columns = _text_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, possible_typos array<string>, n bigint"
        )
    counts = value_counts(df, columns)
    top = _rank(counts, top_n)
    if most_deletions is not None or top_n > MOST_COMPARED:
        return _by_index(counts, top, threshold, MOST_DELETIONS if most_deletions is None else most_deletions)
    return _compared(counts, top, threshold, array_bytes // (CHARACTER_BYTES * top_n * len(columns)))


def _compared(counts: DataFrame, top: DataFrame, threshold: int, longest: int) -> DataFrame:
    """Every value with every top value of a near length; ``longest`` bounds those in the array."""
    # A value this short can only be close to a top value inside the bound.
    # ``n`` is at least 1, so it changes nothing here; it keeps the test above
    # the aggregate, whose uses stay equal, so that Spark computes it once.
    one = F.least(F.col("n"), F.lit(1))
    short = F.length("value") * one <= longest - threshold

    # Traits are computed before values are paired, once for each value.
    traits = _traits(F.col("value")).alias("traits")
    values = counts.select("column", "value", "n", traits)
    candidate = F.struct("rank", "value", traits).alias("t")
    listed = (
        top.where(F.length("value") <= longest)
        .select("column", candidate)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("t")).alias("top"))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "top"))))
    )
    by_array = (
        values.where(short)
        .select("*", F.try_element_at(listed.scalar(), F.col("column")).alias("top"))
        # The inner form would add a test on the array below the aggregate.
        .select("column", "value", "n", "traits", F.explode_outer("top").alias("t"))
    )
    lengths = F.sequence(F.length("value") - threshold, F.length("value") + threshold)
    long_top = top.where(F.length("value") > longest - 2 * threshold).select(
        "column", candidate, F.explode(lengths).alias("length")
    )
    by_length = (
        values.where(~short)
        .withColumn("length", F.length("value"))
        .join(long_top, ["column", "length"])
        .select("column", "value", "n", "traits", "t")
    )
    return _collected(by_array, threshold).unionByName(_collected(by_length, threshold))


def _by_index(counts: DataFrame, top: DataFrame, threshold: int, most_deletions: int) -> DataFrame:
    # Traits are computed before values are paired, once for each value.
    traits = _traits(F.col("value")).alias("traits")
    values = counts.select("column", "value", "n", traits)
    candidates = top.select("column", F.struct("rank", "value", traits).alias("t"))
    short = _short_length(threshold, most_deletions)
    value, top_value = F.col("value"), F.col("t.value")
    # ``n`` is at least 1, so it changes nothing here; it keeps the tests above
    # the aggregate, whose uses stay equal, so that Spark computes it once.
    length, top_length = F.length(value) * F.least(F.col("n"), F.lit(1)), F.length(top_value)

    by_deletion = _met(
        values.where(length <= short).withColumn("key", F.explode(_deletions(value, threshold))),
        candidates.where(top_length <= short).withColumn("key", F.explode(_deletions(top_value, threshold))),
    )
    # If either is longer than that, neither is much shorter.
    least = short - threshold
    by_segment = _met(
        values.where(length > least).withColumn("key", F.explode(_probes(value, threshold))),
        candidates.where(top_length > least).withColumn("key", F.explode(_segments(top_value, threshold))),
    )
    return _collected(by_deletion.unionByName(by_segment), threshold, F.collect_set)


def _met(values: DataFrame, candidates: DataFrame) -> DataFrame:
    return values.join(candidates, ["column", "key"]).drop("key")


def _collected(
    pairs: DataFrame, threshold: int, gather: Callable[[str], Column] = F.collect_list
) -> DataFrame:
    """The close top values of each value, in one row; with ``collect_set`` a pair that met by several keys counts once.

    Pairs made by the array still lie where their value was counted, so
    bringing them together again takes no shuffle.
    """
    close = _close(
        F.col("value"), F.col("traits"), F.col("t.value"), F.col("t.traits"), threshold
    )
    return (
        pairs.where(close)
        .select("column", "value", "n", F.struct("t.rank", "t.value").alias("top"))
        .groupBy("column", "value", "n")
        .agg(F.sort_array(gather("top")).alias("found"))
        .select(
            "column",
            "value",
            F.transform("found", lambda t: t["value"]).alias("possible_typos"),
            "n",
        )
    )


@any_headers
def find_typos(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: int = 2,
    top_n: int = 100,
    limit: int | None = None,
    array_bytes: int = ARRAY_BYTES,
) -> DataFrame:
    """``(column, value, possible_typos)``, one row per flagged cell.

    The rows come from the counts of the flagged values, not from a join with
    the table. A value with very many cells is split into chunks and spread
    over the cluster before it is written out. ``limit`` is a preview.
    """
    flagged = typo_values(df, columns, threshold, top_n, array_bytes)
    last_chunk = F.floor((F.col("n") - 1) / REPEAT_CHUNK)
    chunks = flagged.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)).alias("chunk")
    )
    size = F.least(F.lit(REPEAT_CHUNK), F.col("n") - F.col("chunk") * REPEAT_CHUNK)
    # A fixed number of partitions: sized by bytes, the few chunks would all be
    # put into one task, although each stands for up to a million rows.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        chunks.withColumn("size", size.cast("int"))
        .repartition(partitions, "column", "value", "chunk")
        .select(
            "column", "value", "possible_typos", F.explode(F.sequence(F.lit(1), F.col("size")))
        )
        .drop("col")
    )
    return rows if limit is None else rows.limit(limit)


@any_headers
def typo_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: int = 2,
    top_n: int = 100,
    array_bytes: int = ARRAY_BYTES,
) -> DataFrame:
    """``(column, flagged_values, flagged_rows)`` for columns with any typo."""
    return (
        typo_values(df, columns, threshold, top_n, array_bytes)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("flagged_values"), F.sum("n").alias("flagged_rows"))
    )
