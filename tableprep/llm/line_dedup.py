"""Recurring lines by a log-template tree.

A line is parsed to tokens; a token with a digit is a variable from the start.
The tree has fixed depth: the number of tokens, then the ``DEPTH`` leading
tokens. A leaf holds any number of templates. A token can be part of one if at
least ``documents`` documents of the leaf have it at its place. The templates a
line may have are its tokens above each level of such counts, from the most
frequent ones on, and the widest of these without any one token; a template must keep at least half of the line's tokens. The whole
line, with only tokens with digits generalised, is one too. A template that
occurs in at least ``documents`` documents recurs; lines that have one that
recurs are dropped. All bars are documents, none is a share of the input.

Everything is a DataFrame expression. Equal lines are counted before their
tokens are looked at, so a line that a third of all documents have is one row
with a count.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import documents, stage_table

DEPTH = 3
KEPT = 0.5
VARIABLE = "<*>"


def shapes_of(text: str = "text") -> Column:
    """The lines of a text with one space between tokens, outer ones perhaps, and tokens with a digit generalised."""
    # Most texts have the plain blank only; looking for the others is cheaper than translating.
    odd = reduce(or_, (F.contains(text, F.lit(x)) for x in "\t\x0b\f\r"))
    raw = F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(F.col(text))
    single = F.when(F.contains(raw, F.lit("  ")), F.regexp_replace(raw, " +", " ")).otherwise(raw)
    token = "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"  # tried once a token
    masked = F.when(single.rlike("[0-9]"), F.regexp_replace(single, token, VARIABLE)).otherwise(single)
    return F.split(masked, "\n")


def width_of(shape: Column) -> Column:
    """The number of tokens of a shape, which has one space between tokens."""
    return F.length(shape) - F.length(F.replace(shape, F.lit(" "), F.lit(""))) + 1


def leaf_of(shape: Column) -> Column:
    """The leaf of the tree: number of tokens and leading tokens."""
    return F.xxhash64(width_of(shape), F.substring_index(shape, " ", DEPTH))


def templates(shapes: DataFrame, least: int) -> DataFrame:
    """``s``, ``n`` and the hash ``t`` of each template that a shape may have.

    Shapes come with ``leaf``, ``s`` (their hash), ``shape`` and ``n``
    (documents that have them).
    """
    placed = shapes.select(
        "leaf", "s", "n", F.size(F.split("shape", " ")).alias("width"), F.posexplode(F.split("shape", " ")).alias("at", "token")
    ).where(F.col("token") != VARIABLE)
    frequent = placed.groupBy("leaf", "at", "token").agg(F.sum("n").alias("have")).where(F.col("have") >= least)
    lines = (
        placed.join(frequent, ["leaf", "at", "token"])
        .groupBy("leaf", "s", "n", "width")
        .agg(F.collect_list(F.struct("have", F.xxhash64("at", "token").alias("h"))).alias("kept"))  # tokens of one line
        .where(F.size("kept") >= KEPT * F.col("width"))
    )
    all_of = lambda tokens: F.aggregate(tokens, F.lit(0).cast("long"), lambda h, x: h.bitwiseXOR(x["h"]))
    above = lambda level: F.filter("kept", lambda x: x["have"] >= level)
    enough = lambda size: size >= KEPT * F.col("width")
    name = lambda h, size: F.xxhash64("leaf", h, size)
    levels = F.filter(F.array_distinct("kept.have"), lambda x: enough(F.size(above(x))))
    by_level = F.transform(levels, lambda x: name(all_of(above(x)), F.size(above(x))))
    one_less = F.when(
        enough(F.size("kept") - 1),
        F.transform("kept", lambda x: name(F.col("whole").bitwiseXOR(x["h"]), F.size("kept") - 1)),
    ).otherwise(F.array().cast("array<bigint>"))
    return lines.withColumn("whole", all_of(F.col("kept"))).select(
        "s", "n", F.explode(F.array_distinct(F.concat(by_level, one_less))).alias("t")
    )


def recurring(base: DataFrame, least: int) -> DataFrame:
    """``key`` and ``at``, the places of lines whose template occurs in at least so many documents."""
    # Lines are rows before they are looked at, as code is generated for rows, not for the elements of an array.
    places = stage_table(
        base.select("key", F.posexplode(shapes_of()).alias("at", "line"))
        .select("key", "at", F.trim("line").alias("shape"))
        .where("shape <> ''")
        .select("key", "at", F.xxhash64("shape").alias("s"), leaf_of(F.col("shape")).alias("leaf"))
    )
    counts = stage_table(
        places.select("leaf", "s", "key").distinct().groupBy("leaf", "s").agg(F.count("*").alias("n"))
    )
    # Only a leaf of several shapes can be generalised, and only one of enough documents can recur.
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("shapes")).where(
        (F.col("shapes") > 1) & (F.col("total") >= least)
    )
    texts = (
        base.select(F.explode(shapes_of()).alias("line"))
        .select(F.trim("line").alias("shape"))
        .where("shape <> ''")
        .select("shape", F.xxhash64("shape").alias("s"), leaf_of(F.col("shape")).alias("leaf"))
        .join(leaves.select("leaf"), "leaf", "left_semi")
        .dropDuplicates(["leaf", "s"])
    )
    general = stage_table(templates(texts.join(counts, ["leaf", "s"]), least))
    several = general.groupBy("t").agg(F.count("*").alias("shapes"), F.sum("n").alias("n"), F.max("n").alias("most")).where(
        (F.col("shapes") > 1) & (F.col("n") >= least)
    )
    sure = several.where(F.col("most") >= least).select("t")
    # A document may have several shapes of one template, so there the documents are counted anew.
    shared = general.join(several.where(F.col("most") < least).select("t"), "t").select("s", "t")
    counted = (
        places.join(shared, "s").select("t", "key").distinct().groupBy("t").agg(F.count("*").alias("n"))
        .where(F.col("n") >= least).select("t")
    )
    alike = general.join(sure.union(counted), "t", "left_semi").select("s")
    gone = counts.where(F.col("n") >= least).select("s").union(alike)
    return places.join(gone, "s", "left_semi").select("key", "at")


def drop_recurring(docs: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``text`` without recurring lines, for each row.

    A line recurs if its template occurs in at least ``least`` documents.
    Lines end at a line feed. Blank lines are always kept. A line that recurs
    only within one document is kept. Rows with the same id and text count as
    one document, rows of one id with other texts as different ones. A null or
    empty text has no lines and gives an empty text. Other columns are not
    read. An empty table gives an empty result.
    """
    base = documents(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    gone = recurring(base, least).groupBy("key").agg(F.collect_set("at").alias("gone"))  # lines of one text
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    return base.join(gone, "key", "left").select(
        "doc_id",
        F.when(F.col("text") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
