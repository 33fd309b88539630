"""Mixing sources to target weights by pivotal dependent rounding.

The target of a source over its size is the number of copies that each of its
documents should get: a whole number and a fraction. The fractions are rounded
dependently. Two documents meet; words move from one to the other, in a random
direction that keeps both expectations, until one of them is taken whole or
not at all. The other one, still fractional, meets the next. Blocks of
``BLOCK`` neighbours do so within one row each, their remainders meet in blocks
of the next level, and so on up a tree whose height is a logarithm of the
rows. At its root one document of each source is left and is drawn. A source
so takes its target up to the size of one document.

All randomness is a hash of the row and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import BLANKS, documents, stage_table
from tableprep.llm.ordered import running_totals

# Weights by the place of a source, the share of all sizes, the bound.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
BOUND = 2

BLOCK = 64


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``place``, ``weight`` and ``target`` to rows of ``source`` and ``source_size``.

    Sources stand in the order of code points, null last. A target is the
    weight times one level, but at most the bound. Sources that reach the
    bound are those with the least size over weight, so the level is found
    along that order from running totals.
    """
    placed = running_totals(
        sources, [F.asc_nulls_last("source")], {"place": F.lit(1).cast("long")}
    )
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight.cast("double")).withColumn(
        "bound", F.col("source_size").cast("double") * BOUND
    )
    whole = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    size, weights = whole[0] or 0, whole[1] or 0.0
    along = running_totals(
        weighed,
        [(F.col("bound") / F.col("weight")), F.col("place")],
        {"bounds": F.col("bound"), "weights": F.col("weight")},
    )
    level = (SHARE * size - (F.col("bounds") - F.col("bound"))) / (
        weights - (F.col("weights") - F.col("weight"))
    )
    found = (
        along.select((F.col("bound") / F.col("weight")).alias("at"), "place", level.alias("level"))
        .where("at >= level")
        .agg(F.min_by("level", F.struct("at", "place")))
        .first()[0]
    )
    share = F.col("bound") if found is None else F.least("bound", F.col("weight") * F.lit(found))
    return stage_table(weighed.select("source", "source_size", "place", "weight", share.alias("target")))


def _draw(level: int, seed: int) -> Column:
    """A number from 0 to 1 for each row and level."""
    bits = F.xxhash64("row", F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return bits.cast("double") / float(1 << 52)


def _meet(kept: Column, other: Column) -> Column:
    """The pivotal step: which of two is done, whether it is taken, and the one that goes on."""
    room, mass = kept["size"] - kept["mass"], kept["mass"]
    other_room, other_mass = other["size"] - other["mass"], other["mass"]
    up, down = F.least(room, other_mass), F.least(mass, other_room)
    rises = other["draw"] * (up + down) < down

    def step(done: Column, taken: bool, on: Column, left: Column) -> Column:
        return F.struct(
            F.struct(done["row"].alias("row"), done["doc_id"].alias("doc_id"), done["key"].alias("key"),
                     done["place"].alias("place"), done["size"].alias("size"), F.lit(taken).alias("taken")).alias("done"),
            on.withField("mass", left).alias("on"),
        )

    return (
        F.when(rises & (room <= other_mass), step(kept, True, other, other_mass - room))
        .when(rises, step(other, False, kept, mass + other_mass))
        .when(mass <= other_room, step(kept, False, other, other_mass + mass))
        .otherwise(step(other, True, kept, mass - other_room))
    )


DONE = "array<struct<row:bigint,doc_id:bigint,key:bigint,place:bigint,size:bigint,taken:boolean>>"


def _blocks(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Lets the fractional rows of each block meet; ``done`` are settled, ``on`` goes on."""
    member = F.struct("row", "doc_id", "key", "place", "size", "mass", "draw")
    block = F.floor(F.col("row") / F.lit(BLOCK**level)).alias("block")
    gathered = (
        rows.withColumn("draw", _draw(level, seed))
        .groupBy("place", block)
        .agg(F.array_sort(F.collect_list(member)).alias("members"))  # at most BLOCK rows
    )
    start = F.struct(F.element_at("members", 1).alias("on"), F.array().cast(DONE).alias("done"))
    rest = F.slice("members", 2, BLOCK)

    def merge(state: Column, member: Column) -> Column:
        met = _meet(state["on"], member)
        return F.struct(met["on"].alias("on"), F.array_append(state["done"], met["done"]).alias("done"))

    return gathered.select(F.aggregate(rest, start, merge).alias("state")).select("state.on", "state.done")


def copies(docs: DataFrame, seed: int = 6) -> DataFrame:
    """Rows of ``doc_id``, ``key`` (hash of the text), ``source``, ``size``, ``source_size``, ``target``, ``copies``.

    One row for each row. The size is the number of words, 0 for a null or
    blank text; such rows get the whole part of the copies. A null source is a
    source of its own, the last one. Rows without an id take part like others,
    as do repeated rows, each by itself. An empty table gives an empty result.
    """
    rows = stage_table(
        documents(docs, F.col("source").cast("string").alias("source")).select(
            "doc_id",
            F.xxhash64("text").alias("key"),
            "source",
            F.regexp_count("text", F.lit(f"[^{BLANKS}]+")).cast("long").alias("size"),
        )
    )
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(each + 1e-12)).withColumn(
        "part", F.greatest(each - F.col("whole"), F.lit(0.0))
    )
    placed = running_totals(
        rows,
        [F.asc_nulls_last("source"), F.asc("doc_id"), F.asc("key")],
        {"row": F.lit(1).cast("long")},
    )
    joined = placed.join(sources.select("source", "place", "part"), placed["source"].eqNullSafe(sources["source"])).drop("source")
    fractional = (F.col("part") > 1e-12) & (F.col("size") > 0)
    settled = [joined.where(~fractional).select("doc_id", "key", "place", "size", F.lit(0).alias("more"))]
    level_rows = joined.where(fractional).select(
        "row", "doc_id", "key", "place", "size", (F.col("part") * F.col("size")).alias("mass")
    )
    last = placed.agg(F.max("row")).first()[0] or 0
    level = 1
    while True:
        blocks = stage_table(_blocks(level_rows, level, seed))
        done = blocks.select(F.explode("done").alias("x"))
        settled.append(done.select("x.doc_id", "x.key", "x.place", "x.size", F.col("x.taken").cast("int").alias("more")))
        level_rows = blocks.select("on.row", "on.doc_id", "on.key", "on.place", "on.size", "on.mass")
        if BLOCK**level > last:
            break
        level += 1
    drawn = _draw(0, seed) * F.col("size") < F.col("mass")
    settled.append(level_rows.select("doc_id", "key", "place", "size", drawn.cast("int").alias("more")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.join(sources, "place").select(
        "doc_id", "key", "source", "size", "source_size", "target",
        (F.col("whole") + F.col("more")).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, seed: int = 6) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, all columns kept.

    Rows of equal id, source and text share what was taken of them.
    """
    same = ["_id", "_source", "_key"]
    taken = (
        copies(docs, seed)
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"))
        .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    )
    mine = {
        "_id": F.col("doc_id").cast("long"),
        "_source": F.col("source").cast("string"),
        "_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    }
    keyed = docs.select("*", *(v.alias(k) for k, v in mine.items())).alias("a")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    both = keyed.join(taken.where("_copies > 0").alias("b"), on).select("a.*", "_copies", "_rows")
    once = both.where("_rows = 1").withColumn("_n", F.col("_copies"))
    # Of n equal rows, the first get one copy more than the others.
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))
    often = both.where("_rows > 1").withColumn(
        "_n",
        F.floor(F.col("_copies") / F.col("_rows")) + (turn <= F.col("_copies") % F.col("_rows")).cast("int"),
    )
    repeated = once.unionByName(often).where("_n > 0")
    return repeated.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*docs.columns)
