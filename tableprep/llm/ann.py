"""Approximate nearest neighbours by learned partitions.

A sample, bounded by ``sample``, is joined to a graph of its nearest
neighbours. The graph is cut into parts of equal size so that few edges cross:
halves along principal directions first, then moves to the part where most
neighbours are, within the balance. A small network learns the part of a
vector, from the parts of each sampled vector and its neighbours. Every row is
indexed in its most probable part; a query is sent to its most probable parts
and compared there with every row, by the exact distance.

How many parts a query is sent to is the least number for which the sample's
own neighbours are found at the rate ``recall``. Parts are searched in blocks
of bounded size, rows against queries, so a part may hold any number of either.
Clustered vectors need few parts. Vectors without structure, whose neighbours
are hardly nearer than the rest, need most of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import map_rows, stage_table

#: Neighbours of the graph, units of the hidden layer, rows or queries of a block.
NEIGHBOURS, HIDDEN, BLOCK = 10, 128, 8192
#: Rows that a part should hold, and the least and most parts.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1500, 32, 256
#: Excess of a part over an even share.
SLACK = 1.1


@dataclass
class Router:
    """The network, and how many parts a query is sent to."""

    first: np.ndarray
    second: np.ndarray
    scale: float
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _forward(x / self.scale, self.first, self.second)[1]


def _forward(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(np.c_[x, np.ones(len(x))] @ first, 0)
    z = np.c_[hidden, np.ones(len(x))] @ second
    e = np.exp(z - z.max(1, keepdims=True))
    return hidden, e / e.sum(1, keepdims=True)


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row, in blocks."""
    norm = (x**2).sum(1)
    out = []
    for a in range(0, len(x), 1024):
        d = norm - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argsort(d, axis=1)[:, :k] if k >= len(x) - 1 else _smallest(d, k))
    return np.concatenate(out)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    some = np.argpartition(d, k, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row, none larger than ``SLACK`` times an even share."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, low, n = todo.pop()
        if n == 1 or not len(rows):
            part[rows] = low
            continue
        centred = x[rows] - x[rows].mean(0)
        direction = np.linalg.svd(centred[:: max(1, len(rows) // 2000)], full_matrices=False)[2][0]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], low, left), (order[cut:], low + left, n - left)]
    # An edge counts from both sides.
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    u, v = np.r_[source, graph.ravel()], np.r_[graph.ravel(), source]
    order = np.argsort(u, kind="stable")
    v = v[order]
    start = np.searchsorted(u[order], np.arange(len(x) + 1))
    most = max(1, int(np.ceil(SLACK * len(x) / parts)))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        votes = np.bincount(np.repeat(np.arange(len(x)), np.diff(start)) * parts + part[v], minlength=len(x) * parts)
        votes = votes.reshape(len(x), parts)
        gain = votes.max(1) - votes[np.arange(len(x)), part]
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            near = np.bincount(part[v[start[i] : start[i + 1]]], minlength=parts)
            near = np.where(size < most, near, -1)
            to = int(near.argmax())
            if near[to] > np.count_nonzero(part[v[start[i] : start[i + 1]]] == part[i]):
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, parts: int, recall: float, k: int, seed: int = 3, epochs: int = 40) -> Router:
    """Fit the network by Adam to the parts of sampled rows and their neighbours."""
    random = np.random.default_rng(seed)
    scale = float(np.sqrt((x**2).mean())) or 1.0
    z = x / scale
    parts = max(1, min(parts, len(x) // 4))
    graph = nearest(z, min(NEIGHBOURS, len(z) - 1)) if len(z) > 1 else np.zeros((len(z), 0), np.int64)
    part = balanced_parts(z, graph, parts)
    # The label of a row: the parts of its neighbours and its own.
    label = np.zeros((len(z), parts))
    for column in [part, *(part[g] for g in graph.T)]:
        label[np.arange(len(z)), column] += 1
    label /= label.sum(1, keepdims=True)
    w = [
        random.normal(0, np.sqrt(2 / (z.shape[1] + 1)), (z.shape[1] + 1, HIDDEN)),
        random.normal(0, np.sqrt(1 / (HIDDEN + 1)), (HIDDEN + 1, parts)),
    ]
    m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(z)), max(1, len(z) // 256)):
            hidden, p = _forward(z[rows], *w)
            error = (p - label[rows]) / len(rows)
            back = (error @ w[1][:-1].T) * (hidden > 0)
            grads = [np.c_[z[rows], np.ones(len(rows))].T @ back, np.c_[hidden, np.ones(len(rows))].T @ error]
            t += 1
            for i, g in enumerate(grads):
                g += 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g**2
                w[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(*w, scale, parts)
    # Where the network puts the sampled rows, how far down a row's list its neighbours' parts are.
    p = router.probabilities(x)
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    home = p.argmax(1)
    near = nearest(z, min(k, len(z) - 1)) if len(z) > 1 else graph
    if near.size:
        depth = np.take_along_axis(place, home[near], 1)
        router.probes = int(np.quantile(depth, recall, method="higher")) + 1
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (width[0].n if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fitted(rows: DataFrame, total: int, sample: int, recall: float, k: int) -> Router | None:
    """The router learned on distinct vectors, chosen by their hash."""
    dealt = F.xxhash64("v")
    share = min(1.0, 4 * sample / max(total, 1))
    some = rows.where((dealt.cast("double") / 2.0**64 + 0.5) <= share) if share < 1 else rows
    picked = some.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    if not picked:
        return None
    x = np.array([r.v for r in picked], np.float64)
    return learn(x, max(LEAST_PARTS, min(MOST_PARTS, total // PART_ROWS)), recall, k)


def routed(rows: DataFrame, router: Router, every: int) -> DataFrame:
    """Adds ``part``, and for queries ``probes``, all parts by falling probability."""

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = router.probabilities(_matrix(batch.column("v")))
        ids = batch.column("vec_id").to_numpy()
        probes = [np.argsort(-p[i], kind="stable").astype(np.int32) if ids[i] % every == 0 else None for i in range(len(ids))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                batch.column("v"),
                pa.array(p.argmax(1).astype(np.int32)),
                pa.array(probes, pa.list_(pa.int32())),
            ],
            ["vec_id", "v", "part", "probes"],
        )

    kind = rows.schema["v"].dataType.simpleString()
    return stage_table(map_rows(rows, route, f"vec_id bigint, v {kind}, part int, probes array<int>"))


def _blocks(part: Column, counts: dict[int, int]) -> Column:
    """The number of blocks of a part."""
    number = F.create_map(*(F.lit(x) for p, n in counts.items() for x in (p, -(-n // BLOCK))))
    return F.coalesce(number[part], F.lit(1)) if counts else F.lit(1)


FOUND = "query_id bigint, vec_id bigint, score double"


def _compare(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of a block for each query of a block, by the exact distance."""
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    x, ids = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
    q, asked = np.stack(queries["v"].to_numpy()).astype(np.float64), queries["vec_id"].to_numpy()
    norm = (x**2).sum(1)
    out = []
    for a in range(0, len(q), 256):
        rough = norm - 2 * q[a : a + 256] @ x.T
        for i, d in enumerate(rough):
            d[ids == asked[a + i]] = np.inf
            last = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
            # All that rounding could put among the first; equal ones too.
            own = (q[a + i] ** 2).sum()
            near = np.flatnonzero((d <= last + 1e-9 * (own + abs(last) + norm.max())) & np.isfinite(d))
            exact = np.sqrt(((x[near] - q[a + i]) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))[:k]
            out.append(pd.DataFrame({"query_id": asked[a + i], "vec_id": ids[near][order], "score": exact[order]}))
    return pd.concat(out)


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, sample: int = 8192, recall: float = 0.96
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the neighbours found.

    Queries are the ids divisible by ``every``; a row of the query's own id is
    no neighbour. Vectors that are null, zero, of another length than most, or
    with a null or non-finite component take no part, nor do rows without an
    id. Of repeated query rows the least vector asks; repeated rows are
    neighbours each by itself. Ties go to the smaller id. A query goes to so
    many parts that they hold ``k`` other rows, if there are so many. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    router = fitted(rows, total, sample, recall, k)
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if router is None:
        return spark.createDataFrame([], empty)
    index = routed(rows, router, every)
    counts = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part
    sizes = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
    # A query takes its first parts, and further ones until they hold k + 1 rows.
    step = lambda s, p: F.struct(
        F.when((F.size(s["taken"]) < router.probes) | (s["held"] <= k), F.array_append(s["taken"], p)).otherwise(s["taken"]).alias("taken"),
        (s["held"] + F.when((F.size(s["taken"]) < router.probes) | (s["held"] <= k), F.coalesce(sizes[p], F.lit(0))).otherwise(0)).alias("held"),
    )
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).cast("long").alias("held"))
    queries = (
        index.where("probes IS NOT NULL")
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "probes")).alias("x"))
        .select("vec_id", "x.v", F.aggregate("x.probes", start, step)["taken"].alias("taken"))
        .select("vec_id", "v", F.explode("taken").alias("part"))
    )
    queries = stage_table(queries)
    asked = {r.part: r["count"] for r in queries.groupBy("part").count().collect()}
    row_block = F.pmod(F.xxhash64("vec_id"), _blocks(F.col("part"), counts)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id"), _blocks(F.col("part"), asked)).cast("int")
    every_row = index.select(
        "part", row_block.alias("r"), F.explode(F.sequence(F.lit(0), _blocks(F.col("part"), asked) - 1)).alias("q"), "vec_id", "v"
    )
    every_query = queries.select(
        "part", F.explode(F.sequence(F.lit(0), _blocks(F.col("part"), counts) - 1)).alias("r"), query_block.alias("q"), "vec_id", "v"
    )

    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _compare(rows, queries, k)

    found = every_row.groupBy("part", "r", "q").cogroup(every_query.groupBy("part", "r", "q")).applyInPandas(compare, FOUND)
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
