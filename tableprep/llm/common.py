"""What the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.sources.tables import stage_table

#: Blanks that separate words: the space and U+0009 to U+000D.
BLANKS = "\x20\x09-\x0d"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null being the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (never null) and the further columns named; others go.

    Later code can then add columns of any name without a clash.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *more
    )


def map_rows(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, most: int | None = None
) -> DataFrame:
    """Apply a function from Arrow batch to Arrow batch, of ``most`` rows if given, within the tasks."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a in range(0, batch.num_rows, most or max(batch.num_rows, 1)):
                yield function(batch.slice(a, most))

    return map_batches(df, batches, schema)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow``; a task leaves no memory with its process, which waits for others while Spark sorts and joins."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(rows)
        give_back()

    return df.mapInArrow(batches, schema)


def give_back() -> None:
    """What the allocators of Arrow and C keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


SPANS = "array<struct<kind:string,start:bigint,stop:bigint,plain:boolean>>"


def find_spans(
    docs: DataFrame, find: Callable[[str], list[tuple[str, int, int, bool]]]
) -> DataFrame:
    """``doc_id`` and the spans found in each whole text; a row of its own for each row."""
    schema = f"doc_id bigint, spans {SPANS}"
    out = arrow_schema(schema)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column("text"):
            spans = find(text.as_py())
            found.append([dict(zip(("kind", "start", "stop", "plain"), x, strict=True)) for x in spans])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, out.field("spans").type)], schema=out
        )

    return map_rows(documents(docs), scan, schema)


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    return F.array_join(F.transform(spans, one), ",")


def plain_spans(*kinds: str) -> Column:
    return F.filter("spans", lambda x: x["plain"] & x["kind"].isin(*kinds))


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain types, arrays and structs."""
    plain = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(),
    }

    def of(kind: T.DataType) -> pa.DataType:
        if isinstance(kind, T.ArrayType):
            return pa.list_(of(kind.elementType))
        if isinstance(kind, T.StructType):
            return pa.struct([(f.name, of(f.dataType)) for f in kind])
        return plain[kind.simpleString()]

    return pa.schema([(f.name, of(f.dataType)) for f in T.StructType.fromDDL(schema)])
