"""Table sources and sinks.

CSV text is written so that it reads back the same: quotes are doubled, outer
blanks kept. Only the empty text comes back as missing. Tables are directories of part files; nothing passes through the
driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tableprep.operators.completeness import null_tokens
from tableprep.operators.schema import infer_types

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Temporary folders of local applications whose session names none.
_LOCAL: dict[str, str] = {}

# Paths staged in the innermost open scope; None where no scope is open.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: StructType | str | None = None,
    tokens: Sequence[str] | None = None,
    multi_line: bool = False,
    **options: Any,
) -> DataFrame:
    """Read a table; CSV has a header row, and types are inferred.

    With a ``schema`` nothing is inferred, which saves a pass. With ``tokens``
    the CSV cells equal to one of them are missing, and types are inferred
    from the other cells. ``multi_line`` allows line breaks within quotes, at
    the price that one file is then read by one task.
    """
    reader = spark.read
    if fmt == "csv":
        infer = schema is None and tokens is None
        reader = reader.options(
            header=True, inferSchema=infer, quote='"', escape='"', multiLine=multi_line
        )
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if tokens is not None:
        df = null_tokens(df, tokens)
        if fmt == "csv" and schema is None:
            df = infer_types(df)
    return df


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "error",
    single_file: bool = False,
    **options: Any,
) -> None:
    """Write a table as a directory of files.

    ``single_file`` funnels the whole table through one task; it is meant for
    small results only.
    """
    if single_file:
        df = df.coalesce(1)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(
            header=True,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    writer.options(**options).format(fmt).save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the session names none, a temporary folder serves a local master.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    # Spark does not let a running session's setting be changed, so the folder is remembered here.
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="tableprep-")
    return _LOCAL[application]


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder, noted in the open scope."""
    path = f"{shared_folder(spark)}/tableprep-{uuid.uuid4().hex}"
    noted = _STAGED.get()
    if noted is not None:
        noted.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file by Spark's file systems; none there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """A scope for staged tables: what was staged within is deleted at its end, also after a failure.

    Results that read staged tables have to be used or written before. The
    paths staged so far are given. Scopes nest; an inner one deletes its own.
    Without a scope staged tables stay, as results may still read them.
    """
    noted: list[str] = []
    token = _STAGED.set(noted)
    try:
        yield noted
    finally:
        _STAGED.reset(token)
        for path in noted:
            delete_path(spark, path)


def stage_table(df: DataFrame) -> DataFrame:
    """Write a table as parquet in the shared folder and read it back.

    Later passes then read only the columns they need and do not depend on
    the work before, nor on any executor that did it. See ``staging`` for how
    long the written table stays.
    """
    path = stage_path(df.sparkSession)
    # Staged columns get plain names: a raw header may hold any character.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
