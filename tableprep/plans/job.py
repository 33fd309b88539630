"""The batch job: read a table, clean it, write it and its report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from tableprep.operators.profile import timing_table
from tableprep.plans.cleaning import CleanConfig, CleanResult, StepClock, clean
from tableprep.plans.report import report
from tableprep.sources.tables import read_table, stage_table, staging, write_table

COLUMNAR = ("parquet", "orc")


def run(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    keys: str | Sequence[str],
    config: CleanConfig = CleanConfig(),
    in_format: str = "csv",
    out_format: str = "csv",
    schema: StructType | str | None = None,
    mode: str = "error",
    with_report: bool = True,
    order_by: Sequence[str] | None = None,
    **read_options: Any,
) -> CleanResult:
    """Write ``<out_path>/cleaned`` and ``<out_path>/report/<artefact>``.

    Text input is parsed once and staged as parquet, because cleaning reads
    its table several times. For the same reason the report reads the cleaned
    table as written: staged as parquet, from which a text output is made.
    What was staged is deleted when the job ends or fails; the result reads
    the output, and the input again for its typos. Its step counts come from
    the write.
    """
    clock = StepClock()
    with staging(spark):
        with clock.step("read"):
            source = original = read_table(spark, in_path, in_format, schema, **read_options)
            if in_format not in COLUMNAR:
                original = stage_table(original)
        result = clean(original, keys, config, order_by)
        with clock.step("write"):
            cleaned, step_counts = result.observed()
            columnar = out_format in COLUMNAR
            if columnar or not with_report:
                write_table(cleaned, f"{out_path}/cleaned", out_format, mode)
            else:
                cleaned = stage_table(cleaned)
                write_table(cleaned, f"{out_path}/cleaned", out_format, mode)
            counted = step_counts()
            written = read_table(spark, f"{out_path}/cleaned", out_format, cleaned.schema, multi_line=out_format == "csv")
        steps = [(r["step"], r["kind"], r["seconds"]) for r in result.timings.collect()]
        result.timings = timing_table(spark, [clock.timings[0], *steps, *clock.timings[1:]])
        if with_report:
            read_back = written if columnar else cleaned
            artefacts = report(original, result, read_back, quantile_method=config.quantile_method)
            for name, artefact in artefacts.items():
                write_table(artefact, f"{out_path}/report/{name}", out_format, mode)
    timings, result = result.timings, result.over(source)
    result.timings, result.cleaned, result.plan_step_counts = timings, written, lambda: counted
    return result
