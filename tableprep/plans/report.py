"""The quality report: the numbers behind each chart, as DataFrames.

The artefacts of a table first say what they need of it. One pass answers all
of that and a second one makes what depends on the answers: histograms and
densities of the cleaned table, whiskers of the original. Exact quantiles of
columns with more distinct values than a summary has room for take further
passes, which all quantiles share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.names import with_headers
from tableprep.operators.correlation import correlation_table
from tableprep.operators.distributions import Bins, Cells, approximate_quartiles, binned_and_smoothed, boxplot_stats
from tableprep.operators.profile import column_types
from tableprep.operators.schema import normalized_names, numeric_columns
from tableprep.operators.statistics import Requests
from tableprep.plans.cleaning import CleanResult
from tableprep.sources.tables import stage_table


def report(
    original: DataFrame,
    result: CleanResult,
    cleaned: DataFrame | None = None,
    bins: int | str = "auto",
    grid: int = 200,
    quantile_method: str = "exact",
) -> dict[str, DataFrame]:
    """All artefacts of a cleaning run, keyed by artefact name.

    The cleaned table is read twice, and each reading repeats its
    deduplication. Pass the table as written, in ``cleaned``, to avoid that.
    If any row of a key may survive, its numbers are written once, so that all
    artefacts are about the same rows.
    """
    # Where nothing could be cleaned, headers may still differ in case only.
    table = result.cleaned if cleaned is None else cleaned
    header_of = {f"c{i}": header for i, header in enumerate(table.columns)}
    numbers = set(numeric_columns(table, exclude=result.keys))
    measures = [plain for plain, header in header_of.items() if header in numbers]
    values = table.toDF(*header_of).select(*measures)
    if cleaned is None and not result.ordered and measures:
        values = stage_table(values)
    # The original has raw headers, the keys have normalised ones.
    raw_keys = {
        raw
        for raw, new in zip(original.columns, normalized_names(original.columns))
        if new in result.keys
    }
    asked = Requests(values)
    Bins.ask(asked, measures, bins, quantile_method == "exact")
    asked.pairs(measures)
    statistics = asked.answer()
    quartiles = approximate_quartiles(values, measures, quantile_method) if bins == "auto" and measures else None
    distributions, densities = binned_and_smoothed(
        values,
        Bins.of(statistics, measures, bins, quartiles),
        Cells.of(statistics, measures, grid, "scott"),
    )
    missing = F.try_divide(100.0 * F.col("n"), F.lit(result.metrics["rows"]))
    return {
        # Artefact names.
        "nonconforming_cells": result.nonconforming,
        "distributions_after_cleaning": with_headers(distributions, header_of),
        "densities_after_cleaning": with_headers(densities, header_of),
        "boxplots_before_cleaning": boxplot_stats(
            original, numeric_columns(original, exclude=raw_keys), quantile_method
        ),
        "process_times": result.timings,
        "missing_values_before_cleaning": result.nonconforming.select("column", missing.alias("missing_percent")),
        "correlation_heatmap": with_headers(correlation_table(values, measures, statistics), header_of),
        "column_schemas": column_types(table),
    }
