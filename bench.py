"""Times the headline queries and prints one JSON line.

Each query runs twice and the faster run counts, so that the numbers tell of
the query and not of the JVM warming up. Tables come from $BENCH_SF_DIR, cores from $BENCH_CPUS. ``per_column`` holds the
same work done the plain way, with one job per column, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep import catalog
from tableprep.functions import is_missing, normalize_text
from tableprep.operators import correlation, dedup, distributions, outliers, profile, typos
from tableprep.operators.schema import numeric_columns
from tableprep.plans.cleaning import clean
from tableprep.plans.report import report

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline(spark: SparkSession):
    lineitem, events = table(spark, "lineitem"), table(spark, "events")
    documents, part = table(spark, "documents"), table(spark, "part")
    customer = table(spark, "customer")
    order = list(catalog.LINEITEM_ORDER)
    return {
        "clean_events": lambda: clean(events, "event_id").cleaned,
        "clean_lineitem": lambda: clean(lineitem, "l_orderkey", order_by=order).cleaned,
        "nonconforming_cells": lambda: profile.nonconforming_cells(lineitem),
        "missing_percent": lambda: profile.missing_percent(lineitem),
        "normalize_text": lambda: documents.select(normalize_text(F.col("text"))),
        "typos_part": lambda: typos.find_typos(part),
        "typos_customer": lambda: typos.find_typos(customer),
        "quartiles_exact": lambda: outliers.quartiles(lineitem),
        "quartiles_approx": lambda: outliers.quartiles(lineitem, method="approx"),
        "outliers_joint_events": lambda: outliers.drop_outliers(events),
        "outliers_joint_lineitem": lambda: outliers.drop_outliers(lineitem),
        "outliers_sequential_events": lambda: outliers.drop_outliers(events, mode="sequential"),
        "dedup_any": lambda: catalog.dedup_any(spark, FOLDER),
        "dedup_first": lambda: catalog.dedup_first(spark, FOLDER),
        "dedup_unique": lambda: catalog.dedup_unique(spark, FOLDER),
        "dedup_few_copies": lambda: catalog.dedup_few_copies(spark, FOLDER),
        "dedup_shuffled": lambda: dedup.dedup_by_key(
            table(spark, "orders"), ["o_orderkey"], spare_unique=False
        ),
        "top_values_documents": lambda: typos.top_values(documents, ["text", "source"], 50),
        "typos_of_all_names": lambda: catalog.typo_values_of_all(spark, FOLDER),
        "report_events": lambda: whole_report(spark),
        "correlation": lambda: correlation.correlation(lineitem),
        "histogram": lambda: distributions.histogram(lineitem),
        "boxplot": lambda: distributions.boxplot_stats(lineitem),
        "correlation_40_columns": lambda: correlation.correlation(wide(lineitem)),
        "kde": lambda: distributions.kde(events, ["value"]),
        "kde_lineitem": lambda: distributions.kde(lineitem),
        "csv_roundtrip": lambda: catalog.csv_roundtrip(spark, FOLDER),
    }


def wide(lineitem: DataFrame) -> DataFrame:
    """Forty columns, some with holes."""
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    return lineitem.select(*[F.when(line % (i % 7 + 2) != 0, F.sin(price * (i + 1))).alias(f"x{i}") for i in range(40)])


def whole_report(spark: SparkSession) -> DataFrame:
    """All artefacts of a cleaning run; the last one is given back."""
    raw = table(spark, "events")
    *others, last = report(raw, clean(raw, "event_id", order_by=["event_id"])).values()
    for artefact in others:
        consume(artefact)
    return last


def per_column(spark: SparkSession):
    """One job per column and no shared passes."""
    lineitem = table(spark, "lineitem")

    def count_missing():
        for field in lineitem.schema:
            lineitem.where(is_missing(field)).count()

    def drop_outliers():
        df = lineitem
        for column in numeric_columns(lineitem):
            q1, q3 = df.select(F.percentile(column, [0.25, 0.75])).first()[0]
            spread = 1.5 * (q3 - q1)
            df = df.where(F.col(column).between(q1 - spread, q3 + spread))
            df.count()

    return {"nonconforming_cells": count_missing, "outliers_sequential_lineitem": drop_outliers}


def timed(run, times: int = 2) -> float:
    seconds = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tableprep bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    consume(table(spark, "nation").groupBy("n_regionkey").count())
    seconds, plain = {}, {}
    for name, build in headline(spark).items():
        seconds[name] = timed(lambda: consume(build()))
        print(name, seconds[name], file=sys.stderr, flush=True)
    for name, run in per_column(spark).items():
        plain[name] = timed(run)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "per_column": plain,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
