"""Queries over the test tables, each next to the SQL that gives its result.

The tables have no missing cells, so queries about those make some by rule,
in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions import normalize_text
from tableprep.operators import completeness, dedup, outliers, profile, schema, typos
from tableprep.operators.correlation import correlation
from tableprep.operators.distributions import boxplot_outliers, boxplot_stats, histogram, kde
from tableprep.plans.cleaning import CleanConfig, CleanResult, clean
from tableprep.plans.job import run
from tableprep.plans.report import report
from tableprep.sources import read_table, write_table
from tableprep.sources.tables import stage_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- inputs with missing cells ------------------------------------------------


def _holey_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 5 == 0, F.lit(float("nan")))
        .when(key % 6 != 1, F.col("o_totalprice"))
        .alias("o_totalprice"),
        F.when(key % 6 != 0, F.col("o_orderdate")).alias("o_orderdate"),
        F.when(key % 10 >= 7, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


HOLEY_ORDERS = """
holey AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE)
              WHEN o_orderkey % 6 <> 1 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS o_orderdate,
         CASE WHEN o_orderkey % 10 >= 7 THEN o_orderpriority END AS o_orderpriority
  FROM orders)
"""

HOLEY_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)


def _valid(column: str) -> str:
    return (
        f"({column} IS NOT NULL AND NOT isnan({column}))"
        if column == "o_totalprice"
        else f"({column} IS NOT NULL)"
    )


def _stacked(select: str) -> str:
    return f"WITH {HOLEY_ORDERS}" + " UNION ALL ".join(
        select.format(column=c, valid=_valid(c)) for c in HOLEY_COLUMNS
    )


VALID_CELLS = " + ".join(f"CAST({_valid(c)} AS INT)" for c in HOLEY_COLUMNS)


# A NULL and a NaN are told apart by what stands for them.
PRICE_SQL = """REPLACE (CASE WHEN o_totalprice IS NULL THEN -1.0 WHEN isnan(o_totalprice)
  THEN -2.0 ELSE o_totalprice END AS o_totalprice)"""


def _price(df: DataFrame) -> DataFrame:
    price = F.coalesce(F.nanvl("o_totalprice", F.lit(-2.0)), F.lit(-1.0))
    return df.withColumn("o_totalprice", price)


# -- shape and completeness ---------------------------------------------------


@query("""SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns, count(*) * 11 AS cells
          FROM lineitem""")
def table_shape(spark, sf_dir):
    return profile.shape(_table(spark, sf_dir, "lineitem"))


@query(
    _stacked(
        "SELECT '{column}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {valid}) AS valid,"
        " round(count(*) FILTER (WHERE {valid}) * 1.0 / count(*), 6) AS fill_ratio FROM holey"
    )
)
def fill_ratio(spark, sf_dir):
    return _rounded(completeness.fill_ratio(_holey_orders(spark, sf_dir)), "fill_ratio")


@query(
    _stacked(
        "SELECT '{column}' AS \"column\", count(*) FILTER (WHERE NOT {valid}) AS n FROM holey"
    )
)
def nonconforming_cells(spark, sf_dir):
    return profile.nonconforming_cells(_holey_orders(spark, sf_dir))


@query(
    _stacked(
        "SELECT '{column}' AS \"column\", round(100.0 * count(*) FILTER (WHERE NOT {valid})"
        " / count(*), 6) AS missing_percent FROM holey"
    )
)
def missing_percent(spark, sf_dir):
    return _rounded(profile.missing_percent(_holey_orders(spark, sf_dir)), "missing_percent")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n FROM embeddings"
        for c in ("vec_id", "embedding", "label")
    )
)
def nonconforming_nested(spark, sf_dir):
    return profile.nonconforming_cells(_table(spark, sf_dir, "embeddings"))


@query(
    f"""WITH {HOLEY_ORDERS}
    SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(CASE WHEN NOT isnan(o_totalprice)
           THEN o_totalprice END, -1.0) AS o_totalprice, o_orderdate FROM holey"""
)
def drop_sparse_columns(spark, sf_dir):
    kept = completeness.drop_sparse_columns(_holey_orders(spark, sf_dir))
    return kept.withColumn(
        "o_totalprice", F.coalesce(F.nanvl("o_totalprice", F.lit(-1.0)), F.lit(-1.0))
    )


@query(
    f"""WITH {HOLEY_ORDERS}
    SELECT * {PRICE_SQL} FROM holey WHERE {VALID_CELLS} >= 0.6 * 6"""
)
def drop_sparse_rows(spark, sf_dir):
    return _price(completeness.drop_sparse_rows(_holey_orders(spark, sf_dir), threshold=0.6))


@query(
    f"""WITH {HOLEY_ORDERS}
    SELECT * {PRICE_SQL} FROM holey WHERE {VALID_CELLS} >= CAST(floor(0.6 * 6) AS INT)"""
)
def drop_sparse_rows_floor(spark, sf_dir):
    return _price(
        completeness.drop_sparse_rows(
            _holey_orders(spark, sf_dir), threshold=0.6, rounding="floor"
        )
    )


@query(
    f"""WITH {HOLEY_ORDERS}
    SELECT * FROM holey WHERE {" AND ".join(_valid(c) for c in HOLEY_COLUMNS[:5])}"""
)
def drop_na_rows(spark, sf_dir):
    return completeness.drop_na_rows(_holey_orders(spark, sf_dir))


@query(
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END
       AS event_type, CASE WHEN props NOT IN ('error', 'view') THEN props END AS props
       FROM events"""
)
def null_tokens(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return completeness.null_tokens(events, ["error", "view"])


# -- schema -------------------------------------------------------------------


@query(
    """SELECT p_partkey AS p_partkey, p_name AS p_name_, p_brand AS brand, p_type AS brand_2,
              p_size AS col_5, p_retailprice AS retailprice_usd FROM part"""
)
def normalize_headers(spark, sf_dir):
    part = _table(spark, sf_dir, "part").toDF(
        "P PartKey".replace(" P", "_P"), "P Name (!)".replace(" (!)", " "), "Brand", "brand#",
        "###", "RetailPrice USD",
    )
    return schema.normalize_headers(part)


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
              l_discount, l_tax FROM lineitem"""
)
def numeric_columns(spark, sf_dir):
    lineitem = _table(spark, sf_dir, "lineitem")
    return lineitem.select(*schema.numeric_columns(lineitem))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS valid FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
)
def key_candidates(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    candidates = orders.select(*schema.key_candidates(orders))
    return completeness.fill_ratio(candidates).select("column", "rows", "valid")


@query(
    """SELECT type, CAST(columns AS BIGINT) AS columns, columns * n AS cells FROM
         (VALUES ('Long', 3), ('Integer', 1), ('Double', 4), ('String', 2), ('Timestamp_ntz', 1))
           AS t(type, columns),
         (SELECT count(*) AS n FROM lineitem)"""
)
def column_types(spark, sf_dir):
    lineitem = _table(spark, sf_dir, "lineitem")
    cells = (
        completeness.missing_counts(lineitem)
        .join(profile.type_names(lineitem), "column")
        .groupBy("type")
        .agg(F.sum("rows").alias("cells"))
    )
    return profile.column_types(lineitem).join(cells, "type")


NUMBER_TEXT = """
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(event_id AS VARCHAR) || 'd'
         WHEN 2 THEN ' ' || CAST(event_id AS VARCHAR) || '.5 ' WHEN 3 THEN '-1e3'
         ELSE CAST(event_id AS VARCHAR) END AS amount FROM events
"""


@query(
    f"""SELECT event_id, TRY_CAST(trim(amount) AS DOUBLE) AS amount FROM ({NUMBER_TEXT})"""
)
def coerce_numeric(spark, sf_dir):
    key = F.col("event_id")
    text = key.cast("string")
    amount = (
        F.when(key % 5 == 0, "n/a")
        .when(key % 5 == 1, F.concat(text, F.lit("d")))
        .when(key % 5 == 2, F.concat(F.lit(" "), text, F.lit(".5 ")))
        .when(key % 5 == 3, "-1e3")
        .otherwise(text)
    )
    events = _table(spark, sf_dir, "events").select("event_id", amount.alias("amount"))
    return schema.coerce_numeric(events, ["amount"])


@query(
    """SELECT o_orderkey, o_custkey, CAST(NULL AS DOUBLE) AS o_orderstatus, o_totalprice,
              o_orderdate, TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority FROM orders"""
)
def coerce_numeric_all(spark, sf_dir):
    """Every column of a table with a timestamp, which keeps its type."""
    return schema.coerce_numeric(_table(spark, sf_dir, "orders"))


# -- text and typos -----------------------------------------------------------


def _normalized_sql(column: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(trim(lower({column})), '\s+', ' ', 'g'),"
        r" '[^a-zA-Z0-9\s/:.-]', '', 'g')"
    )


@query(f"""SELECT doc_id, {_normalized_sql("text")} AS text FROM documents""")
def normalize_text_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(
        "doc_id", normalize_text(F.col("text")).alias("text")
    )


@query(f"""SELECT page_id, {_normalized_sql("html")} AS html FROM pages""")
def normalize_text_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(
        "page_id", normalize_text(F.col("html")).alias("html")
    )


@query(
    """SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part GROUP BY p_name
       UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
       UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand"""
)
def value_counts(spark, sf_dir):
    return typos.value_counts(_table(spark, sf_dir, "part"))


def _top_sql(table: str, column: str, top_n: int = 100) -> str:
    return f"""SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank
      FROM (SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL
            GROUP BY 1) ORDER BY n DESC, value LIMIT {top_n}"""


@query(
    f"""SELECT 'p_name' AS "column", * FROM ({_top_sql("part", "p_name", 20)})
        UNION ALL SELECT 'p_brand', * FROM ({_top_sql("part", "p_brand", 20)})"""
)
def top_values(spark, sf_dir):
    top = typos.top_values(_table(spark, sf_dir, "part"), ["p_name", "p_brand"], top_n=20)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""SELECT 'text' AS "column", n, rank, md5(value) AS digest FROM ({_top_sql("documents", "text", 50)})
        UNION ALL SELECT 'source', n, rank, md5(value) FROM ({_top_sql("documents", "source", 50)})
        UNION ALL SELECT 'lang', n, rank, md5(value) FROM ({_top_sql("documents", "lang", 50)})"""
)
def top_values_documents(spark, sf_dir):
    """Free text, whose frequent values are found without shuffling it; ties at the last rank."""
    top = typos.top_values(_table(spark, sf_dir, "documents"), ["text", "source", "lang"], top_n=50)
    return top.select("column", "n", F.col("rank").cast("bigint").alias("rank"), F.md5("value").alias("digest"))


def _typo_values_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", v.value, v.n,
        string_agg(t.value, '|' ORDER BY t.rank) AS possible_typos
      FROM (SELECT {column} AS value, count(*) AS n FROM {table} GROUP BY 1) v
      JOIN ({_top_sql(table, column)}) t
        ON v.value <> t.value AND levenshtein(v.value, t.value) <= 2
      GROUP BY v.value, v.n"""


def _joined_typos(df: DataFrame) -> DataFrame:
    return df.withColumn("possible_typos", F.array_join("possible_typos", "|"))


@query(
    f"""{_typo_values_sql("customer", "c_name")} UNION ALL
        {_typo_values_sql("customer", "c_mktsegment")}"""
)
def typo_values(spark, sf_dir):
    return _joined_typos(typos.typo_values(_table(spark, sf_dir, "customer")))


@query(_typo_values_sql("customer", "c_name"))
def typo_values_joined(spark, sf_dir):
    """The way for values beyond the byte bound, here for all of them."""
    customer = _table(spark, sf_dir, "customer")
    return _joined_typos(typos.typo_values(customer, ["c_name"], array_bytes=0))


@query(_typo_values_sql("customer", "c_name"))
def typo_values_segments(spark, sf_dir):
    """By the index of long values, here for all of them."""
    customer = _table(spark, sf_dir, "customer")
    return _joined_typos(typos.typo_values(customer, ["c_name"], most_deletions=0))


@query(
    f"""SELECT v.value, v.n, count(*) AS close, max(t.value) AS last
      FROM (SELECT c_name AS value, count(*) AS n FROM customer GROUP BY 1) v
      JOIN ({_top_sql("customer", "c_name", 100_000)}) t
        ON v.value <> t.value AND levenshtein(v.value, t.value) <= 1
      GROUP BY v.value, v.n"""
)
def typo_values_of_all(spark, sf_dir):
    """Every name against every name, by the index."""
    found = typos.typo_values(_table(spark, sf_dir, "customer"), ["c_name"], threshold=1, top_n=100_000)
    return found.select(
        "value", "n", F.size("possible_typos").cast("bigint").alias("close"), F.array_max("possible_typos").alias("last")
    )


@query(
    f"""SELECT f."column", f.value, f.possible_typos FROM ({_typo_values_sql("part", "p_name")}) f
        JOIN part ON p_name = f.value"""
)
def typo_rows(spark, sf_dir):
    return _joined_typos(typos.find_typos(_table(spark, sf_dir, "part"), ["p_name"]))


@query(
    f"""SELECT "column", count(*) AS flagged_values, CAST(sum(n) AS BIGINT) AS flagged_rows
        FROM ({_typo_values_sql("part", "p_name")} UNION ALL {_typo_values_sql("part", "p_type")}
              UNION ALL {_typo_values_sql("part", "p_brand")}) GROUP BY 1"""
)
def typo_summary(spark, sf_dir):
    return typos.typo_summary(_table(spark, sf_dir, "part"))


@query(
    f"""SELECT count(*) AS rows, bool_and(flagged) AS flagged FROM (
      SELECT true AS flagged FROM ({_typo_values_sql("part", "p_name")}) f JOIN part ON p_name = f.value LIMIT 10)"""
)
def typo_preview(spark, sf_dir):
    """Ten rows, any; each has to be one of the flagged cells."""
    part = _table(spark, sf_dir, "part")
    whole = _joined_typos(typos.typo_values(part, ["p_name"])).select("column", "value", "possible_typos")
    preview = _joined_typos(typos.find_typos(part, ["p_name"], limit=10))
    known = preview.join(whole.withColumn("known", F.lit(True)), ["column", "value", "possible_typos"], "left")
    return known.agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.coalesce("known", F.lit(False))).alias("flagged")
    )


@query(
    r"""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(
          event_type || chr(160) || ' &  ' || chr(8195) || props), chr(160) || chr(8195) || ' '),
          '[\s' || chr(160) || chr(8195) || ']+', ' ', 'g'), '[^a-zA-Z0-9\s/:.-]', '', 'g'), '\s+', ' ', 'g')) AS text
        FROM events"""
)
def normalize_text_options(spark, sf_dir):
    """Unicode blanks collapse, and once more after special characters are gone."""
    blanks = F.lit(f"{chr(160)} &  {chr(8195)}")
    text = F.concat("event_type", blanks, "props")
    return _table(spark, sf_dir, "events").select(
        "event_id", normalize_text(text, unicode_ws=True, squeeze_after=True).alias("text")
    )


@query(
    f"""WITH {HOLEY_ORDERS}
    SELECT '{"o_totalprice"}' AS "column", count(*) AS rows, count(*) - count(o_totalprice) AS missing FROM holey
    UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey) FROM holey"""
)
def missing_without_nan(spark, sf_dir):
    """A NaN counts as a value."""
    holey = _holey_orders(spark, sf_dir).select("o_totalprice", "o_custkey")
    return completeness.missing_counts(holey, nan_is_missing=False)


# -- quantiles and outliers ---------------------------------------------------

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


def _quartiles_sql(table: str, column: str, function: str = "quantile_cont") -> str:
    return f"""SELECT '{column}' AS "column", {function}({column}, 0.25) AS q1,
               {function}({column}, 0.75) AS q3 FROM {table}"""


def _rounded_quartiles_sql(table: str, columns, function: str = "quantile_cont") -> str:
    stacked = " UNION ALL ".join(
        _quartiles_sql(table, f"CAST({c} AS DOUBLE)", function).replace(
            f"'CAST({c} AS DOUBLE)'", f"'{c}'"
        )
        for c in columns
    )
    return f'SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3 FROM ({stacked})'


@query(_rounded_quartiles_sql("lineitem", LINEITEM_NUMBERS))
def quartiles_exact(spark, sf_dir):
    return _rounded(outliers.quartiles(_table(spark, sf_dir, "lineitem")), "q1", "q3")


@query(_rounded_quartiles_sql("lineitem", LINEITEM_NUMBERS))
def quartiles_narrowed(spark, sf_dir):
    """The way for columns with more distinct values than a summary has room for."""
    lineitem = _table(spark, sf_dir, "lineitem")
    return _rounded(outliers.quartiles(lineitem, room=100), "q1", "q3")


@query(_rounded_quartiles_sql("documents", ["doc_id", "n_chars"], "quantile_disc"))
def quartiles_approx(spark, sf_dir):
    """With an accuracy above the row count the sketch is the exact nearest rank."""
    documents = _table(spark, sf_dir, "documents")
    return outliers.quartiles(documents, method="approx", accuracy=10_000_000)


@query(
    """SELECT 'l_extendedprice' AS "column", count(l_extendedprice) AS n, true AS near FROM lineitem
       UNION ALL SELECT 'l_orderkey', count(l_orderkey), true FROM lineitem"""
)
def quartiles_sketched(spark, sf_dir):
    """A table larger than the sketch: ranks within the stated error of a quarter and three quarters."""
    lineitem = _table(spark, sf_dir, "lineitem")
    columns, accuracy = ["l_extendedprice", "l_orderkey"], 500
    found = outliers.quartiles(lineitem, columns, method="approx", accuracy=accuracy)
    one = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns)))
    ranked = (
        lineitem.select(one)
        .join(F.broadcast(found), "column")  # a row a column; by column, all rows would meet in as many tasks
        .groupBy("column", "q1", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(F.count_if(F.col("x") < F.col(q)).alias(f"below_{q}") for q in ("q1", "q3")),
            *(F.count_if(F.col("x") <= F.col(q)).alias(f"upto_{q}") for q in ("q1", "q3")),
        )
    )
    error = 2 * F.col("n") / accuracy
    tests = [
        (F.col(f"below_{q}") <= share * F.col("n") + error) & (F.col(f"upto_{q}") >= share * F.col("n") - error)
        for q, share in (("q1", 0.25), ("q3", 0.75))
    ]
    return ranked.select("column", "n", (tests[0] & tests[1]).alias("near"))


@query(
    f"""SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
           round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
        FROM ({_quartiles_sql("events", "value")} UNION ALL {_quartiles_sql("events", "user_id")})"""
)
def iqr_bounds(spark, sf_dir):
    found = outliers.bounds(_table(spark, sf_dir, "events"), ["value", "user_id"])
    return _rounded(found, "q1", "q3", "lower", "upper")


def _inside_sql(source: str, column: str) -> str:
    """Rows of ``source`` inside the fences that ``source`` itself gives."""
    return f"""SELECT s.* FROM {source} s, (
        SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3
        FROM {source}) q
      WHERE s.{column} >= q1 - 1.5 * (q3 - q1) AND s.{column} <= q3 + 1.5 * (q3 - q1)"""


@query(
    f"""SELECT a.* FROM ({_inside_sql("labels", "quality")}) a
        JOIN ({_inside_sql("labels", "toxic")}) b USING (doc_id)"""
)
def outliers_joint(spark, sf_dir):
    return outliers.drop_outliers(_table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query(f"""SELECT doc_id, n_chars FROM ({_inside_sql("documents", "n_chars")})""")
def outliers_documents(spark, sf_dir):
    return outliers.drop_outliers(_table(spark, sf_dir, "documents"), ["n_chars"]).select(
        "doc_id", "n_chars"
    )


@query(
    f"""WITH squared AS (SELECT event_id, value, value * value AS value_sq FROM events),
        first AS ({_inside_sql("squared", "value")})
        SELECT event_id, value, round(value_sq, 6) AS value_sq
        FROM ({_inside_sql("first", "value_sq")})"""
)
def outliers_sequential(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(
        "event_id", "value", (F.col("value") * F.col("value")).alias("value_sq")
    )
    kept = outliers.drop_outliers(events, ["value", "value_sq"], mode="sequential")
    return _rounded(kept, "value_sq")


# -- deduplication ------------------------------------------------------------


@query("""SELECT DISTINCT l_orderkey FROM lineitem""")
def dedup_any(spark, sf_dir):
    """Any row may survive, so only the key is compared."""
    return dedup.dedup_by_key(_table(spark, sf_dir, "lineitem"), ["l_orderkey"]).select(
        "l_orderkey"
    )


@query("""SELECT * FROM orders""")
def dedup_unique(spark, sf_dir):
    """Whole rows of a table whose key is unique: nothing is shuffled."""
    return dedup.dedup_by_key(_table(spark, sf_dir, "orders"), ["o_orderkey"])


@query("""SELECT * FROM orders""")
def dedup_few_copies(spark, sf_dir):
    """Some orders stand two or three times, as the same rows; only those are shuffled."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    copies = F.explode(F.sequence(F.lit(1), F.when(key % 70 == 0, 3).when(key % 50 == 0, 2).otherwise(1)))
    return dedup.dedup_by_key(orders.select("*", copies.alias("copy")).drop("copy"), ["o_orderkey", "o_custkey"])


LINEITEM_ORDER = (
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


@query(
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
          PARTITION BY l_orderkey ORDER BY {", ".join(LINEITEM_ORDER)}) AS rn FROM lineitem)
        WHERE rn = 1"""
)
def dedup_first(spark, sf_dir):
    return dedup.dedup_by_key(
        _table(spark, sf_dir, "lineitem"), ["l_orderkey"], order_by=LINEITEM_ORDER
    )


@query(
    """SELECT * EXCLUDE (rn) FROM (SELECT conv_id, role, turn, row_number() OVER (
          PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"""
)
def dedup_last_by_two_keys(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return dedup.dedup_by_key(conversations, ["conv_id", "role"], order_by=[F.desc("turn")])


# -- distributions ------------------------------------------------------------

CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant")

CORRELATION_INPUT = """
  SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice,
         CASE WHEN l_linenumber % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END
           AS l_discount, l_tax, 1.0::DOUBLE AS constant FROM lineitem
"""


def _correlation_sql() -> str:
    def masked(x, y):
        # NaN is missing, and both values must be present.
        return f"CASE WHEN NOT isnan({x}) AND NOT isnan({y}) THEN {x} END"

    pairs = []
    for x in CORRELATED:
        for y in CORRELATED:
            value = f"corr({masked(x, y)}, {masked(y, x)})"
            if "constant" in (x, y):
                value = "max(CAST(NULL AS DOUBLE))"
            pairs.append(f"SELECT '{x}' AS col_x, '{y}' AS col_y, round({value}, 6) AS corr FROM c")
    return f"WITH c AS ({CORRELATION_INPUT}) " + " UNION ALL ".join(pairs)


@query(_correlation_sql())
def correlation_matrix(spark, sf_dir):
    line = F.col("l_linenumber")
    lineitem = _table(spark, sf_dir, "lineitem").select(
        F.when(line % 3 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(line % 5 == 0, float("nan")).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.lit(1.0).alias("constant"),
    )
    return _rounded(correlation(lineitem), "corr")


WIDE = {
    "quantity": "CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END",
    "price": "l_extendedprice",
    "tax": "CASE WHEN l_linenumber % 4 <> 1 THEN l_tax END",
    "discount": "l_discount",
    "tiny": "l_quantity * CAST(1e-9 AS DOUBLE)",
    "tinier": "CASE WHEN l_linenumber % 5 <> 2 THEN l_extendedprice * CAST(1e-12 AS DOUBLE) END",
    "large": "l_extendedprice * CAST(1e9 AS DOUBLE)",
    "line": "CAST(l_linenumber AS DOUBLE)",
    "part": "CAST(l_partkey AS DOUBLE)",
    "supplier": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS DOUBLE) END",
    "order": "CAST(l_orderkey AS DOUBLE)",
    "constant": "CASE WHEN l_linenumber % 6 <> 0 THEN CAST(0.1 AS DOUBLE) END",
    "empty": "CAST(NULL AS DOUBLE)",
}


def _wide_sql() -> str:
    def value(x, y):
        a, b = (f"({WIDE[c]})" for c in (x, y))
        if {"constant", "empty"} & {x, y}:
            return "max(CAST(NULL AS DOUBLE))"
        return f"corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END)"

    return " UNION ALL ".join(
        f"SELECT '{x}' AS col_x, '{y}' AS col_y, round({value(x, y)}, 6) AS corr FROM lineitem"
        for x in WIDE
        for y in WIDE
    )


@query(_wide_sql())
def correlation_wide(spark, sf_dir):
    """Thirteen columns with holes, a constant one, one without values, and very small scales."""
    expressions = [f"{sql} AS `{name}`" for name, sql in WIDE.items()]
    return _rounded(correlation(_table(spark, sf_dir, "lineitem").selectExpr(*expressions)), "corr")


def _boxplot_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(x) AS n, min(x) AS min,
        least(min(x) FILTER (WHERE x >= lo), any_value(q1)) AS whisker_low, any_value(q1) AS q1,
        any_value(q2) AS median, any_value(q3) AS q3,
        greatest(max(x) FILTER (WHERE x <= hi), any_value(q3)) AS whisker_high, max(x) AS max,
        count(*) FILTER (WHERE x < lo OR x > hi) AS outliers
      FROM (SELECT CAST({column} AS DOUBLE) AS x, q1, q2, q3, q1 - 1.5 * (q3 - q1) AS lo,
                   q3 + 1.5 * (q3 - q1) AS hi
            FROM {table}, (SELECT quantile_cont({column}, 0.25) AS q1,
                 quantile_cont({column}, 0.5) AS q2, quantile_cont({column}, 0.75) AS q3
                 FROM {table}))"""


BOX_NUMBERS = ("min", "whisker_low", "q1", "median", "q3", "whisker_high", "max")


def _rounded_boxplot_sql(table: str, columns) -> str:
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in BOX_NUMBERS)
    stacked = " UNION ALL ".join(_boxplot_sql(table, c) for c in columns)
    return f'SELECT "column", n, {rounded}, outliers FROM ({stacked})'


@query(_rounded_boxplot_sql("events", ["value", "user_id"]))
def boxplot_events(spark, sf_dir):
    return _rounded(
        boxplot_stats(_table(spark, sf_dir, "events"), ["value", "user_id"]), *BOX_NUMBERS
    )


@query(_rounded_boxplot_sql("documents", ["n_chars"]))
def boxplot_documents(spark, sf_dir):
    return _rounded(boxplot_stats(_table(spark, sf_dir, "documents"), ["n_chars"]), *BOX_NUMBERS)


@query(
    """SELECT 'value' AS "column", value FROM events, (
         SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
)
def boxplot_points(spark, sf_dir):
    return boxplot_outliers(_table(spark, sf_dir, "events"), ["value"])


def _histogram_sql(table: str, column: str, bins: str) -> str:
    """``bins`` is SQL over the statistics n, lo, hi, q1 and q3."""
    return f"""
      SELECT '{column}' AS "column", bin, round(lo + (bin - 1) * w, 6) AS lower,
             round(CASE WHEN bin = bins THEN hi ELSE lo + bin * w END, 6) AS upper, count(*) AS n
      FROM (SELECT CAST(least(floor((x - lo) / w), bins - 1) + 1 AS BIGINT) AS bin, lo, hi, w, bins
            FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {table}), (
              SELECT *, (hi - lo) / bins AS w FROM (
                SELECT *, {bins} AS bins FROM (
                  SELECT count(*) AS n, CAST(min({column}) AS DOUBLE) AS lo,
                         CAST(max({column}) AS DOUBLE) AS hi, quantile_cont({column}, 0.25) AS q1,
                         quantile_cont({column}, 0.75) AS q3 FROM {table}))))
      GROUP BY bin, lo, hi, w, bins"""


AUTO_BINS = """CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1),
               2 * (q3 - q1) / pow(n, 1.0 / 3))) AS BIGINT)"""


@query(
    _histogram_sql("lineitem", "l_quantity", "CAST(30 AS BIGINT)")
    + " UNION ALL "
    + _histogram_sql("lineitem", "l_extendedprice", "CAST(30 AS BIGINT)")
)
def histogram_lineitem(spark, sf_dir):
    lineitem = _table(spark, sf_dir, "lineitem")
    counted = histogram(lineitem, ["l_quantity", "l_extendedprice"], bins=30)
    return _rounded(counted, "lower", "upper")


@query(_histogram_sql("events", "value", AUTO_BINS))
def histogram_auto(spark, sf_dir):
    return _rounded(histogram(_table(spark, sf_dir, "events"), ["value"]), "lower", "upper")


def _kde_sql(table: str, column: str, points: int, digits: int = 9) -> str:
    return f"""SELECT '{column}' AS "column", round(g.x, {min(6, digits - 3)}) AS x,
        round(sum(exp(-0.5 * ((t.{column} - g.x) / h) * ((t.{column} - g.x) / h)))
              / (any_value(n) * any_value(h) * sqrt(2 * pi())), {digits}) AS density
      FROM (SELECT lo + i * ((hi - lo) / {points - 1}) AS x, n, sd * pow(n, -1.0 / 5) AS h
            FROM (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi,
                         count(*) AS n, stddev_samp({column}) AS sd FROM {table}),
                 range({points}) r(i)) g, {table} t
      GROUP BY g.x"""


@query(_kde_sql("events", "value", 50))
def kde_events(spark, sf_dir):
    return _rounded(_rounded(kde(_table(spark, sf_dir, "events"), ["value"], 50), "x"),
                    "density", digits=9)


@query(_kde_sql("lineitem", "l_quantity", 50))
def kde_few_values(spark, sf_dir):
    """A column of few distinct values, which are counted first."""
    density = kde(_table(spark, sf_dir, "lineitem"), ["l_quantity"], 50)
    return _rounded(_rounded(density, "x"), "density", digits=9)


# -- the full cleaning run ----------------------------------------------------


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    empty = key % 50 == 0
    value = F.when(~empty & (key % 11 != 0), F.col("value"))
    return _table(spark, sf_dir, "events").select(
        key.alias("Event ID"),
        F.when(~empty, F.col("ts")).alias("TS"),
        F.col("user_id").alias("User ID"),
        F.when(~empty, F.concat(F.lit("  "), F.upper("event_type"), F.lit("!"))).alias(
            "Event Type"
        ),
        F.when(key % 13 == 0, float("nan")).otherwise(value).alias("value ($)"),
        (value * value).alias("value_sq"),
        F.when(~empty, F.col("props")).alias("props.json"),
        F.when(key % 10 == 0, F.lit("x")).alias("Note"),
    )


RAW_EVENTS = """
raw AS (
  SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts, user_id,
         CASE WHEN event_id % 50 <> 0 THEN '  ' || upper(event_type) || '!' END AS event_type,
         CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE)
              WHEN event_id % 50 <> 0 AND event_id % 11 <> 0 THEN value END AS value_,
         CASE WHEN event_id % 50 <> 0 AND event_id % 11 <> 0 THEN value * value END AS value_sq,
         CASE WHEN event_id % 50 <> 0 THEN props END AS propsjson
  FROM events),
"""


def _clean_events_sql(measures: tuple[str, ...] = ("event_id", "value_", "value_sq")) -> str:
    """``f3`` is the table inside the fences of the measures, ``deduped`` one row of it per user."""
    valid = [
        f"({c} IS NOT NULL{' AND NOT isnan(' + c + ')' if c == 'value_' else ''})"
        for c in ("event_id", "ts", "user_id", "event_type", "value_", "value_sq", "propsjson")
    ]
    return f"""WITH {RAW_EVENTS}
      sparse AS (SELECT * FROM raw
        WHERE {" + ".join(f"CAST({v} AS INT)" for v in valid)} >= 0.5 * 7),
      solid AS (SELECT * FROM sparse WHERE {" AND ".join(valid)}),
      texted AS (SELECT event_id, ts, user_id, {_normalized_sql("event_type")} AS event_type,
                        value_, value_sq, {_normalized_sql("propsjson")} AS propsjson FROM solid),
      f1 AS ({_inside_sql("texted", measures[0])}),
      f2 AS ({_inside_sql("f1", measures[1])}),
      f3 AS ({_inside_sql("f2", measures[2])}),
      deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY event_id) AS rn FROM f3) WHERE rn = 1)"""


def _clean_events(spark: SparkSession, sf_dir: str, **settings) -> CleanResult:
    return clean(
        _raw_events(spark, sf_dir), "User ID", CleanConfig(**settings), order_by=["Event ID"]
    )


@query(f"{_clean_events_sql()} SELECT * REPLACE (round(value_sq, 6) AS value_sq) FROM deduped")
def clean_events(spark, sf_dir):
    return _rounded(_clean_events(spark, sf_dir).cleaned, "value_sq")


@query(f"{_clean_events_sql()} SELECT * REPLACE (round(value_sq, 6) AS value_sq) FROM deduped")
def clean_events_narrowed(spark, sf_dir):
    """The same run with quantiles found the way large columns need."""
    return _rounded(_clean_events(spark, sf_dir, quantile_room=100).cleaned, "value_sq")


@query(
    f"""{_clean_events_sql(("user_id", "value_", "value_sq"))}
    SELECT * REPLACE (round(value_sq, 6) AS value_sq) FROM f3"""
)
def clean_unique_key(spark, sf_dir):
    """The cleaning run by a key that is unique, spared the shuffle."""
    result = clean(_raw_events(spark, sf_dir), "Event ID", CleanConfig(spare_unique=True))
    return _rounded(result.cleaned, "value_sq")


STEP_SOURCES = (
    ("initial", "raw", 8),
    ("drop sparse columns", "raw", 7),
    ("drop sparse rows", "sparse", 7),
    ("drop rows with missing values", "solid", 7),
    ("clean columns", "texted", 7),
    ("drop outliers", "f3", 7),
    ("drop duplicates", "deduped", 7),
)


@query(
    f"{_clean_events_sql()} "
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step_no, '{step}' AS step, count(*) AS rows,"
        f" CAST({width} AS BIGINT) AS columns,"
        f" count(*) * {width} AS cells FROM {source}"
        for i, (step, source, width) in enumerate(STEP_SOURCES)
    )
)
def clean_step_counts(spark, sf_dir):
    return _clean_events(spark, sf_dir).step_counts


@query(
    f"""{_clean_events_sql()} SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM deduped)
        AS removed_rows, CAST(1 AS BIGINT) AS removed_columns"""
)
def clean_removed(spark, sf_dir):
    return _clean_events(spark, sf_dir).removed


@query(
    f"""{_clean_events_sql()}, n AS (SELECT count(*) AS n FROM raw)
    SELECT 'Event ID' AS "column", count(*) - count(event_id) AS n FROM raw
    UNION ALL SELECT 'TS', count(*) - count(ts) FROM raw
    UNION ALL SELECT 'User ID', count(*) - count(user_id) FROM raw
    UNION ALL SELECT 'Event Type', count(*) - count(event_type) FROM raw
    UNION ALL SELECT 'value ($)', count(*) FILTER (WHERE value_ IS NULL OR isnan(value_)) FROM raw
    UNION ALL SELECT 'value_sq', count(*) - count(value_sq) FROM raw
    UNION ALL SELECT 'props.json', count(*) - count(propsjson) FROM raw
    UNION ALL SELECT 'Note', count(*) FILTER (WHERE event_id % 10 <> 0) FROM events"""
)
def clean_nonconforming(spark, sf_dir):
    return _clean_events(spark, sf_dir).nonconforming


@query(
    """SELECT * FROM (VALUES ('main', true, true), ('column', true, true), ('total', true, true))
       t(kind, measured, in_minutes)"""
)
def clean_timings(spark, sf_dir):
    """What holds of the timings in every run."""
    return profile.timing_summary(_clean_events(spark, sf_dir).timings).select(
        "kind",
        (F.col("seconds") >= 0).alias("measured"),
        (F.abs(F.col("minutes") * 60 - F.col("seconds")) < 1e-9).alias("in_minutes"),
    )


def _clean_lineitem_sql() -> str:
    steps, source = [], "lineitem"
    for column in LINEITEM_NUMBERS[1:]:
        steps.append(f"by_{column} AS ({_inside_sql(source, column)})")
        source = f"by_{column}"
    text = ", ".join(f"{_normalized_sql(c)} AS {c}" for c in ("l_returnflag", "l_linestatus"))
    return f"""WITH {", ".join(steps)}
      SELECT * EXCLUDE (rn) REPLACE ({text}) FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey ORDER BY {", ".join(LINEITEM_ORDER)}) AS rn FROM {source})
      WHERE rn = 1"""


@query(_clean_lineitem_sql())
def clean_lineitem(spark, sf_dir):
    lineitem = _table(spark, sf_dir, "lineitem")
    return clean(lineitem, "l_orderkey", order_by=LINEITEM_ORDER).cleaned


@query(
    f"""{_clean_events_sql()}, pairs AS (
      SELECT 'event_id' AS col_x, 'value_' AS col_y, corr(event_id, value_) AS corr FROM deduped
      UNION ALL SELECT 'event_id', 'value_sq', corr(event_id, value_sq) FROM deduped
      UNION ALL SELECT 'value_', 'value_sq', corr(value_, value_sq) FROM deduped)
    SELECT col_x, col_y, round(corr, 6) AS corr FROM pairs
    UNION ALL SELECT col_y, col_x, round(corr, 6) FROM pairs
    UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES ('event_id'), ('value_'), ('value_sq')) t(c)"""
)
def report_correlation(spark, sf_dir):
    """One artefact of the report: the correlations of the cleaned table."""
    raw = _raw_events(spark, sf_dir)
    result = clean(raw, "User ID", order_by=["Event ID"])
    return _rounded(report(raw, result)["correlation_heatmap"], "corr")


@query(
    """SELECT 'Value' AS "column", count(*) AS n, min(value) AS min, max(value) AS max FROM events
       UNION ALL SELECT 'value', count(*), min(-value), max(-value) FROM events
       UNION ALL SELECT 'a.b', count(*), min(2 * value), max(2 * value) FROM events"""
)
def report_raw_headers(spark, sf_dir):
    """Boxplots of the original, whose headers differ in case only or hold a dot."""
    value = F.col("value")
    raw = _table(spark, sf_dir, "events").select("event_id", value.alias("Value"))
    raw = raw.select("event_id", "Value", (-value).alias("v"), (2 * value).alias("w"))
    raw = raw.toDF("event_id", "Value", "value", "a.b")
    artefacts = report(raw, clean(raw, "event_id"))
    return artefacts["boxplots_before_cleaning"].select("column", "n", "min", "max")


def _artefact(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    raw = _raw_events(spark, sf_dir)
    return report(raw, clean(raw, "User ID", order_by=["Event ID"]), **options)[name]


CLEANED_NUMBERS = ("event_id", "value_", "value_sq")


@query(
    _clean_events_sql()
    + " UNION ALL ".join(_histogram_sql("deduped", c, AUTO_BINS) for c in CLEANED_NUMBERS)
)
def report_distributions(spark, sf_dir):
    """Every bin of the cleaned table's histograms."""
    return _rounded(_artefact(spark, sf_dir, "distributions_after_cleaning"), "lower", "upper")


@query(_clean_events_sql() + " UNION ALL ".join(_kde_sql("deduped", c, 40, 7) for c in CLEANED_NUMBERS))
def report_densities(spark, sf_dir):
    density = _artefact(spark, sf_dir, "densities_after_cleaning", grid=40)
    return _rounded(_rounded(density, "x", digits=4), "density", digits=7)


RAW_NUMBERS = {"Event ID": "event_id", "value ($)": "value_", "value_sq": "value_sq"}


@query(
    f"""WITH {RAW_EVENTS} numbers AS (
      SELECT event_id, CASE WHEN NOT isnan(value_) THEN value_ END AS value_, value_sq FROM raw)
    """
    + " UNION ALL ".join(
        _rounded_boxplot_sql("numbers", [c]).replace(f"'{c}' AS", f"'{raw}' AS") for raw, c in RAW_NUMBERS.items()
    )
)
def report_boxplots(spark, sf_dir):
    """Boxplots of the original under its raw headers."""
    return _rounded(_artefact(spark, sf_dir, "boxplots_before_cleaning"), *BOX_NUMBERS)


@query(
    f"""WITH {RAW_EVENTS} n AS (SELECT count(*) AS n FROM raw)
    SELECT "column", round(100.0 * missing / n, 6) AS missing_percent FROM n, (
      SELECT 'Event ID' AS "column", count(*) - count(event_id) AS missing FROM raw
      UNION ALL SELECT 'TS', count(*) - count(ts) FROM raw
      UNION ALL SELECT 'User ID', count(*) - count(user_id) FROM raw
      UNION ALL SELECT 'Event Type', count(*) - count(event_type) FROM raw
      UNION ALL SELECT 'value ($)', count(*) FILTER (WHERE value_ IS NULL OR isnan(value_)) FROM raw
      UNION ALL SELECT 'value_sq', count(*) - count(value_sq) FROM raw
      UNION ALL SELECT 'props.json', count(*) - count(propsjson) FROM raw
      UNION ALL SELECT 'Note', count(*) FILTER (WHERE event_id % 10 <> 0) FROM events)"""
)
def report_missing_percent(spark, sf_dir):
    return _rounded(_artefact(spark, sf_dir, "missing_values_before_cleaning"), "missing_percent")


@query(
    f"""WITH {RAW_EVENTS} n AS (SELECT count(*) AS n FROM raw)
    SELECT 'Event ID' AS "column", count(*) - count(event_id) AS n FROM raw
    UNION ALL SELECT 'TS', count(*) - count(ts) FROM raw
    UNION ALL SELECT 'User ID', count(*) - count(user_id) FROM raw
    UNION ALL SELECT 'Event Type', count(*) - count(event_type) FROM raw
    UNION ALL SELECT 'value ($)', count(*) FILTER (WHERE value_ IS NULL OR isnan(value_)) FROM raw
    UNION ALL SELECT 'value_sq', count(*) - count(value_sq) FROM raw
    UNION ALL SELECT 'props.json', count(*) - count(propsjson) FROM raw
    UNION ALL SELECT 'Note', count(*) FILTER (WHERE event_id % 10 <> 0) FROM events"""
)
def report_nonconforming(spark, sf_dir):
    return _artefact(spark, sf_dir, "nonconforming_cells")


@query(
    f"""{_clean_events_sql()}
    SELECT replace(t, '_ntz', '') AS type, count(*) AS columns, max(n) AS rows FROM (
      SELECT unnest(['Long', 'Timestamp_ntz', 'Long', 'String', 'Double', 'Double', 'String']) AS t), (
      SELECT count(*) AS n FROM deduped) GROUP BY 1"""
)
def report_column_schemas(spark, sf_dir):
    """Types of the cleaned table's columns, next to its rows."""
    types = _artefact(spark, sf_dir, "column_schemas")
    rows = _clean_events(spark, sf_dir).cleaned.agg(F.count(F.lit(1)).alias("rows"))
    return types.select(F.regexp_replace("type", "_ntz", "").alias("type"), "columns").join(rows)


@query(
    """SELECT step, kind, measured FROM (VALUES
         ('normalize headers', 'main'), ('count cells', 'main'), ('drop sparse columns', 'main'),
         ('drop sparse rows', 'main'), ('drop rows with missing values', 'main'), ('clean column event_type', 'column'),
         ('clean column propsjson', 'column'), ('drop outliers', 'main'), ('drop duplicates', 'main')) t(step, kind),
       (SELECT count(*) > 0 AS measured FROM events)"""
)
def report_process_times(spark, sf_dir):
    """Every step has its time."""
    times = _artefact(spark, sf_dir, "process_times")
    return times.select("step", "kind", ((F.col("seconds") >= 0) & (F.col("minutes") >= 0)).alias("measured"))


# -- sources and sinks --------------------------------------------------------


@query(
    """SELECT * REPLACE (CAST(o_orderkey AS INT) AS o_orderkey,
              CAST(o_custkey AS INT) AS o_custkey) FROM orders"""
)
def csv_roundtrip(spark, sf_dir):
    """Written as CSV, read back with inferred types."""
    path = stage_path(spark)
    write_table(_table(spark, sf_dir, "orders"), path)
    back = read_table(spark, path)
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    f"""WITH {HOLEY_ORDERS} SELECT CAST(o_orderkey AS INT) AS o_orderkey,
        CAST(o_custkey AS INT) AS o_custkey, lower(o_orderstatus) AS o_orderstatus
        FROM holey WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL"""
)
def run_job(spark, sf_dir):
    """The batch job from CSV to CSV, its cleaned table read back."""
    source, target = stage_path(spark), stage_path(spark)
    write_table(_holey_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus"), source)
    run(spark, source, target, "o_orderkey", with_report=False)
    return read_table(spark, f"{target}/cleaned")


def _holey_job(spark: SparkSession, sf_dir: str, artefact: str | None = None):
    """The job over all columns, with its report: its result, or an artefact as written."""
    source, target = stage_path(spark), stage_path(spark)
    write_table(_holey_orders(spark, sf_dir), source, "parquet")
    result = run(spark, source, target, "o_orderkey", in_format="parquet", out_format="parquet", order_by=["o_orderkey"])
    return result if artefact is None else read_table(spark, f"{target}/report/{artefact}", "parquet")


# The holey table inside: no sparse column, rows of at least half their cells, no missing cell.
HOLEY_JOB = f"""WITH {HOLEY_ORDERS},
  narrow AS (SELECT * EXCLUDE (o_orderpriority) FROM holey),
  filled AS (SELECT * FROM narrow WHERE {" + ".join(f"CAST({_valid(c)} AS INT)" for c in HOLEY_COLUMNS[:5])} >= 0.5 * 5),
  solid AS (SELECT * FROM filled WHERE {" AND ".join(_valid(c) for c in HOLEY_COLUMNS[:5])}),
  f1 AS ({_inside_sql("solid", "o_custkey")}),
  cleaned AS (SELECT * REPLACE (lower(o_orderstatus) AS o_orderstatus) FROM ({_inside_sql("f1", "o_totalprice")}))
"""


@query(f"{HOLEY_JOB} SELECT * FROM cleaned")
def run_job_whole(spark, sf_dir):
    """All columns, with the report; the cleaned table as the result reads it back."""
    return _holey_job(spark, sf_dir).cleaned


@query(
    HOLEY_JOB
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step_no, '{step}' AS step, count(*) AS rows, CAST({width} AS BIGINT) AS columns,"
        f" count(*) * {width} AS cells FROM {source}"
        for i, (step, source, width) in enumerate((
            ("initial", "holey", 6), ("drop sparse columns", "narrow", 5), ("drop sparse rows", "filled", 5),
            ("drop rows with missing values", "solid", 5), ("clean columns", "solid", 5), ("drop outliers", "cleaned", 5),
            ("drop duplicates", "cleaned", 5),
        ))
    )
)
def run_job_step_counts(spark, sf_dir):
    """Counted while the job wrote the table."""
    return _holey_job(spark, sf_dir).step_counts


@query(
    f"""WITH {HOLEY_ORDERS}, numbers AS (
      SELECT o_custkey, CASE WHEN NOT isnan(o_totalprice) THEN o_totalprice END AS o_totalprice FROM holey)
    {_rounded_boxplot_sql("numbers", ["o_custkey", "o_totalprice"])}"""
)
def run_job_boxplots(spark, sf_dir):
    """An artefact as the job wrote it: boxplots of the original."""
    return _rounded(_holey_job(spark, sf_dir, "boxplots_before_cleaning"), *BOX_NUMBERS)


@query(
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS amount,
              event_id % 2 = 0 AS flag FROM events"""
)
def csv_missing_tokens(spark, sf_dir):
    """Missing-value tokens are recognised before types are inferred."""
    key = F.col("event_id")
    events = _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(key % 8 == 0, "NA")
        .when(key % 8 == 4, "null")
        .otherwise(F.col("value").cast("string"))
        .alias("amount"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("flag"),
    )
    path = stage_path(spark)
    write_table(events, path)
    return read_table(spark, path, tokens=completeness.MISSING_TOKENS)


@query("SELECT * FROM documents")
def csv_roundtrip_text(spark, sf_dir):
    """Long texts with line breaks and quotes."""
    documents = _table(spark, sf_dir, "documents")
    path = stage_path(spark)
    write_table(documents, path)
    return read_table(spark, path, schema=documents.schema, multi_line=True)
