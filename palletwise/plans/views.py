"""Views over the driver's test tables that play the reference's inputs.

Each view is derived row-for-row from the given tables (no sampling, no id
subsets), so its size grows with them.  The same views exist as SQL text in
``palletwise.plans.oracle_sql`` for the DuckDB oracle; the two definitions
must stay identical.

* ``inventory``   lineitem x part       -> inventory file rows (all text)
* ``reference``   part                  -> the item catalogue
* ``reference_upload`` lineitem x part  -> a raw catalogue file with copies,
                                          blanks and padded keys
* ``files``       events                -> the uploaded-file catalogue
* ``order_dates`` orders                -> order dates as free text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palletwise.session import spread


# key columns used to spread small single-file tables over the cluster
_SPREAD_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A test table, projected to ``columns`` before it is spread (so the
    scan stays pruned)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    key = _SPREAD_KEYS.get(name)
    return spread(df, key) if key else df


def zpad(c: str, n: int) -> F.Column:
    """Integer as text, left-padded with zeros to at least ``n`` digits
    (never cut, so keys stay distinct at any scale)."""
    t = F.col(c).cast("string")
    return F.when(F.length(t) >= n, t).otherwise(F.lpad(t, n, "0"))


# (orderkey, linenumber) is not unique in the generated data; these six
# columns are.  Used as the "row order" of the simulated files.
_POS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def _row_pos() -> F.Column:
    return F.struct(*map(F.col, _POS)).alias("_pos")


def _lines_with_parts(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Lines with their part.  ``ordered`` sorts them in row order here, by
    numbers and before any text is made of them: a sort by the ``_pos`` struct
    of the finished rows compares whole structs and makes the text twice (the
    range sort samples its input first)."""
    li = table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
    ])
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    rows = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return rows.orderBy(*_POS) if ordered else rows


def inventory(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    price_text = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return _lines_with_parts(spark, sf_dir, ordered).select(
        zpad("l_orderkey", 8).alias("pallet_id"),
        F.when(F.col("l_partkey") % 3 == 0, zpad("l_partkey", 6))
        .otherwise(F.col("l_partkey").cast("string"))
        .alias("item_id"),
        F.col("p_name").alias("item_desc"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_brand"))
        .alias("series_desc"),
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("$"), price_text))
        .otherwise(price_text)
        .alias("us_price"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.concat(F.lit("file_"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(".csv")).alias("source_file"),
        _row_pos(),
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    return part.select(
        F.col("p_partkey").alias("id"),
        # large parts carry a key that no inventory line uses
        F.when(F.col("p_size") > 40, F.concat(F.lit("X"), F.col("p_partkey").cast("string")))
        .when(F.col("p_partkey") % 5 == 0, zpad("p_partkey", 8))
        .otherwise(F.col("p_partkey").cast("string"))
        .alias("item_number"),
        F.col("p_name").alias("description"),
        F.lit("catalogue.csv").alias("source_file"),
    )


REFERENCE_UPLOAD_NAME = "Reference List (v2).csv"


def reference_upload(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Raw catalogue file: header ``No.``/``Description`` already lower-cased,
    keys repeated per line item, some blank, some padded with spaces."""
    return _lines_with_parts(spark, sf_dir, ordered).select(
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" "), zpad("l_partkey", 6), F.lit(" ")))
        .otherwise(F.col("l_partkey").cast("string"))
        .alias("no."),
        F.when(F.col("l_linenumber") % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("p_name"), F.lit(" lot "), F.col("l_orderkey").cast("string")))
        .alias("description"),
        _row_pos(),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    tipo = (
        F.when(F.col("event_type").isin("click", "view"), F.lit("csv"))
        .when(F.col("event_type") == "purchase", F.lit("pdf"))
        .otherwise(F.lit("xlsx"))
    )
    hidden = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 10 == 0), F.lit(".")).otherwise(F.lit(""))
    nombre = F.concat(hidden, F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit("."), tipo)
    out = ev.select(
        nombre.alias("nombre"),
        tipo.alias("tipo"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("fecha_subida"),
        F.floor(F.col("value") * 1000).cast("long").alias("tamano"),
    )
    return out.withColumn("url", F.concat_ws("/", "tipo", "user_id", "nombre"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates typed the ways a form sends them: ISO with time, plain,
    single-digit month/day, day-first, empty."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    k = F.col("o_orderkey") % 5
    d = F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(d, "yyyy-M-d"))
        .when(k == 3, F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.lit(""))
    )
    return o.select(F.col("o_orderkey"), text.alias("order_date"))
