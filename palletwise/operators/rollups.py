"""Roll-ups of the purchase-order package.

* ``with_extended_retail`` / ``with_extended_percent`` / ``priced``
                     numeric price columns of inventory rows
* ``pallet_rollup``  quantity and amount per pallet, first description
* ``item_rollup``    quantity per (item, description), ids canonicalised
* ``number_lines``   global 1..n line numbers in key order without pulling the
                     data into one partition
* ``paginate_lines`` page / pages / "Page i of n" of numbered lines
* ``with_total_row`` the ``TOTAL:`` line
* ``po_lines``       numbered, paged report lines plus the total line
* ``po_header``      the header record of the order
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwise.functions.columns import (
    ceil_div,
    currency_to_number,
    ellipsis,
    exact_double_sum,
    exact_total,
    extended_percent,
    format_item_id,
    format_order_date,
    money_text,
    to_number,
    truncate_int,
)
from palletwise.functions.constants import (
    PO_HEADER_FIELDS,
    PO_HEADER_REPORT_DEFAULTS,
    REPORT_LINES_PER_PAGE,
    TOTAL_LABEL,
)
from palletwise.operators.clean import c, ensure_item_desc, first_non_null, require_columns
from palletwise.session import stage

POS = "_pos"


def with_extended_retail(df: DataFrame) -> DataFrame:
    """``extended_retail = quantity * us_price`` (numeric columns)."""
    return df.withColumn("extended_retail", F.col("quantity") * F.col("us_price"))


def with_extended_percent(df: DataFrame, pct: float) -> DataFrame:
    """``extended_percent = extended_retail * pct / 100`` (the share paid)."""
    return df.withColumn("extended_percent", extended_percent("extended_retail", pct))


def priced(df: DataFrame, pct: float, strip_currency: bool = True) -> DataFrame:
    """Adds numeric ``quantity``/``us_price``, ``extended_retail`` and
    ``extended_percent`` (= retail x pct/100).

    ``strip_currency=False`` reproduces reading ``$12.99`` as unparsable (0)."""
    require_columns(df, ["us_price", "quantity"])
    price = currency_to_number("us_price") if strip_currency else to_number("us_price")
    numeric = df.withColumn("quantity", to_number("quantity")).withColumn("us_price", price)
    return with_extended_percent(with_extended_retail(numeric), pct)


def pallet_rollup(df: DataFrame, pct: float, strip_currency: bool = True, pos: str = POS) -> DataFrame:
    """Per pallet: first non-null ``series_desc`` in row order, summed
    quantity and summed extended percent.  Rows without a pallet are dropped.

    One hash shuffle on ``pallet_id``; every aggregate is combinable, so a
    pallet holding a large share of all rows is reduced map-side first."""
    require_columns(df, ["pallet_id", "series_desc", "us_price", "quantity", pos])
    return (
        priced(df.select("pallet_id", "series_desc", "us_price", "quantity", pos), pct, strip_currency)
        .filter(F.col("pallet_id").isNotNull())
        .groupBy("pallet_id")
        .agg(
            first_non_null("series_desc", pos).alias("series_desc"),
            exact_double_sum("quantity").alias("quantity"),
            exact_double_sum("extended_percent").alias("extended_percent"),
        )
    )


def item_rollup(df: DataFrame) -> DataFrame:
    """Quantity per (canonical item id, description).

    ``series_desc`` stands in for a missing ``item_desc``; an ``Extended
    Retail`` column is dropped; rows with a missing description are dropped
    (a missing id prints as ``nan`` and is kept)."""
    require_columns(df, ["item_id"])
    df = ensure_item_desc(df)
    require_columns(df, ["item_desc", "quantity"])
    return (
        df.select(format_item_id("item_id").alias("item_id"), "item_desc", to_number("quantity").alias("quantity"))
        .filter(F.col("item_desc").isNotNull())
        .groupBy("item_id", "item_desc")
        .agg(exact_double_sum("quantity").alias("quantity"))
    )


# ---------------------------------------------------------------------------
# Global line numbering
# ---------------------------------------------------------------------------

def number_lines(
    df: DataFrame,
    key: str,
    out: str = "line_no",
    rows_per_bucket: int = 2_000_000,
    cut_lineage: bool = True,
) -> tuple[DataFrame, int]:
    """1-based line numbers in ``key`` order (ties broken by all columns).

    Returns the numbered frame and the line count.  The rows are dealt into
    ranges of about ``rows_per_bucket`` rows, as many as that takes, and
    written with the number of their range; each range is numbered in its
    own task and shifted by the rows of the ranges before it, joined from a
    table of one row per range.  A last key, unlike in every row, lets a
    range end within equal rows, so no task holds a large group whole.

    The input is cut from its lineage first (written as Parquet in the
    folder the session names), so the count, the ranges and the numbering
    all see the same rows even if an executor is lost in between."""
    if cut_lineage:
        df = stage(df, "lines")
    total = df.count()
    # ties broken by every other orderable column (maps have no order)
    order = [key] + [f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, T.MapType)]
    order = [c(x) for x in order] + [F.col("_line_tie")]
    ranges = (
        df.withColumn("_line_tie", F.monotonically_increasing_id())
        .repartitionByRange(max(1, -(-total // rows_per_bucket)), *order)
        .withColumn("_line_range", F.spark_partition_id())
    )
    ranges = stage(ranges, "line-ranges")
    before = Window.orderBy("_line_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_line_range").count().select(
        "_line_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_line_offset"))
    w = Window.partitionBy("_line_range").orderBy(*order)
    numbered = ranges.withColumn("_line_row", F.row_number().over(w)).join(offsets, "_line_range")
    line = (F.col("_line_offset") + F.col("_line_row")).cast("long").alias(out)
    return numbered.select(*[c(x) for x in df.columns if x != out], line), total


def paginate_lines(lines: DataFrame, total_lines: int, per_page: int = REPORT_LINES_PER_PAGE,
                   line_col: str = "line_no") -> DataFrame:
    """``page`` = ceil(line / per_page) and ``pages`` = ceil(total / per_page)
    (at least 1), plus ``page_label`` "Page i of n"."""
    pages = max(1, -(-total_lines // per_page))
    return (
        lines.withColumn("page", ceil_div(line_col, per_page))
        .withColumn("pages", F.lit(pages).cast("long"))
        .withColumn("page_label", F.format_string("Page %d of %d", F.col("page"), F.col("pages")))
    )


def with_total_row(lines: DataFrame, rollup: DataFrame, pages: int) -> DataFrame:
    """Appends the ``TOTAL:`` line: quantity total truncated after summing,
    money total, on the last page."""
    totals = rollup.agg(
        exact_total("quantity").alias("quantity"), exact_total("extended_percent").alias("extended_percent")
    ).select(
        F.lit(None).cast("long").alias("line_no"),
        F.lit(None).cast("string").alias("pallet_id"),
        F.lit(TOTAL_LABEL).alias("description"),
        truncate_int("quantity").alias("ordered"),
        money_text("extended_percent").alias("ext_price"),
        F.col("extended_percent"),
        F.lit(pages).cast("long").alias("page"),
        F.lit(pages).cast("long").alias("pages"),
        F.format_string("Page %d of %d", F.lit(pages), F.lit(pages)).alias("page_label"),
    )
    return lines.unionByName(totals)


def po_lines(
    rollup: DataFrame,
    per_page: int = REPORT_LINES_PER_PAGE,
    rows_per_bucket: int = 2_000_000,
) -> DataFrame:
    """Report lines of the purchase order from a pallet roll-up.

    line_no (pallet order), pallet_id, description (40 chars + ``...``),
    ordered (integer part), ext_price (``$1,234.50``), extended_percent,
    page, pages, page_label; then one ``TOTAL:`` line (quantity total
    truncated after summing) on the last page.  An empty roll-up yields only
    the total line on page 1 of 1."""
    rollup = stage(rollup, "rollup")
    numbered, total = number_lines(rollup, "pallet_id", rows_per_bucket=rows_per_bucket, cut_lineage=False)
    lines = numbered.select(
        F.col("line_no"),
        F.col("pallet_id"),
        ellipsis("series_desc").alias("description"),
        truncate_int("quantity").alias("ordered"),
        money_text("extended_percent").alias("ext_price"),
        F.col("extended_percent"),
    )
    paged = paginate_lines(lines, total, per_page)
    return with_total_row(paged, rollup, max(1, -(-total // per_page)))


def po_header(spark: SparkSession, attrs: dict | None = None, report_defaults: bool = False) -> DataFrame:
    """One-row header of the order.  Missing attributes default to ``''``
    (job form) or, with ``report_defaults``, to ``N/A`` for purchase info,
    date, shipping and terms.  ``order_date`` is normalised to MM/dd/yyyy."""
    attrs = dict(attrs or {})
    row = {}
    for f in PO_HEADER_FIELDS:
        default = PO_HEADER_REPORT_DEFAULTS.get(f, "") if report_defaults else ""
        v = attrs.get(f)
        row[f] = default if v is None else str(v)
    schema = T.StructType([T.StructField(f, T.StringType(), False) for f in PO_HEADER_FIELDS])
    df = spark.createDataFrame([tuple(row[f] for f in PO_HEADER_FIELDS)], schema)
    return df.withColumn("order_date", format_order_date("order_date"))


def po_headers(runs: DataFrame, key: str = "run_id", report_defaults: bool = False) -> DataFrame:
    """Headers of many runs: one row per row of ``runs`` (the run's ``key``
    and any of the header attributes) with defaults as in ``po_header``.
    Joined to the lines by ``key``."""
    def field(f: str) -> Column:
        value = F.col(f).cast("string") if f in runs.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(PO_HEADER_REPORT_DEFAULTS.get(f, "") if report_defaults else "")).alias(f)

    return runs.select(key, *[field(f) for f in PO_HEADER_FIELDS]).withColumn("order_date", format_order_date("order_date"))
