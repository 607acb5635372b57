"""Schema checks and cleaning: header normalisation, required columns,
id-column aliases, keep-first de-duplication and the catalogue clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwise.functions.columns import as_col, clean_text, left, safe_name
from palletwise.functions.constants import (
    ID_ALIASES_FILE_ORDER,
    ID_ALIASES_PRIORITY,
    REF_DESC_LEN,
    REF_ITEM_LEN,
    REF_SOURCE_LEN,
    REFERENCE_REQUIRED,
)


class MissingColumnsError(ValueError):
    def __init__(self, missing, found):
        self.missing = list(missing)
        self.found = list(found)
        super().__init__(f"missing required columns: {', '.join(self.missing)} (found: {', '.join(self.found)})")


def q(name: str) -> str:
    """Back-quoted column reference (names such as ``no.`` contain dots)."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Column names trimmed and lower-cased; two names that collide after
    normalisation are an error rather than a silent overwrite."""
    new = [n.strip().lower() for n in df.columns]
    dupes = sorted({n for n in new if new.count(n) > 1})
    if dupes:
        raise ValueError(f"columns collide after normalisation: {', '.join(dupes)}")
    return df.toDF(*new)


def require_columns(df: DataFrame, cols) -> None:
    """Driver-side contract check on the schema, before any job runs."""
    missing = [x for x in cols if x not in df.columns]
    if missing:
        raise MissingColumnsError(missing, df.columns)


def resolve_id_column(df: DataFrame, mode: str = "priority") -> str | None:
    """Name of the column holding item ids.

    ``priority``: first of item_id, no., no, item_number, number present.
    ``file_order``: ``item_id`` if present, else the first column in file
    order whose lower-cased name is item_id, no., item_number or number."""
    if mode == "priority":
        return next((a for a in ID_ALIASES_PRIORITY if a in df.columns), None)
    if "item_id" in df.columns:
        return "item_id"
    return next((x for x in df.columns if x.lower() in ID_ALIASES_FILE_ORDER), None)


def ensure_item_desc(df: DataFrame) -> DataFrame:
    """``series_desc`` becomes ``item_desc`` only when ``item_desc`` is absent;
    an ``Extended Retail`` column is dropped."""
    if "series_desc" in df.columns and "item_desc" not in df.columns:
        df = df.withColumnRenamed("series_desc", "item_desc")
    return df.drop("Extended Retail")


def first_non_null(value: str | Column, pos: str | Column) -> Column:
    """First non-null ``value`` in ``pos`` order, as a combinable aggregate
    (``min_by`` ignores rows whose ordering is null)."""
    v = as_col(value)
    return F.min_by(v, F.when(v.isNotNull(), as_col(pos)))


def dedupe_first(df: DataFrame, key: str, pos: str = "_pos") -> DataFrame:
    """Keep the first row per ``key`` in ``pos`` order.

    One aggregate with partial combine (no window sort), so a key repeated
    in a third of all rows is reduced before the shuffle."""
    others = [x for x in df.columns if x not in (key, pos)]
    picked = F.min_by(F.struct(*[c(x) for x in others]), c(pos)).alias("_first")
    return (
        df.groupBy(c(key))
        .agg(picked, F.min(c(pos)).alias(pos))
        .select(c(key), *[F.col("_first")[x].alias(x) for x in others], c(pos))
        .select(*[c(x) for x in df.columns])
    )


def clean_reference(df: DataFrame, source_name: str, pos: str = "_pos") -> DataFrame:
    """Raw catalogue rows -> ``item_reference`` rows.

    Headers normalised, ``no.``/``description`` required, missing -> '' and
    trimmed, rows with an empty key or description dropped, first row per
    key kept, then cut to 100 / 500 / 255 characters with the safe source
    file name.  (Keys are de-duplicated before the cut, as in the matched
    behaviour; ``reference_key_collisions`` reports keys the cut merges.)"""
    df = normalise_headers(df)
    require_columns(df, REFERENCE_REQUIRED)
    cleaned = df.select(
        clean_text(c("no.")).alias("item_number"),
        clean_text(c("description")).alias("description"),
        c(pos),
    ).filter((F.col("item_number") != "") & (F.col("description") != ""))
    kept = dedupe_first(cleaned, "item_number", pos)
    return kept.select(
        left("item_number", REF_ITEM_LEN).alias("item_number"),
        left("description", REF_DESC_LEN).alias("description"),
        left(safe_name(F.lit(source_name)), REF_SOURCE_LEN).alias("source_file"),
    )


def reference_key_collisions(reference: DataFrame) -> DataFrame:
    """Keys that occur more than once after the length cut."""
    return reference.groupBy("item_number").count().filter(F.col("count") > 1)
