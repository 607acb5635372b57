"""File catalogue: filtered, newest-first, paginated listings, retention
selection and the upload manifest.

Catalogue schema: nombre, tipo, user_id, fecha_subida, tamano, url.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palletwise.functions.columns import ceil_div, file_ext, quote_name, run_stamp, safe_name, split_ext, strip_ws
from palletwise.functions.constants import CATALOGUE_TYPES, DEFAULT_PAGE_LIMIT, RETENTION_MINUTES, UPLOAD_EXTENSIONS


def check_paging(page, limit) -> tuple[int, int]:
    """page and limit must be positive integers."""
    try:
        p, lim = int(page), int(limit)
    except (TypeError, ValueError):
        raise ValueError("page and limit must be positive integers") from None
    if p < 1 or lim < 1:
        raise ValueError("page and limit must be positive integers")
    return p, lim


def search_types(tipo: str | None) -> list[str]:
    """A known type narrows the listing; anything else lists every type."""
    t = (tipo or "").lower()
    return [t] if t in CATALOGUE_TYPES else list(CATALOGUE_TYPES)


def by_user(df: DataFrame, user_id, col: str = "user_id") -> DataFrame:
    """Key equality (pushed into the scan / partition pruning)."""
    return df.filter(F.col(col) == F.lit(str(user_id)))


def search_files(df: DataFrame, tipo: str | None = None, term: str | None = None, user_id=None) -> DataFrame:
    """Type filter, hidden (``.``) and empty names dropped, case-insensitive
    *literal* substring match on the name (``%`` and ``_`` are not wildcards)."""
    if user_id is not None:
        df = by_user(df, user_id)
    out = df.filter(F.col("tipo").isin(*search_types(tipo)))
    out = out.filter(F.col("nombre").isNotNull() & (F.col("nombre") != "") & ~F.col("nombre").startswith("."))
    t = (term or "").strip().lower()
    if t:
        out = out.filter(F.lower("nombre").contains(F.lit(t)))
    return out


def newest_first() -> list[Column]:
    """Newest first; ties in listing order (pdf, csv, xlsx), then name."""
    type_rank = F.array_position(F.array(*[F.lit(t) for t in CATALOGUE_TYPES]), F.col("tipo"))
    return [F.col("fecha_subida").desc(), type_rank.asc(), F.col("nombre").asc()]


def page_of(df: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT) -> DataFrame:
    """One page of one listing: ordered top-(offset+limit) then offset
    (TakeOrderedAndProject; no full sort)."""
    page, limit = check_paging(page, limit)
    return df.orderBy(*newest_first()).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, last: tuple | None, limit: int = DEFAULT_PAGE_LIMIT) -> DataFrame:
    """Keyset page: the ``limit`` entries that follow ``last`` =
    (fecha_subida, tipo, nombre) of the previous page in newest-first
    order.  Cost does not grow with the page number (no offset rows)."""
    _, limit = check_paging(1, limit)
    if last is not None:
        ts, tipo, name = last
        rank = F.array_position(F.array(*[F.lit(t) for t in CATALOGUE_TYPES]), F.col("tipo"))
        last_rank = CATALOGUE_TYPES.index(tipo) + 1 if tipo in CATALOGUE_TYPES else 0
        ts_lit = F.lit(ts).cast(df.schema["fecha_subida"].dataType)
        after = (F.col("fecha_subida") < ts_lit) | (
            (F.col("fecha_subida") == ts_lit)
            & ((rank > F.lit(last_rank)) | ((rank == F.lit(last_rank)) & (F.col("nombre") > F.lit(name))))
        )
        df = df.filter(after)
    return df.orderBy(*newest_first()).limit(limit)


def page_info(df: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT, by: str | None = None) -> DataFrame:
    """total, page, limit, pages (ceiling division) — per ``by`` group when
    given, else for the whole listing."""
    page, limit = check_paging(page, limit)
    counts = df.groupBy(by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        *([by] if by else []),
        F.col("count").alias("total"),
        F.lit(page).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("limit"),
        ceil_div("count", limit).alias("pages"),
    )


def pages_per_user(df: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT, by: str = "user_id") -> DataFrame:
    """Page ``page`` of every user's listing at once, with each row's
    1-based ``position`` in its listing.

    Written as row_number <= page*limit, which Spark turns into a partial
    per-group limit before the shuffle (WindowGroupLimit): a user owning a
    third of all files sends at most page*limit rows per map task."""
    page, limit = check_paging(page, limit)
    w = Window.partitionBy(by).orderBy(*newest_first())
    hi, lo = page * limit, (page - 1) * limit
    ranked = df.withColumn("position", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("position") <= hi).filter(F.col("position") > lo)


def list_files(
    catalogue: DataFrame,
    user_id,
    tipo: str | None = None,
    search: str | None = None,
    page: int = 1,
    limit: int = DEFAULT_PAGE_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(page rows, paging info) of one user's listing."""
    if not user_id:
        raise ValueError("user_id is required")
    hits = search_files(catalogue, tipo, search, user_id)
    return page_of(hits, page, limit), page_info(hits, page, limit)


def expired_files(catalogue: DataFrame, now: _dt.datetime, ttl_minutes: int = RETENTION_MINUTES,
                  ts_col: str = "fecha_subida") -> DataFrame:
    """Entries older than the retention window at ``now`` (a literal, so the
    filter is deterministic and pushed into the scan)."""
    cutoff = (now - _dt.timedelta(minutes=ttl_minutes)).isoformat(sep=" ")
    dtype = catalogue.schema[ts_col].dataType
    return catalogue.filter(F.col(ts_col) < F.lit(cutoff).cast(dtype))


def reference_items(ref: DataFrame, user_id=None) -> DataFrame:
    """Catalogue rows (optionally of one user) in item_number order."""
    if user_id is not None and "user_id" in ref.columns:
        ref = by_user(ref, user_id)
    return ref.orderBy("item_number")


def upload_manifest(files: DataFrame, user_id: str, now: _dt.datetime | None = None,
                    name_col: str = "filename", stamp_col: str | None = None) -> DataFrame:
    """Per uploaded file: success, stored name, safe original name,
    destination path and error text.

    A file is accepted when its name is non-empty and its extension (case
    insensitive) is .xlsx or .xls.  The stored name is
    ``<safe base>_<YYYYMMDD_HHMMSS_ffffff><ext>`` with one stamp per run, or
    per file from the timestamp column ``stamp_col`` (streams)."""
    if stamp_col:
        stamp = F.date_format(F.col(stamp_col), "yyyyMMdd_HHmmss_SSSSSS")
    else:
        stamp = F.lit(run_stamp(now or _dt.datetime.now(), micros=True))
    name = F.col(name_col)
    _, ext = split_ext(name)
    ext = F.lower(ext)
    ok = name.isNotNull() & (name != "") & ext.isin(*UPLOAD_EXTENSIONS)
    error = (
        F.when(name.isNull() | (name == ""), F.lit("empty file name"))
        .when(~ext.isin(*UPLOAD_EXTENSIONS), F.lit("format not allowed (only .xlsx, .xls)"))
        .otherwise(F.lit(""))
    )
    # one projection a step: the safe name is worked out once, for accepted files
    safe_root, _ = split_ext(F.col("_safe"))
    rows = files.select(F.col("*"), error.alias("_error"), F.when(ok, safe_name(name)).alias("_safe"), ext.alias("_ext"), ok.alias("_ok"))
    rows = rows.withColumn("_stored", F.when(F.col("_ok"), F.concat(safe_root, F.lit("_"), stamp, F.col("_ext"))))
    return rows.select(
        *[F.col(quote_name(x)) for x in files.columns],
        F.col("_ok").alias("success"),
        F.when(F.col("_ok"), F.col("_stored")).otherwise(name).alias("stored_name"),
        F.col("_safe").alias("original_filename"),
        F.when(F.col("_ok"), F.concat(F.lit(f"xlsx/{user_id}/"), F.col("_stored"))).otherwise(F.lit("")).alias("destination_path"),
        F.col("_error").alias("error"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """total_files, successful_uploads, failed_uploads."""
    return manifest.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("success")).alias("successful_uploads"),
        F.count_if(~F.col("success")).alias("failed_uploads"),
    )


def admit_files(files: DataFrame, allowed=("csv", "xlsx"), name_col: str = "filename") -> DataFrame:
    """Admission status per file for a job: ``admitted`` and ``reason``
    (empty name / unsupported format).  Extension = text after the last dot,
    lower-cased."""
    name = strip_ws(F.col(name_col))
    ext = file_ext(name)
    ok = name.isNotNull() & (name != "") & name.contains(".") & ext.isin(*allowed)
    reason = (
        F.when(name.isNull() | (name == ""), F.lit("empty file name"))
        .when(~ok, F.lit("unsupported format"))
        .otherwise(F.lit(None).cast("string"))
    )
    return files.withColumn("ext", ext).withColumn("admitted", ok).withColumn("reason", reason)


def catalogue_from_listing(listing: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Catalogue rows from a ``binaryFile`` listing laid out as
    ``<tipo>/<user_id>/<name>`` (see ``palletwise.sources.files``)."""
    parts = F.split(F.col("path"), "/")
    n = F.size(parts)
    return listing.select(
        F.element_at(parts, n).alias("nombre"),
        F.element_at(parts, n - 2).alias("tipo"),
        F.element_at(parts, n - 1).alias("user_id"),
        F.coalesce(F.col("modificationTime"), F.current_timestamp()).alias("fecha_subida"),
        F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("tamano"),
        F.col("path").alias("url"),
    )
