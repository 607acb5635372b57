"""Composite jobs: what a caller of the original service runs, as Spark
jobs over whole file sets and tables.

* ``build_purchase_order`` files -> item roll-up, PO lines + header,
                           comparison with the reference catalogue, manifest
* ``refresh_reference``    catalogue file -> cleaned, de-duplicated rows,
                           versioned replace of the reference table
* ``extend_prices``        price extension of an inventory frame
* ``list_files`` / ``upload_manifest`` live in ``operators.catalogue``
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palletwise.functions.columns import file_base, file_ext, run_stamp, safe_name, stamped_name
from palletwise.functions.constants import INVENTORY_REQUIRED, JOB_EXTENSIONS
from palletwise.operators import compare
from palletwise.operators.clean import c, clean_reference, require_columns, resolve_id_column
from palletwise.operators.rollups import item_rollup, pallet_rollup, po_header, po_lines, priced
from palletwise.session import scratch_path, stage
from palletwise.sources import sinks
from palletwise.sources.files import EXTRA, bad_rows, read_tabular

ITEM_KEY = "_item_key"


def extend_prices(df: DataFrame, pct: float, strip_currency: bool = True) -> DataFrame:
    """Validate the inventory contract, coerce quantity/price and add
    ``extended_retail`` and ``extended_percent``.  Extra columns pass through."""
    require_columns(df, INVENTORY_REQUIRED)
    return priced(df, pct, strip_currency)


def check_percent(pct) -> float:
    """The discount rate must be numeric."""
    try:
        return float(pct)
    except (TypeError, ValueError):
        raise ValueError("discount rate must be numeric") from None


def _key_of_layout(df: DataFrame) -> DataFrame:
    """The item id of each row, taken from the id column of *its* file's
    layout (item_id, else the first column named no., item_number or
    number), so files naming the id differently are compared alike."""
    col = resolve_id_column(df, mode="file_order")
    return df.withColumn(ITEM_KEY, c(col) if col else F.lit(None).cast("string"))


def build_purchase_order(
    spark: SparkSession,
    paths,
    reference: DataFrame,
    pct: float,
    attrs: dict | None = None,
    strip_currency: bool = True,
    out_dir: str | None = None,
    per_page: int = 23,
    now: _dt.datetime | None = None,
    user_id: str = "",
) -> dict[str, DataFrame]:
    """The purchase-order package over every admitted file.

    The consolidated rows are written once as Parquet in the shared
    checkpoint folder and every branch scans only the columns it needs.
    Returns a dict of DataFrames: consolidated, manifest, bad_rows, item_rollup,
    po_lines, po_header, comparison, unmatched_items, files_with_missing,
    summary, counts (rows read, rows without an item id, rows with extra
    fields, files read and failed; counted while the rows are staged).

    With ``out_dir`` the outputs are landed as ``csv/<user>/<stamped name>``
    (item roll-up, sorted by key) and ``pdf/<user>/<stamped name>`` (the PO
    lines as Parquet), and then named together by one new version of the log
    under ``out_dir``; ``read_outputs`` gives those of the latest version.
    So either all outputs of a run are found or none."""
    pct = check_percent(pct)
    rows, manifest = read_tabular(spark, paths, JOB_EXTENSIONS, on_layout=_key_of_layout)
    if rows is None:
        raise ValueError("no readable file")
    stamp = run_stamp(now or _dt.datetime.now())
    manifest = manifest.withColumn(
        "stored_name",
        F.when(F.col("success"), stamped_name(safe_name(file_base("source_file")), stamp, file_ext("source_file"))),
    )
    staged = scratch_path(spark, "consolidated")
    key = F.trim(F.col(ITEM_KEY))
    seen = Observation("rows read")
    sinks.write_consolidated(rows.observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(key.isNull() | (key == "")).alias("null_ids"),
        (F.count_if(F.col(EXTRA).isNotNull()) if EXTRA in rows.columns else F.sum(F.lit(0))).cast("long").alias("bad_rows")), staged)
    consolidated = spark.read.parquet(staged)
    found = seen.get

    out: dict[str, DataFrame] = {"consolidated": consolidated, "manifest": manifest,
                                 "bad_rows": bad_rows(consolidated)}
    out["item_rollup"] = item_rollup(consolidated.drop(ITEM_KEY))
    out["po_lines"] = po_lines(pallet_rollup(consolidated, pct, strip_currency), per_page=per_page)
    out["po_header"] = po_header(spark, attrs, report_defaults=True)

    # both sides are reduced once and shared by the four comparison outputs
    items = stage(compare.distinct_items(consolidated, ITEM_KEY), "items")
    keys = stage(compare.reference_keys(reference), "reference_keys")
    out["comparison"] = compare.compare_items(items, keys=keys)
    out["unmatched_items"] = compare.unmatched_items(items, keys=keys)
    out["files_with_missing"] = compare.files_with_missing(items, keys=keys)
    out["summary"] = compare.comparison_summary(items, keys=keys)

    counted = [F.lit(found[c] or 0).cast("long").alias(c) for c in ("n_rows", "null_ids", "bad_rows")]
    out["counts"] = manifest.agg(F.count_if("success").alias("files_read"), F.count_if(~F.col("success")).alias("files_failed")).select(
        *counted, "files_read", "files_failed")

    if out_dir:
        base = sinks.current_version(spark, out_dir)
        land = {"item_rollup": f"csv/{user_id or '-'}/item_rollup_{stamp}.csv", "po_lines": f"pdf/{user_id or '-'}/po_lines_{stamp}"}
        sinks.write_sorted_csv(out["item_rollup"], f"{out_dir.rstrip('/')}/{land['item_rollup']}", ["item_id", "item_desc"])
        out["po_lines"].write.mode("errorifexists").parquet(f"{out_dir.rstrip('/')}/{land['po_lines']}")
        sinks.commit_paths(spark, out_dir, land, based_on=base)
    return out


def read_outputs(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The outputs the latest committed run landed under ``out_dir``."""
    land = {f["name"]: f"{out_dir.rstrip('/')}/{f['folder']}" for f in sinks.committed_paths(spark, out_dir)}
    return {"item_rollup": spark.read.option("header", True).option("escape", '"').csv(land["item_rollup"]),
            "po_lines": spark.read.parquet(land["po_lines"])} if land else {}


def refresh_reference(spark: SparkSession, path: str, table_root: str | None = None,
                      user_id: str | None = None) -> tuple[DataFrame, int]:
    """Replace the reference catalogue from one .csv/.xlsx file.

    Headers normalised, ``no.``/``description`` required, blanks dropped,
    first row per key kept, values cut to 100/500/255 characters.  With
    ``table_root`` the rows replace the table there, as one new version.
    With ``user_id`` the rows carry that user and only that user's rows are
    replaced; the files of other users' rows are not touched.
    Returns (rows, number of rows) -- the rows of this refresh."""
    name = os.path.basename(path.rstrip("/"))
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if not name or ext not in JOB_EXTENSIONS:
        raise ValueError("unsupported format")
    rows, manifest = read_tabular(spark, [path], JOB_EXTENSIONS)
    bad = manifest.filter(~F.col("success")).select("error").limit(1).collect()
    if rows is None or bad:
        raise ValueError(bad[0]["error"] if bad else "empty file")
    ref = clean_reference(rows, name)
    if user_id is not None:
        ref = ref.withColumn("user_id", F.lit(str(user_id)))
    if table_root:
        if user_id is None:
            sinks.replace_table(ref, table_root, spark)
        else:
            sinks.replace_slice(ref, table_root, "user_id", str(user_id))
        ref = sinks.read_table(spark, table_root)
        if user_id is not None:
            ref = ref.filter(F.col("user_id") == F.lit(str(user_id)))
    return ref, ref.count()


def upload_stamp(now: _dt.datetime | None = None) -> str:
    return (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")


__all__ = ["build_purchase_order", "refresh_reference", "extend_prices", "safe_name", "upload_stamp"]
