"""Registered queries: one per operator / job of the survey inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
carry the same names as the matching DuckDB statement in
``palletwise.plans.oracle_sql``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palletwise.functions import columns as C
from palletwise.functions.constants import JOB_EXTENSIONS
from palletwise.operators import catalogue, clean, compare, rollups, tables
from palletwise.plans import jobs, views
from palletwise.plans.oracle_sql import LIST_LIMIT, LIST_USER, LIST_USER_PAGE, NOW, PCT, POS_FIELDS, RUN_STAMP, SAFE_MARKS, UPLOAD_STAMP
from palletwise.session import scratch_path, ship_package, spread, stage
from palletwise.sources import files, sinks

def pos_out():
    return [F.col("_pos")[f].alias(f) for f in POS_FIELDS]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# -- scalar projections ------------------------------------------------------

@register("numeric_coerce")
def numeric_coerce(spark, sf):
    inv = views.inventory(spark, sf)
    return inv.select(
        *pos_out(),
        F.col("quantity").alias("quantity_text"),
        F.col("us_price").alias("price_text"),
        C.to_number("quantity").alias("quantity"),
        C.to_number("us_price").alias("us_price"),
    )


@register("currency_clean")
def currency_clean(spark, sf):
    inv = views.inventory(spark, sf)
    return inv.select(*pos_out(), F.col("us_price").alias("price_text"), C.currency_to_number("us_price").alias("us_price"))


@register("extend_prices")
def extend_prices(spark, sf):
    inv = views.inventory(spark, sf).drop("source_file")
    return jobs.extend_prices(inv, PCT).select(*pos_out(), "pallet_id", "item_id", "quantity", "us_price", "extended_retail", "extended_percent")


@register("item_id_format")
def item_id_format(spark, sf):
    inv = views.inventory(spark, sf)
    return inv.select(F.col("item_id").alias("item_text"), C.format_item_id("item_id").alias("item_id")).distinct()


@register("zero_strip")
def zero_strip(spark, sf):
    inv = views.inventory(spark, sf)
    return inv.select("item_id", C.strip_zeros(C.strip_ws("item_id")).alias("item_norm")).distinct()


@register("ellipsis")
def ellipsis_q(spark, sf):
    part = views.table(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")
    return part.select("p_partkey", C.ellipsis(text).alias("description"))


@register("money_text")
def money_text_q(spark, sf):
    o = views.table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return o.select("o_orderkey", C.money_text("o_totalprice").alias("total_text"),
                    C.money_text(-F.col("o_totalprice")).alias("credit_text"))


@register("order_date")
def order_date_q(spark, sf):
    od = views.order_dates(spark, sf)
    return od.select("o_orderkey", F.col("order_date").alias("order_date_text"),
                     C.format_order_date("order_date").alias("order_date"))


@register("file_parts")
def file_parts(spark, sf):
    f = views.files(spark, sf)
    base = C.file_base("nombre")
    return f.select(
        "url",
        C.file_ext("nombre").alias("ext"),
        base.alias("base"),
        C.stamped_name(C.safe_name(base), RUN_STAMP, C.file_ext("nombre")).alias("stamped_name"),
    )


# -- roll-ups ----------------------------------------------------------------

@register("pallet_rollup")
def pallet_rollup(spark, sf):
    return rollups.pallet_rollup(views.inventory(spark, sf), PCT)


@register("po_lines")
def po_lines(spark, sf):
    return rollups.po_lines(rollups.pallet_rollup(views.inventory(spark, sf), PCT))


@register("item_rollup")
def item_rollup(spark, sf):
    return rollups.item_rollup(views.inventory(spark, sf))


# -- comparison with the reference catalogue --------------------------------

def _items(spark, sf):
    return compare.distinct_items(views.inventory(spark, sf))


@register("distinct_items")
def distinct_items(spark, sf):
    return _items(spark, sf)


@register("item_files")
def item_files(spark, sf):
    return compare.item_files(_items(spark, sf)).select(
        "item_id", F.array_join("source_files", "|").alias("source_files"))


@register("exact_matches")
def exact_matches(spark, sf):
    return compare.exact_matches(_items(spark, sf), views.reference(spark, sf))


@register("normalised_matches")
def normalised_matches(spark, sf):
    return compare.normalised_matches(_items(spark, sf), views.reference(spark, sf))


@register("item_file_rows")
def item_file_rows(spark, sf):
    return compare.item_file_rows(_items(spark, sf))


@register("unmatched_item_files")
def unmatched_item_files(spark, sf):
    return compare.unmatched_item_files(_items(spark, sf), views.reference(spark, sf))


@register("unmatched_items")
def unmatched_items(spark, sf):
    return compare.unmatched_items(_items(spark, sf), views.reference(spark, sf)).select(
        "item_id", F.array_join("source_files", "|").alias("source_files"))


@register("compare_items")
def compare_items(spark, sf):
    return compare.compare_items(_items(spark, sf), views.reference(spark, sf))


@register("files_with_missing")
def files_with_missing(spark, sf):
    return compare.files_with_missing(_items(spark, sf), views.reference(spark, sf))


@register("comparison_summary")
def comparison_summary(spark, sf):
    return compare.comparison_summary(_items(spark, sf), views.reference(spark, sf))


# -- reference refresh and keyed table maintenance ----------------------------

def _refreshed(spark, sf):
    return clean.clean_reference(views.reference_upload(spark, sf), views.REFERENCE_UPLOAD_NAME)


@register("dedupe_reference")
def dedupe_reference(spark, sf):
    return _refreshed(spark, sf)


@register("append_if_absent")
def append_if_absent(spark, sf):
    table, _ = tables.append_if_absent(_refreshed(spark, sf), views.reference(spark, sf), "item_number")
    return table


@register("update_by_key")
def update_by_key(spark, sf):
    changes = _refreshed(spark, sf).select("item_number", "description")
    table, _ = tables.update_by_key(views.reference(spark, sf), changes, "item_number")
    return table


@register("update_unknown_keys")
def update_unknown_keys(spark, sf):
    changes = _refreshed(spark, sf).select("item_number", "description")
    _, unknown = tables.update_by_key(views.reference(spark, sf), changes, "item_number")
    return unknown


@register("delete_by_keys")
def delete_by_keys(spark, sf):
    return tables.delete_by_keys(views.reference(spark, sf), _refreshed(spark, sf), "item_number")


@register("reference_items")
def reference_items(spark, sf):
    return catalogue.reference_items(views.reference(spark, sf))


# -- file catalogue and uploads -----------------------------------------------

@register("search_files")
def search_files(spark, sf):
    return catalogue.search_files(views.files(spark, sf), "CSV", " View_1 ")


@register("list_files_page")
def list_files_page(spark, sf):
    listed = catalogue.search_files(views.files(spark, sf), None, None)
    return catalogue.pages_per_user(listed, LIST_USER_PAGE, LIST_LIMIT)


@register("file_page_info")
def file_page_info(spark, sf):
    listed = catalogue.search_files(views.files(spark, sf), "everything", "")
    return catalogue.page_info(listed, LIST_USER_PAGE, LIST_LIMIT, by="user_id")


def _one_user(spark, sf):
    return catalogue.list_files(views.files(spark, sf), LIST_USER, "any", " VIEW ", page=LIST_USER_PAGE, limit=LIST_LIMIT)


@register("list_files_one_user")
def list_files_one_user(spark, sf):
    # the page holds at most LIST_LIMIT rows: one small window numbers it
    page, _ = _one_user(spark, sf)
    place = F.row_number().over(Window.orderBy(*catalogue.newest_first())) + (LIST_USER_PAGE - 1) * LIST_LIMIT
    return page.withColumn("position", place.cast("long"))


@register("list_files_one_user_info")
def list_files_one_user_info(spark, sf):
    return _one_user(spark, sf)[1]


@register("page_after_one_user")
def page_after_one_user(spark, sf):
    """The page after the entry that ``page_of`` puts last on page 1."""
    listed = catalogue.search_files(views.files(spark, sf), user_id=LIST_USER)
    last = catalogue.page_of(listed, 1, LIST_LIMIT).select("fecha_subida", "tipo", "nombre").collect()[-1:]
    page = catalogue.page_after(listed, tuple(last[0]) if last else None, LIST_LIMIT)
    place = F.row_number().over(Window.orderBy(*catalogue.newest_first())) + len(last) * LIST_LIMIT
    return page.withColumn("position", place.cast("long"))


@register("expired_files")
def expired_files(spark, sf):
    return catalogue.expired_files(views.files(spark, sf), _dt.datetime.fromisoformat(NOW))


def _manifest(spark, sf):
    names = views.files(spark, sf).select(F.col("nombre").alias("filename"))
    return catalogue.upload_manifest(names, "u1", now=_dt.datetime.strptime(UPLOAD_STAMP, "%Y%m%d_%H%M%S_%f"))


@register("upload_manifest")
def upload_manifest(spark, sf):
    return _manifest(spark, sf)


@register("manifest_summary")
def manifest_summary(spark, sf):
    return catalogue.manifest_summary(_manifest(spark, sf))


@register("admit_files")
def admit_files(spark, sf):
    names = views.files(spark, sf).select(F.col("nombre").alias("filename"))
    return catalogue.admit_files(names, JOB_EXTENSIONS)


# -- consolidation of files with different layouts ---------------------------

@register("consolidate")
def consolidate_q(spark, sf):
    inv = views.inventory(spark, sf).select(F.col("*"), *[F.col("_pos")[f].alias(f) for f in POS_FIELDS]).drop("_pos")
    pos = list(POS_FIELDS)
    a = inv.filter(F.col("source_file").startswith("file_A")).select(*pos, "item_id", "quantity", "pallet_id", "source_file")
    n = inv.filter(F.col("source_file").startswith("file_N")).select(
        *pos, "quantity", "item_id", "series_desc", F.lit("x").alias("extra"), "source_file")
    r = inv.filter(F.col("source_file").startswith("file_R")).select(
        *pos, "item_id", "us_price", "quantity", "item_desc", "source_file")
    return files.consolidate([a, n, r])


# -- file round trips: the same data through the real file sources -----------
#
# The views are written as delimited files (two layouts: different column
# order and delimiter) into a fresh folder under the session's shared
# checkpoint folder, then read back with layout sniffing.  Rows are written
# in position order (a distributed range sort), so file order reproduces the
# row order that keep-first operators rely on.

INV_COLS = ["series_desc", "pallet_id", "item_id", "item_desc", "us_price", "quantity"]


def _export_inventory(spark, sf) -> str:
    root = scratch_path(spark, "uploads")
    inv = views.inventory(spark, sf, ordered=True)
    n_side = F.col("source_file").startswith("file_N")
    inv.filter(n_side).select(*INV_COLS).write.option("header", True).csv(f"{root}/layout_a")
    inv.filter(~n_side).select(*reversed(INV_COLS)).toDF(
        *[" " + c.upper() + " " for c in reversed(INV_COLS)]
    ).write.option("header", True).option("sep", ";").csv(f"{root}/layout_b")
    return root


@register("files_consolidate")
def files_consolidate(spark, sf):
    rows, _ = files.read_tabular(spark, _export_inventory(spark, sf))
    return rows.select(*INV_COLS)


@register("files_item_rollup")
def files_item_rollup(spark, sf):
    rows, _ = files.read_tabular(spark, _export_inventory(spark, sf))
    return rollups.item_rollup(rows)


@register("files_pallet_rollup")
def files_pallet_rollup(spark, sf):
    # one layout only, so the file order is the row order of the view
    root = scratch_path(spark, "uploads")
    views.inventory(spark, sf, ordered=True).select(*INV_COLS).write.option("header", True).csv(root)
    rows, _ = files.read_tabular(spark, root)
    return rollups.pallet_rollup(rows, PCT)


@register("files_refresh_reference")
def files_refresh_reference(spark, sf):
    root = scratch_path(spark, "reference")
    raw = views.reference_upload(spark, sf, ordered=True).select(
        F.col("`no.`").alias(" No. "), F.col("description").alias("Description"))
    raw.write.option("header", True).csv(f"{root}/{views.REFERENCE_UPLOAD_NAME}")
    ref, _ = jobs.refresh_reference(spark, f"{root}/{views.REFERENCE_UPLOAD_NAME}")
    return ref


# -- strict price parse and the scalable numbering path -----------------------

@register("currency_strict")
def currency_strict(spark, sf):
    inv = views.inventory(spark, sf)
    return inv.select(*pos_out(), F.col("us_price").alias("price_text"), C.currency_strict("us_price").alias("us_price"))


@register("line_numbers_bucketed")
def line_numbers_bucketed(spark, sf):
    """Global pallet line numbers through the multi-range path (ranges of
    at most 2,000 lines), which must equal one ordered window."""
    pallets = rollups.pallet_rollup(views.inventory(spark, sf), PCT).select("pallet_id")
    numbered, _ = rollups.number_lines(pallets, "pallet_id", rows_per_bucket=2000)
    return numbered


WORKBOOK_ROWS = 100_000  # rows of an exported workbook at most (a sheet of .xlsx ends at 1,048,576)


def _export_workbooks(spark, sf) -> str:
    """The inventory view written as workbooks by the executors: those of a
    partition one after the other, each closed at ``WORKBOOK_ROWS`` rows and
    written as its rows come (so a task holds one batch of rows), through
    the file system the path names."""
    root, limit = scratch_path(spark, "workbooks"), WORKBOOK_ROWS
    cols = list(INV_COLS)

    def write(batches):
        from itertools import chain, islice

        import pandas as pd
        from pyspark import TaskContext

        from palletwise.sources.files import open_output
        from palletwise.sources.workbook import write_xlsx

        rows = ([None if v is None or v != v else v for v in r] for b in batches for r in b.itertuples(index=False, name=None))
        part, out = TaskContext.get().partitionId(), []
        first = next(rows, None)
        while first is not None or not out:  # no rows: a workbook of the header alone
            path, n = f"{root}/part-{part:05d}-{len(out):05d}.xlsx", 0

            def counted(book):
                nonlocal n
                for row in book:
                    n += 1
                    yield row

            book = chain([first], islice(rows, limit - 1)) if first is not None else ()
            with open_output(path) as fh:
                write_xlsx(fh, chain([cols], counted(book)))
            out.append((path, n))
            first = next(rows, None)
        yield pd.DataFrame(out, columns=["path", "rows"])

    ship_package(spark)
    inv = views.inventory(spark, sf).select(*cols)
    inv.mapInPandas(write, "path string, rows long").write.format("noop").mode("overwrite").save()
    return root


@register("files_workbook_rollup")
def files_workbook_rollup(spark, sf):
    rows, _ = files.read_workbooks(spark, _export_workbooks(spark, sf))
    return rollups.item_rollup(rows)


@register("reference_key_collisions")
def reference_key_collisions(spark, sf):
    """Keys that the 100-character cut would merge after de-duplication."""
    return clean.reference_key_collisions(_refreshed(spark, sf))


# -- tables, sinks and jobs over real files and folders ------------------------


def _broken_desc():
    """Some descriptions with a line break and quotes."""
    broken = F.concat("item_desc", F.lit('\nsecond "line"'))
    return F.when(F.length("item_desc") % 5 == 0, broken).otherwise(F.col("item_desc")).alias("item_desc")


@register("files_multiline")
def files_multiline(spark, sf):
    """Quoted line breaks late in a file and in a header; files with bytes
    that are not UTF-8, which are left out whole."""
    root = scratch_path(spark, "uploads")
    inv = views.inventory(spark, sf)
    n_side = F.col("source_file").startswith("file_N")
    cols = [c for c in INV_COLS if c != "item_desc"]
    late = inv.filter(n_side).orderBy(F.length("item_desc") % 5 == 0, "_pos").select(*cols, _broken_desc())
    late.write.option("header", True).option("escape", '"').csv(f"{root}/late")
    head = inv.filter(~n_side).select(*cols, _broken_desc()).withColumnRenamed("pallet_id", "Pallet\nID")
    head.write.option("header", True).option("sep", ";").option("escape", '"').csv(f"{root}/head")
    # files whose last line is not UTF-8, as many as the rows' own tasks
    good = inv.select(F.spark_partition_id().alias("part"), F.lit(1).alias("place"), F.concat_ws(",", "item_id", "item_desc", "quantity").alias("value"))
    good = stage(good, "lines")
    ends = spark.createDataFrame([(0, "item_id,item_desc,quantity"), (2, "1,bad,")], "place int, value string")
    ends = ends.withColumn("value", F.when(F.col("place") == 2, F.concat("value", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("value")))
    parts = spark.range(good.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1).select(F.col("id").cast("int").alias("part"))
    lines = good.unionByName(parts.crossJoin(ends)).repartition("part").sortWithinPartitions("part", "place")
    lines.select("part", "value").write.partitionBy("part").text(f"{root}/bad")

    def named(layout):
        return layout.withColumnRenamed("pallet\nid", "pallet_id").select(*INV_COLS)

    return files.read_delimited_auto(spark, [f"{root}/{d}" for d in ("late", "head", "bad")], on_layout=named)[0]


def _as_file(spark, df, path, sep=","):
    """Rows as the one delimited file ``path``, as an upload arrives.  Its
    writer reads them as columns, packed by the tasks that made them."""
    tmp = scratch_path(spark, "upload")
    packed = scratch_path(spark, "upload-rows")
    df.write.option("compression", "zstd").parquet(packed)
    df = spark.read.parquet(packed).coalesce(1)
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(tmp)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    fs.mkdirs(to.getParent())
    part = next(x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(tmp)) if x.getPath().getName().startswith("part-"))
    if not fs.rename(part, to):
        raise OSError(f"{path} was not written")


@register("files_manifest")
def files_manifest(spark, sf):
    """One row a file: what was read from it, or why it was not."""
    root = scratch_path(spark, "uploads")
    inv = views.inventory(spark, sf)
    side = lambda x: inv.filter(F.col("source_file") == f"file_{x}.csv").select(*INV_COLS)
    _as_file(spark, side("AF"), f"{root}/list[1].csv")
    _as_file(spark, side("NF"), f"{root}/a b+c%20.csv", ";")
    _as_file(spark, side("RF"), f"{root}/_list.csv")
    _as_file(spark, side("NO").withColumn("item_desc", F.concat(F.lit('5" '), "item_desc")), f"{root}/user/list[1].csv")
    _as_file(spark, side("NO"), f"{root}/notes.txt")
    _as_file(spark, side("NO").selectExpr("item_id", "item_id AS ` Item_ID`"), f"{root}/twice.csv")
    spark._jvm.org.apache.hadoop.fs.Path(f"{root}/empty.csv").getFileSystem(spark._jsc.hadoopConfiguration()).create(
        spark._jvm.org.apache.hadoop.fs.Path(f"{root}/empty.csv")).close()
    rows, manifest = files.read_tabular(spark, root)
    read = rows.groupBy(F.col("_pos.file").alias("path")).agg(F.count("*").alias("n_rows"))
    return manifest.join(read, "path", "left").select(
        F.replace("path", F.concat(F.regexp_extract("path", "^(.*/uploads-[^/]*/)", 1)), F.lit("")).alias("path"),
        "source_file", "success", "error", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@register("files_fixed_delimiter")
def files_fixed_delimiter(spark, sf):
    """The CSV sink, read back with a fixed delimiter; and the same with ;"""
    inv = views.inventory(spark, sf).select(*INV_COLS)
    comma, semi = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    sinks.write_csv(inv, comma)
    inv.write.option("header", True).option("sep", ";").csv(semi)
    both = [files.read_delimited(spark, p, s).withColumn("sep", F.lit(s)) for p, s in ((comma, ","), (semi, ";"))]
    return files.consolidate(both).select("sep", *INV_COLS)


@register("table_append_read")
def table_append_read(spark, sf):
    """Consolidated sink, counted append, read-back of two columns."""
    ref, path = views.reference(spark, sf), scratch_path(spark, "table")
    sinks.write_consolidated(ref, path)
    added = sinks.append_rows(ref.withColumn("item_number", F.concat(F.lit("N"), "item_number")), path)
    return sinks.read_table(spark, path, ["id", "item_number"]).withColumn("appended", F.lit(added).cast("long"))


@register("table_replace_read")
def table_replace_read(spark, sf):
    """A table replaced from a query that reads it, read back."""
    root = scratch_path(spark, "table")
    sinks.replace_table(views.reference(spark, sf), root)
    sinks.change_table(spark, root, lambda t: t.filter("item_number NOT LIKE 'X%'").withColumn("description", F.upper("description")))
    return sinks.read_table(spark, root)


@register("table_one_user_refresh")
def table_one_user_refresh(spark, sf):
    """The catalogue of one of three users refreshed from a file; the files
    of the others are the same before and after (``untouched``)."""
    root, upload = scratch_path(spark, "table"), scratch_path(spark, "reference") + "/new.csv"
    ref = views.reference(spark, sf).drop("id")
    for user in ("u1", "u2", "u3"):
        sinks.replace_slice(ref.withColumn("user_id", F.lit(user)), root, "user_id", user)
    others = lambda: sinks.read_table(spark, root).filter("user_id <> 'u2'").select(F.col("_metadata.file_path").alias("f")).distinct()
    before = {r["f"] for r in others().collect()}  # a few files a user
    _as_file(spark, ref.select(F.col("item_number").alias("No."), F.upper("description").alias("Description")), upload)
    jobs.refresh_reference(spark, upload, root, user_id="u2")
    same = before == {r["f"] for r in others().collect()}
    return sinks.read_table(spark, root).withColumn("untouched", F.lit(same))


@register("landed_listing")
def landed_listing(spark, sf):
    """The file catalogue landed by type and user, one folder read back."""
    root = scratch_path(spark, "landed")
    sinks.land(views.files(spark, sf).withColumn("user_id", F.col("user_id").cast("string")), root)
    return sinks.read_landed(spark, root, "csv", str(LIST_USER)).select("nombre", "tipo", "user_id", "tamano")


def _job(spark, sf, out_dir=None):
    root = scratch_path(spark, "uploads")
    views.inventory(spark, sf, ordered=True).select(*INV_COLS).write.option("header", True).csv(root)
    return jobs.build_purchase_order(spark, root, views.reference(spark, sf), PCT, out_dir=out_dir, user_id="u1")


@register("job_po_lines")
def job_po_lines(spark, sf):
    """PO lines of the whole job over real files, read from its committed outputs."""
    out_dir = scratch_path(spark, "outputs")
    _job(spark, sf, out_dir)
    return jobs.read_outputs(spark, out_dir)["po_lines"]


@register("job_summary")
def job_summary(spark, sf):
    out = _job(spark, sf)
    counts = out["counts"].first()  # one row of counters
    return out["summary"].withColumns({c: F.lit(counts[c]) for c in ("n_rows", "null_ids", "bad_rows", "files_failed")})


@register("po_headers")
def po_headers(spark, sf):
    """A header for every order, with missing attributes, joined to the order's line total."""
    runs = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("order_date"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("shipping_method"),
        F.when(F.col("o_orderkey") % 2 > 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("company_name"))
    lines = views.table(spark, sf, "lineitem", ["l_orderkey"]).groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n_lines"))
    return rollups.po_headers(runs, report_defaults=True).join(lines, "run_id")


@register("comparison_rows")
def comparison_rows(spark, sf):
    return compare.comparison_rows(_items(spark, sf), views.reference(spark, sf))


@register("reference_positions")
def reference_positions(spark, sf):
    """Catalogue rows with their place in item-number order."""
    return rollups.number_lines(views.reference(spark, sf), "item_number", out="position")[0].select("item_number", "position")


@register("alias_item_rollup")
def alias_item_rollup(spark, sf):
    """A file whose id column has an alias, without item descriptions, with
    a column to drop."""
    raw = views.inventory(spark, sf).select(F.col("item_id").alias(" Number "), "series_desc", "quantity", F.lit("1").alias("Extended Retail"))
    dropped = clean.ensure_item_desc(raw)
    df = clean.normalise_headers(dropped)
    return rollups.item_rollup(df.withColumnRenamed(clean.resolve_id_column(df, mode="file_order"), "item_id"))


@register("safe_names")
def safe_names(spark, sf):
    part = spread(views.table(spark, sf, "part", ["p_partkey", "p_name"]), "p_partkey")
    mark = F.element_at(F.array(*map(F.lit, SAFE_MARKS)), (F.col("p_partkey") % len(SAFE_MARKS) + 1).cast("int"))
    return part.select("p_partkey", C.safe_name(F.concat(F.lit("._"), "p_name", F.lit(" /"), mark, F.lit(" v1.csv_"))).alias("name"))


@register("item_id_any_size")
def item_id_any_size(spark, sf):
    rows = views.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    key, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    text = (F.when(n % 4 == 0, F.concat(key, F.lit(".5e"), (n + 18).cast("string"))).when(n % 4 == 1, F.concat(F.lit("-0."), key))
            .when(n % 4 == 2, F.concat(key, F.lit(".9"))).otherwise(F.concat(key, F.lit("7" * 40))))
    return rows.select("l_orderkey", "l_linenumber", C.format_item_id(text).alias("item_id"))
