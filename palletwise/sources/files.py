"""File sources: delimited files and workbooks whose headers differ.

Reading many files with different headers through one ``read.csv`` would
silently misplace columns (Spark takes the header of one file for all).  So
the scan is planned per *layout*:

1. the head of each file (its first record) gives delimiter and header; the
   rest is checked by Spark's text source, split by split: bytes that are
   not UTF-8, quoted fields that span lines, a quote never closed;
2. files are grouped by (delimiter, normalised header) -- the plan grows
   with the number of distinct layouts, not with the number of files;
3. one ``read.csv`` per group, every column as text, columns named by the
   normalised header;
4. the groups are concatenated by column name (missing -> null).

Paths are literal: characters that Spark would read as a pattern are escaped.

Workbooks (.xlsx) have no built-in Spark source: one workbook per row of a
``binaryFile`` scan is parsed on the executors (``workbook.py``), emitting
(source_file, row index, cell values); header rows pick the columns.

Every row carries ``source_file`` and ``_pos`` (file path, block start, row
id within the block) -- the "row order" used by keep-first operators; files
of the same name in different folders stay apart in it.  Bad
files are isolated in a manifest (source_file, success, error) instead of
failing the job.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwise.functions.columns import null_tokens_sql, quote_name, strip_ws
from palletwise.functions.constants import NA_TOKENS, SNIFF_CHARS
from palletwise.session import ship_package, stage

SNIFF_FILES_PER_TASK = 64

MANIFEST_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

HEAD_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("sep", T.StringType()),
    T.StructField("header", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

OVERFLOW = "_overflow"  # first field beyond the header's width, if any
EXTRA = "_extra"  # all fields beyond the header's width, null for good rows
RAW = "_raw_record"  # text of a record whose number of fields is not the header's
csv.field_size_limit(sys.maxsize)  # fields of any length
READER_COLUMNS = 20480  # Spark's own limit, raised for wider files


def _as_paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def literal(path: str) -> str:
    """``path`` as Spark's readers take it: no part of it is a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _path_of(uri: Column) -> Column:
    """The plain path of a percent-encoded metadata path, decoded only where
    something is encoded: scans ask for it in every row."""
    return F.when(F.contains(uri, F.lit("%")), F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))).otherwise(uri)


def unlisted_files(spark: SparkSession, paths) -> list[tuple[str, str]]:
    """(path, reason) of the files under ``paths`` that Spark's readers leave
    out: ``empty file``, or ``hidden name`` if a name on the way begins with
    ``_`` or ``.``.  The markers and checksums of Spark's own writers (no
    extension, or a leading dot) are not among them."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    out = []
    for root in _as_paths(paths):
        top = hadoop.Path(root)
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            continue
        above = fs.makeQualified(top.getParent() if fs.getFileStatus(top).isFile() else top).toString()
        found = fs.listFiles(top, True)
        while found.hasNext():
            status = found.next()
            path = fs.makeQualified(status.getPath()).toString()
            names = [x for x in path[len(above) :].split("/") if x]
            if any(x[0] == "." or x[0] == "_" and "=" not in x for x in names):
                if names[-1][0] != "." and "." in names[-1]:
                    out.append((path, "hidden name"))
            elif not status.getLen():
                out.append((path, "empty file"))
    return out


def list_files(spark: SparkSession, paths, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length of every file under ``paths``.  The
    ``content`` column is never selected, so files are not read."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load([literal(p) for p in _as_paths(paths)]).select("path", "modificationTime", "length")


def file_catalogue(spark: SparkSession, root) -> DataFrame:
    """Catalogue rows (nombre, tipo, user_id, fecha_subida, tamano, url) of
    the files under ``root`` laid out as ``<tipo>/<user_id>/<name>``; file
    contents are not read."""
    from palletwise.operators.catalogue import catalogue_from_listing

    return catalogue_from_listing(list_files(spark, root))


def open_input(path: str):
    """A readable, seekable binary file on any file system Spark can name."""
    if path.startswith("file:") or "://" not in path:
        local = path[5:] if path.startswith("file:") else path
        while local.startswith("//"):
            local = local[1:]
        return open(local, "rb")
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def open_output(path: str):
    """A writable binary stream for ``path`` on any file system Spark can
    name (used by executor-side writers)."""
    if path.startswith("file:") or "://" not in path:
        local = path[5:] if path.startswith("file:") else path
        while local.startswith("//"):
            local = local[1:]
        import os

        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_output_stream(inner)


def sniff_head(raw: bytes) -> tuple[str | None, list[str] | None, str | None]:
    """``sniff_stream`` of the bytes of a file."""
    return sniff_stream(io.BytesIO(raw))


def sniff_stream(stream) -> tuple[str | None, list[str] | None, str | None]:
    """(sep, normalised header, error) from the head of a file; no more of
    it is read than its first record that isn't blank.

    Delimiter: ``,`` if the first 1,024 characters contain one, else ``;``.
    The header is split with the same quoting rules as the scan (a quoted
    name may hold line breaks) and its names trimmed and lower-cased; names
    that collide are an error."""
    text = io.TextIOWrapper(stream, encoding="utf-8", newline="")
    try:
        sample = text.read(SNIFF_CHARS)
        sep = "," if "," in sample else ";"

        def pieces():  # of the sample, then of the rest of the file
            yield from io.StringIO(sample.lstrip("\ufeff"), newline="")
            yield from text

        def lines():  # as the file has them: the sample may end in a line
            rest = ""
            for piece in pieces():
                rest += piece
                if rest.endswith(("\n", "\r")):
                    yield rest
                    rest = ""
            if rest:
                yield rest

        first = next((r for r in csv.reader(lines(), delimiter=sep, quotechar='"') if any(x.strip() for x in r)), None)
    except UnicodeDecodeError as e:
        return None, None, f"not UTF-8 text: {e.reason}"
    if first is None:
        return None, None, "empty file"
    names = []
    for i, n in enumerate(first):
        n = n.strip().lower()
        names.append(n if n else f"unnamed: {i}")
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        return sep, names, f"duplicate columns: {', '.join(dupes)}"
    return sep, names, None


def heads(spark: SparkSession, paths, listed: bool = False) -> DataFrame:
    """Per file: path, sep, header (normalised names), error; the executors
    read the head of each file.  ``listed=True`` means ``paths`` already are
    the files (no second listing), cut into tasks of about
    ``SNIFF_FILES_PER_TASK`` files."""
    ship_package(spark)
    if listed:
        files = _as_paths(paths)
        n = max(1, min(-(-len(files) // SNIFF_FILES_PER_TASK), spark.sparkContext.defaultParallelism * 4))
        listing = spark.createDataFrame([(p,) for p in files], "path string")
        listing = listing.repartition(n) if n > 1 else listing.coalesce(1)
    else:
        listing = list_files(spark, paths, recursive=True).select("path")

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p in b["path"]:
                try:
                    with open_input(p) as fh:
                        out.append((p, *sniff_stream(fh)))
                except Exception as e:  # unreadable file: isolate it
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sep", "header", "error"])

    return listing.mapInPandas(run, HEAD_SCHEMA)


# -- quoted line breaks, found split by split ---------------------------------
#
# Whether a line ends inside a quoted field depends on how the line before it
# ended.  So each line gives two answers, for a begin outside (f0) and inside
# (f1) a quoted field; such functions of one bit compose associatively: lines
# within a split, then splits within a file.


def ends_open(text: Column, sep: str) -> Column:
    """Whether ``text``, begun outside quotes, ends inside a quoted field.  A
    quote opens a field only at its begin, and text after a closing quote
    belongs to the field."""
    s = re.escape(sep)
    closed = F.regexp_replace(F.concat(F.lit(sep), text), rf'{s}"[^"]*+(?:""[^"]*+)*+"[^{s}]*+', "")
    return F.contains(closed, F.lit(sep + '"'))


def composed(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``steps`` (keys, order, f0, f1) composed in order: one (keys, f0, f1)
    per key.  A step that gives one answer for both begins forgets what came
    before; one that swaps them counts as a turn."""
    is_turn = (F.col("f0") & ~F.col("f1")).cast("int")
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("turns", F.sum(is_turn).over(upto))
    fixed = F.when(F.col("f0") == F.col("f1"), F.col(order))
    whole = steps.groupBy(*keys).agg(F.max("turns").alias("turns"), F.max_by(F.struct("f0", "turns"), fixed).alias("last"))
    odd = (F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    end = F.when(odd, ~F.col("last.f0")).otherwise(F.col("last.f0"))
    free = F.col("last").isNull()
    return whole.select(*keys, F.when(free, odd).otherwise(end).alias("f0"), F.when(free, ~odd).otherwise(end).alias("f1"))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, block, row, line); ``uri`` is the path as the scan names it,
    decoded once a file, after the grouping."""
    lines = spark.read.text([literal(p) for p in paths])
    return lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"), F.ltrim("value", F.lit("\ufeff")).alias("line"))


def body_checks(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """(path, bad_lines, multiline) of files with delimiter ``sep``: lines
    that are not UTF-8, and whether a quoted field spans lines -- the first
    line left open was begun outside, so one such line tells."""
    is_open = F.contains("line", F.lit('"')) & ends_open(F.col("line"), sep)
    found = _lines(spark, paths).groupBy("uri").agg(
        F.count_if(~F.is_valid_utf8("line")).alias("bad_lines"), (F.count_if(is_open) > 0).alias("multiline"))
    return found.select(_path_of(F.col("uri")).alias("path"), "bad_lines", "multiline")


def unclosed(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """(path) of the files that end inside a quoted field."""
    quoted = _lines(spark, paths).filter(F.contains("line", F.lit('"')))
    steps = quoted.select("uri", "block", "row", ends_open(F.col("line"), sep).alias("f0"),
                          ends_open(F.concat(F.lit('"'), "line"), sep).alias("f1"))
    ends = composed(composed(steps, ["uri", "block"], "row"), ["uri"], "block").filter("f0")
    return ends.select(_path_of(F.col("uri")).alias("path"))


def sniff(spark: SparkSession, paths, listed: bool = False) -> DataFrame:
    """Per file: path, sep, header (normalised names), multiline, error, as a
    staged table."""
    head = stage(heads(spark, paths, listed), "file-heads")
    good = head.filter("error IS NULL").groupBy("sep").agg(F.collect_list("path").alias("paths"))
    checks = [body_checks(spark, r["paths"], r["sep"]) for r in good.collect()]
    if not checks:
        return head.withColumn("multiline", F.lit(False))
    error = F.coalesce("error", F.when(F.col("bad_lines") > 0, F.lit("not UTF-8 text")))
    found = head.join(reduce(DataFrame.unionByName, checks), "path", "left")
    found = stage(found.select("path", "sep", "header", F.coalesce("multiline", F.lit(False)).alias("multiline"), error.alias("error")), "file-sniff")
    broken = found.filter("multiline AND error IS NULL").groupBy("sep").agg(F.collect_list("path").alias("paths"))
    ends = [unclosed(spark, r["paths"], r["sep"]) for r in broken.collect()]
    if not ends:
        return found
    is_open = reduce(DataFrame.unionByName, ends).withColumn("is_open", F.lit(True))
    error = F.coalesce("error", F.when(F.col("is_open"), F.lit("quoted field never closed")))
    return stage(found.join(is_open, "path", "left").withColumn("error", error).drop("is_open"), "file-sniff")


def with_position(df: DataFrame) -> DataFrame:
    """Adds ``source_file`` and ``_pos`` = (path, block start, row id): the
    order of rows inside each file, stable across re-execution of the scan."""
    path = _path_of(F.col("_metadata.file_path"))
    return df.withColumn("source_file", F.substring_index(path, "/", -1)).withColumn(
        "_pos",
        F.struct(
            path.alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def fields_beyond(raw: Column, sep: str, width: int) -> Column:
    """The fields of a record's text beyond the first ``width`` as an array,
    empty ones null; null if no other is there."""
    s = re.escape(sep)
    text = F.concat(F.lit(sep), F.regexp_replace(raw, "\\r?\\n$", ""))
    fields = F.regexp_extract_all(text, F.lit(rf'{s}("[^"]*+(?:""[^"]*+)*+"[^{s}]*+|[^{s}]*+)'), F.lit(1))
    plain = F.transform(F.slice(fields, width + 1, F.greatest(F.size(fields) - width, F.lit(0))), lambda x: F.nullif(
        F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1$2"), F.lit('""'), F.lit('"')))
        .otherwise(x), F.lit("")))
    last = F.array_max(F.transform(plain, lambda x, i: F.when(x.isNull(), 0).otherwise(i + 1)))
    return F.when(last > 0, F.slice(plain, 1, last))


def read_delimited(spark: SparkSession, paths, sep: str = ",", names: list[str] | None = None,
                   na_tokens=NA_TOKENS, multiline: bool = False) -> DataFrame:
    """Delimited files with a header row and a fixed delimiter; every column
    as text; the reader's missing-value tokens become null.

    With ``names`` (the sniffed, normalised header) the schema is given to
    the reader, so no job is spent reading a header; all files must share
    that layout.  Without it the header of the first file names the
    columns.  A row with more fields than its header puts the first extra
    field in ``_overflow`` and all of them in the array ``_extra`` (null for
    good rows; see ``bad_rows``), taken from the record's text.
    ``multiline`` reads files whole so quoted fields may span lines."""
    r = (
        spark.read.option("header", "true")
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .option("multiLine", "true" if multiline else "false")
    )
    raw = RAW
    if names is not None:
        while raw in names:
            raw += "_"
        r = r.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*names, raw]]))
        # fields are counted in whole records, whichever columns are asked for
        r = r.option("columnNameOfCorruptRecord", raw).option("columnPruning", "false").option("maxColumns", str(max(READER_COLUMNS, len(names) + 1)))
    df = r.csv([literal(p) for p in _as_paths(paths)])
    data = [x for x in df.columns if names is None or x != raw]
    keep = []
    if names is not None:
        # the reader gives a record's text only along with one of its fields
        first = F.col(quote_name(names[0]))
        text = F.when(first.isNull() | (F.length(first) >= 0), F.col(quote_name(raw)))
        # good records have no text: the condition spares them the rest
        df = df.withColumn(raw, F.when(text.isNotNull(), fields_beyond(text, sep, len(names))))
        keep = [f"{quote_name(raw)}[0] AS {OVERFLOW}", f"{quote_name(raw)} AS {EXTRA}"]
    df = df.selectExpr(*[null_tokens_sql(quote_name(c), c, na_tokens) for c in data], *keep, "_metadata")
    return with_position(df).drop("_metadata")


def bad_rows(df: DataFrame) -> DataFrame:
    """Rows with more fields than their file's header (a tabular reader
    would reject the whole file; here the rows are kept and reported):
    source_file, position, the first extra field and all extra fields."""
    if EXTRA not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "source_file string, _pos struct<file:string,block:long,row:long>, extra string, extras array<string>")
    return df.filter(F.col(EXTRA).isNotNull()).select(
        "source_file", "_pos", F.col(OVERFLOW).alias("extra"), F.col(EXTRA).alias("extras"))


def consolidate(dfs: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column missing from a part is null there.
    Values never move between columns.  No input is an error."""
    dfs = [d for d in dfs if d is not None]
    if not dfs:
        raise ValueError("no readable file")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def manifest_of(sniffed: DataFrame) -> DataFrame:
    """(source_file, path, success, error) from a table with path and error."""
    return sniffed.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "path",
                          F.col("error").isNull().alias("success"), "error")


def read_delimited_auto(spark: SparkSession, paths, on_layout=None, listed: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """Delimited files with sniffed delimiters and differing headers.

    Returns (consolidated rows or None, manifest).  The sniff result is a
    staged table, one small row per file; the manifest is a projection of it,
    and only the path lists of the good files, which the readers take, come
    to the driver, by layout.  Each layout is read with one scan."""
    sniffed = sniff(spark, paths, listed=listed)
    layouts = sniffed.filter("error IS NULL").groupBy("sep", "header", "multiline").agg(F.collect_list("path").alias("paths"))
    parts = [read_delimited(spark, sorted(r["paths"]), r["sep"], list(r["header"]), multiline=r["multiline"])
             for r in sorted(layouts.collect(), key=lambda r: (r["sep"], r["header"], r["multiline"]))]
    if on_layout is not None:
        parts = [on_layout(p) for p in parts]
    return (consolidate(parts) if parts else None), manifest_of(sniffed)


ROW_WORKBOOK_BYTES = 1 << 30  # a larger workbook is opened by path, not sent as a row


def read_workbooks(spark: SparkSession, paths, na_tokens=NA_TOKENS, on_layout=None,
                   max_bytes: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """First sheet of each .xlsx workbook, header in its first row, every
    cell as text.  Returns (consolidated rows or None, manifest).  One
    workbook is parsed by one task.  Where ``max_bytes`` is given, larger
    workbooks are reported, not read (the length filter is applied by the
    file source before any content is loaded)."""
    from palletwise.sources.workbook import CELLS_SCHEMA, parse_workbooks

    ship_package(spark)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([literal(p) for p in _as_paths(paths)])
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    oversized = listing.filter(too_large).select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        "path",
        F.lit(False).alias("success"),
        F.concat(F.lit("workbook larger than "), F.lit(str(max_bytes)), F.lit(" bytes")).alias("error"),
    )
    raw = listing.filter(~too_large)
    by_path = F.col("length") > ROW_WORKBOOK_BYTES
    raw = raw.filter(~by_path).select("path", "content").unionByName(
        raw.filter(by_path).select("path", F.lit(None).cast("binary").alias("content")))
    # each input row is a whole workbook: hand them to Python one at a time
    # (the parse is staged eagerly, so the setting is scoped to this job)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    previous = spark.conf.get(key, None)
    spark.conf.set(key, "1")
    try:
        cells = stage(raw.select("path", "content").mapInPandas(parse_workbooks, CELLS_SCHEMA), "cells")
    finally:
        if previous is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, previous)
    manifest = (
        cells.filter(F.col("row_idx") <= 0)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("source_file"),
            "path",
            F.col("error").isNull().alias("success"),
            "error",
        )
        .unionByName(oversized)
    )
    # layout key per file, computed in Spark: the normalised header names
    # joined with a separator that cannot occur in them
    norm = F.transform(
        "values",
        lambda x, i: F.when(strip_ws(F.lower(F.coalesce(x, F.lit("")))) == "", F.concat(F.lit("unnamed: "), i.cast("string")))
        .otherwise(strip_ws(F.lower(x))),
    )
    headers = cells.filter((F.col("row_idx") == 0) & F.col("error").isNull()).select(
        "path", F.array_join(norm, "\u0001").alias("layout")
    )
    layouts = [r["layout"] for r in headers.select("layout").distinct().collect()]
    body = cells.filter(F.col("row_idx") > 0).join(headers, "path")
    parts, dup_layouts = [], []
    for layout in sorted(layouts):
        names = layout.split("\u0001")
        if len(set(names)) != len(names):
            dup_layouts.append(layout)  # reported below as a layout error
            continue
        parts.append(
            body.filter(F.col("layout") == F.lit(layout)).selectExpr(
                *[null_tokens_sql(f"`values`[{i}]", n, na_tokens) for i, n in enumerate(names)],
                "element_at(split(path, '/'), -1) AS source_file",
                "named_struct('file', path, 'block', CAST(0 AS BIGINT), 'row', row_idx) AS _pos",
            )
        )
    if dup_layouts:
        dup = headers.filter(F.col("layout").isin(*dup_layouts)).select("path", F.lit(True).alias("_dup"))
        manifest = (
            manifest.join(dup, "path", "left")
            .withColumn("success", F.col("success") & F.col("_dup").isNull())
            .withColumn("error", F.when(F.col("_dup"), F.lit("duplicate columns")).otherwise(F.col("error")))
            .drop("_dup")
        )
    if on_layout is not None:
        parts = [on_layout(p) for p in parts]
    return (consolidate(parts) if parts else None), manifest


def read_tabular(spark: SparkSession, paths, allowed=("csv", "xlsx"), on_layout=None) -> tuple[DataFrame | None, DataFrame]:
    """Delimited files and workbooks together, each admitted by extension.
    Unsupported files, and files of an admitted extension that no Spark source
    lists (empty, or with a hidden name), are reported in the manifest.
    ``on_layout(df)`` runs once per distinct layout before the union (e.g.
    to resolve which column holds the item id in that layout)."""
    kinds: dict[str, list[str]] = {}
    for r in list_files(spark, paths).select("path").collect():
        name = r["path"].rsplit("/", 1)[-1]
        kinds.setdefault(name.rsplit(".", 1)[-1].lower() if "." in name else "", []).append(r["path"])
    frames, manifests = [], []
    rejected = [p for k, ps in kinds.items() if k not in allowed for p in ps]
    if "csv" in allowed and kinds.get("csv"):
        d, m = read_delimited_auto(spark, kinds["csv"], on_layout=on_layout, listed=True)
        frames.append(d)
        manifests.append(m)
    if "xlsx" in allowed and kinds.get("xlsx"):
        d, m = read_workbooks(spark, kinds["xlsx"], on_layout=on_layout)
        frames.append(d)
        manifests.append(m)
    unlisted = [(p, why) for p, why in unlisted_files(spark, paths) if p.rsplit(".", 1)[-1].lower() in allowed]
    skipped = [(p, "unsupported format") for p in rejected] + unlisted
    if skipped:
        manifests.append(spark.createDataFrame([(p.rsplit("/", 1)[-1], p, False, why) for p, why in skipped], MANIFEST_SCHEMA))
    frames = [f for f in frames if f is not None]
    manifest = reduce(lambda a, b: a.unionByName(b), manifests) if manifests else spark.createDataFrame([], MANIFEST_SCHEMA)
    return (consolidate(frames) if frames else None), manifest
