"""Table reads and writes.

* ``write_csv``          header, no index column, one file per partition
* ``write_consolidated`` the consolidated rows as Parquet (shared input of
                         the report branches)
* ``append_rows``        append, returning the number of rows written
* ``replace_table``      full replace as a new version in the table's log
* ``replace_slice``      replace of the rows of one key value (one user);
                         the files of the other values are not touched
* ``change_table``       read, change, replace; again if another writer won
* ``read_table``         latest version of a replaced table, or any
                         Spark-readable table / JDBC source
* ``land``               ``<tipo>/<user_id>/`` partitioned layout
* ``read_landed``        read-back of that layout, pruned to type and user

A versioned table is a folder of data folders and a log.  Version n is the
log entry ``_log/<n>.json``, a list of data folders; it is written under
another name and renamed, which fails if the entry exists.  So of two writers
that start from the same version one commits and the other gets
``ConflictError``, and a reader always finds a complete version.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwise.functions.columns import quote_name
from palletwise.sources import landing

_LOG = "_log"


class ConflictError(RuntimeError):
    """Another writer committed the version this one wanted to."""


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def write_sorted_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV parts whose order by file name is the order of ``keys``: a range
    partitioning, each part sorted, so that no task sees all rows."""
    df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def write_consolidated(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_rows(df: DataFrame, path_or_table: str, fmt: str = "parquet", options: dict | None = None) -> int:
    """Append and report how many rows were written (counted while writing,
    no second pass)."""
    obs = Observation("appended")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode("append").format(fmt)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if fmt == "jdbc":
        w.option("batchsize", "1000").save()
    else:
        w.save(path_or_table)
    return int(obs.get.get("rows", 0))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _entry(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{_LOG}/{version:012d}.json"


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the table's latest version, 0 where there is none."""
    fs, log = _fs(spark, f"{root.rstrip('/')}/{_LOG}")
    if not fs.exists(log):
        return 0
    names = (st.getPath().getName() for st in fs.listStatus(log))
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _folders(spark: SparkSession, root: str, version: int) -> list[dict]:
    """The data folders of a version: {"folder", and "column" and "value" of
    a slice}."""
    if not version:
        return []
    fs, path = _fs(spark, _entry(root, version))
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, version: int, folders: list[dict]) -> None:
    """Create the entry of ``version`` if it is absent, else ConflictError."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs, final = _fs(spark, _entry(root, version))
    _, tmp = _fs(spark, f"{root.rstrip('/')}/{_LOG}/.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:  # without the option to overwrite, an existing entry makes it fail
        files.rename(fs.makeQualified(tmp), fs.makeQualified(final), gateway.new_array(rename, 0))
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            raise ConflictError(f"version {version} of {root} was committed by another writer") from None
        raise


def _write_folder(df: DataFrame, root: str) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{folder}")
    return folder


def table_exists(spark: SparkSession, root: str) -> bool:
    """Whether a versioned table has a version at ``root``."""
    return current_version(spark, root) > 0


def replace_table(df: DataFrame, root: str, spark: SparkSession | None = None, based_on: int | None = None) -> int:
    """Replace the whole content of the table at ``root``; returns the new
    version.

    The rows are written to a new folder first, then the version that names
    it is committed.  A failed run leaves the previous version in place, and
    a table can be replaced from a query that reads it.  An empty input
    yields an empty table.  ``based_on`` is the version the rows were made
    from (by default the one found at the start): if another writer has
    committed since, ConflictError is raised and the table is as that writer
    left it."""
    spark = spark or df.sparkSession
    version = (current_version(spark, root) if based_on is None else based_on) + 1
    _commit(spark, root, version, [{"folder": _write_folder(df, root)}])
    return version


def replace_slice(df: DataFrame, root: str, column: str, value: str, based_on: int | None = None) -> int:
    """Replace the rows whose ``column`` is ``value`` by ``df`` (all rows of
    which have that value); returns the new version.  Folders that hold only
    other values stay as they are; a folder of mixed rows is written again
    without the value, once."""
    spark = df.sparkSession
    version = current_version(spark, root) if based_on is None else based_on
    keep = []
    for f in _folders(spark, root, version):
        if "column" not in f:
            rows = spark.read.parquet(f"{root.rstrip('/')}/{f['folder']}")
            if column in rows.columns and not rows.filter(F.col(column) == value).isEmpty():
                f = {"folder": _write_folder(rows.filter(F.col(column).isNull() | (F.col(column) != value)), root)}
            keep.append(f)
        elif (f["column"], f["value"]) != (column, value):
            keep.append(f)
    _commit(spark, root, version + 1, [*keep, {"folder": _write_folder(df, root), "column": column, "value": value}])
    return version + 1


def commit_paths(spark: SparkSession, root: str, paths: dict[str, str], based_on: int | None = None) -> int:
    """Name outputs that were written under ``root`` (name -> path in it)
    together as the next version of its log."""
    version = (current_version(spark, root) if based_on is None else based_on) + 1
    _commit(spark, root, version, [{"name": n, "folder": p} for n, p in paths.items()])
    return version


def committed_paths(spark: SparkSession, root: str) -> list[dict]:
    """name and folder of the outputs of the latest version under ``root``."""
    return _folders(spark, root, current_version(spark, root))


def change_table(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 5) -> int:
    """Replace the table by ``change(current rows, None if there is no
    table)``.  If another writer commits meanwhile, its rows are read and
    the change is made again, up to ``attempts`` times."""
    for left in reversed(range(attempts)):
        version = current_version(spark, root)
        try:
            return replace_table(change(read_table(spark, root) if version else None), root, spark, based_on=version)
        except ConflictError:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def read_table(spark: SparkSession, root: str, columns: list[str] | None = None, fmt: str | None = None,
               options: dict | None = None) -> DataFrame:
    """A versioned table (latest version), a Parquet folder, a catalog table
    or (``fmt='jdbc'``) a JDBC source -- projected to ``columns`` so only
    those are read.  For JDBC pass partitionColumn/lowerBound/upperBound/
    numPartitions in ``options`` for a parallel read."""
    if fmt == "jdbc":
        r = spark.read.format("jdbc")
        for k, v in (options or {}).items():
            r = r.option(k, v)
        df = r.load()
    elif fmt == "table":
        df = spark.table(root)
    else:
        by_schema: dict[str, list[str]] = {}  # folders of one schema are read with one scan
        for f in _folders(spark, root, current_version(spark, root)):
            path = f"{root.rstrip('/')}/{f['folder']}"
            by_schema.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
        scans = [spark.read.parquet(*paths) for paths in by_schema.values()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans) if scans else spark.read.parquet(root)
    return df.select(*columns) if columns else df


def read_table_partitioned(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int,
                           num_partitions: int, properties: dict | None = None,
                           columns: list[str] | None = None) -> DataFrame:
    """A remote table read in ``num_partitions`` parallel range slices of
    ``column`` (instead of paging through it 1,000 rows at a time); the
    projection is pushed into the remote query."""
    df = spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=properties or {})
    return df.select(*columns) if columns else df


LAND_ROWS = 1_000_000  # rows of a folder that one task writes, about


def land(df: DataFrame, root: str, mode: str = "append") -> None:
    """Partitioned layout ``tipo=<t>/user_id=<u>/`` so listings by type and
    user prune folders instead of scanning them.

    The rows of a folder go to one task, so that there is one file a folder
    and not one for each task that holds some of its rows; a folder of more
    than ``LAND_ROWS`` rows is dealt to as many tasks as that takes.  Plain
    rows added under a local or mounted folder are written by ``landing``,
    others by Spark's writer."""
    spark, keys = df.sparkSession, ["tipo", "user_id"]
    counts = df.groupBy(*[F.col(k).alias(f"_land_{k}") for k in keys]).agg(F.count("*").alias("_land_rows"))
    large = counts.filter(F.col("_land_rows") > LAND_ROWS)
    same = [F.col(k).eqNullSafe(F.col(f"_land_{k}")) for k in keys]
    tasks = F.coalesce(F.ceil(F.col("_land_rows") / LAND_ROWS), F.lit(1))
    hashed = [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    salt = F.pmod(F.xxhash64(*[F.col(quote_name(x)) for x in hashed]), tasks)
    dealt = df.join(large, same[0] & same[1], "left").withColumn("_land_part", salt)
    # a number is named, as small partitions would else be put together in one task, which is bound by its files
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(n, *keys, "_land_part").select(*[F.col(quote_name(x)) for x in df.columns])
    folder = landing.local_folder(spark, root) if mode == "append" else None
    if folder and landing.takes(df, keys, spark.conf.get("spark.sql.parquet.compression.codec").lower()):
        return landing.write_folders(dealt, root, folder, keys)
    dealt.write.mode(mode).partitionBy(*keys).parquet(root)


def read_landed(spark: SparkSession, root: str, tipo: str | None = None, user_id: str | None = None) -> DataFrame:
    """The landed rows, optionally of one type and user: the folders of the
    others are pruned before the scan, and not listed where type and user
    name one folder."""
    folder = root
    # names that the writer takes as they are; others are found in the listing
    if all(v is not None and re.fullmatch(r"[A-Za-z0-9_.-]+", v) for v in (tipo, user_id)):
        fs, path = _fs(spark, f"{root.rstrip('/')}/tipo={tipo}/user_id={user_id}")
        folder = path.toString() if fs.exists(path) else root
    data = spark.read.parquet(folder)
    rest = [f for f in data.schema.fields if f.name not in ("tipo", "user_id")]
    # partition values are text, also where all of them look like numbers
    schema = T.StructType([*rest, T.StructField("tipo", T.StringType()), T.StructField("user_id", T.StringType())])
    df = spark.read.schema(schema).option("basePath", root).parquet(folder)
    for column, value in (("tipo", tipo), ("user_id", user_id)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df
