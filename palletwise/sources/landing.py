"""Executor-side writer of the landed layout on a local or mounted folder.

The layout has one folder and one file for each type and user, so its time is
that of making small files.  On the local file system Spark's writer starts
a process (``chmod``) for every folder, file and checksum file, and reads the
whole configuration again for every file.  Here a ``mapInArrow`` task gets its
rows sorted by folder and writes the same tree with pyarrow: Parquet files
with Spark's schema in the footer and Hadoop's checksum file beside them.

Tasks write under ``<root>/_land-<id>/<attempt>`` (a name readers skip).  The
attempts that ended, as Spark reports them, are then moved into ``root``, each
by a task of its own, folders whole where the target has none.  So, as with
Spark's writer, files of failed and repeated attempts are never seen, and a
run that fails while it writes leaves nothing behind.
"""

from __future__ import annotations

import errno
import io
import os
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwise.functions.columns import quote_name
from palletwise.session import ship_package

#: types whose Arrow and Parquet forms Spark reads back as they were
PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
         T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
CODECS = {"snappy": ".snappy", "gzip": ".gz", "zstd": ".zstd", "none": "", "uncompressed": ""}
#: with checksum files; the second, of the Hive jars, passes all to the first
LOCAL = ("org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem")
ROW_GROUP_BYTES = 64 << 20  # rows of one folder that a task holds, about
DICTIONARY_ROWS = 1000  # of a file from which its values are put into dictionaries
CHECKED_BYTES = 512  # of the file to one checksum

_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")  # as Spark's ExternalCatalogUtils
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def escape_name(name: str) -> str:
    """A partition column's name or value as Spark writes it in a path."""
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)


def _bytes(name: str, encoding: str) -> bytes:
    """The name in the JVM's encoding of file names; what that lacks is ``?``
    there, once for each UTF-16 unit."""
    if encoding.lower().replace("-", "") == "utf8":
        return name.encode()
    return re.sub("[\U00010000-\U0010ffff]", "??", name).encode(encoding, "replace")


class _CheckedFile(io.RawIOBase):
    """A new file and beside it ``.<name>.crc`` as Hadoop writes it: a CRC-32
    of every 512 bytes."""

    def __init__(self, folder: bytes, name: bytes, mode: int) -> None:
        self._out, self._sums_out = (self._create(os.path.join(folder, n), mode) for n in (name, b"." + name + b".crc"))
        self._held, self._n_held, self._n, self._sums = [], 0, 0, b"crc\0" + CHECKED_BYTES.to_bytes(4, "big")

    @staticmethod
    def _create(path: bytes, mode: int) -> int:
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode)
        os.fchmod(fd, mode)
        return fd

    @staticmethod
    def _append(fd: int, data) -> None:
        view = memoryview(data)
        while view:
            view = view[os.write(fd, view):]

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._n

    def write(self, data) -> int:
        data = bytes(data)
        self._held.append(data)
        self._n_held += len(data)
        self._n += len(data)
        if self._n_held >= 1 << 20:
            self._flush(self._n_held // CHECKED_BYTES * CHECKED_BYTES)
        return len(data)

    def _flush(self, n: int) -> None:
        data = b"".join(self._held)
        self._held, self._n_held = [data[n:]], len(data) - n
        view = memoryview(data)[:n]
        self._append(self._out, view)
        sums = [zlib.crc32(view[i:i + CHECKED_BYTES]).to_bytes(4, "big") for i in range(0, n, CHECKED_BYTES)]
        self._append(self._sums_out, self._sums + b"".join(sums))
        self._sums = b""

    def close(self) -> None:
        if not self.closed:
            super().close()
            try:
                self._flush(self._n_held)
            finally:
                os.close(self._out)
                os.close(self._sums_out)


class _FolderFile:
    """The Parquet file of one folder, written in row groups."""

    def __init__(self, folder: bytes, name: bytes, mode: int, schema: pa.Schema, codec: str) -> None:
        self._file, self._schema, self._codec = _CheckedFile(folder, name, mode), schema, codec
        self._writer: pq.ParquetWriter | None = None
        self._held: list[pa.RecordBatch] = []

    def add(self, rows: pa.RecordBatch) -> None:
        self._held.append(rows)
        if len(self._held) > 1 and sum(r.nbytes for r in self._held) >= ROW_GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        rows = pa.Table.from_batches(self._held)
        if self._writer is None:  # a dictionary for a few rows takes longer and more room than the rows
            self._writer = pq.ParquetWriter(self._file, self._schema, compression=self._codec, store_schema=False,
                                            use_dictionary=rows.num_rows >= DICTIONARY_ROWS)
        self._writer.write_table(rows)
        self._held = []

    def close(self) -> None:
        if self._held:
            self._flush()
        self._writer.close()
        self._file.close()


def _runs(batch: pa.RecordBatch, keys: int):
    """(first row, number of rows) of each run of equal keys, the last columns."""
    codes = [pc.dictionary_encode(k, null_encoding="encode").indices.to_numpy() for k in batch.columns[-keys:]]
    change = [0]
    if batch.num_rows > 1:
        differs = codes[0][1:] != codes[0][:-1]
        for c in codes[1:]:
            differs |= c[1:] != c[:-1]
        change += [int(i) + 1 for i in differs.nonzero()[0]]
    return [(a, b - a) for a, b in zip(change, [*change[1:], batch.num_rows])]


def _writing(tmp: str, run: str, names: list[str], keys: list[str], footer: dict[str, str], codec: str, modes: tuple[int, int], encoding: str):
    """The task that writes its rows, sorted by the last columns (the keys as
    text); gives the name of its folder and the number of files."""
    file_mode, dir_mode = modes

    def make(path: bytes) -> None:
        try:
            os.mkdir(path)
        except FileExistsError:
            return
        os.chmod(path, dir_mode)

    def write(batches):
        attempt, part, at, file, n = uuid.uuid4().hex, TaskContext.get().partitionId(), None, None, 0
        top = os.path.join(tmp, attempt).encode()
        for batch in batches:
            if not batch.num_rows:
                continue
            if not n:
                os.mkdir(top)
            rows = batch.select(range(len(names))).rename_columns(names)
            for first, length in _runs(batch, len(keys)):
                values = [c[first].as_buffer() for c in batch.columns[-len(keys):]]
                values = [None if v is None else v.to_pybytes() for v in values]
                if values != at:
                    if file:
                        file.close()
                    folder = top
                    for i, (k, v) in enumerate(zip(keys, values)):
                        folder = os.path.join(folder, _bytes(f"{escape_name(k)}={_NO_VALUE if v is None else escape_name(v.decode(errors='replace'))}", encoding))
                        if at is None or values[:i + 1] != at[:i + 1]:
                            make(folder)
                    at = values
                    name = f"part-{part:05d}-{run}.c{n:03d}{CODECS[codec]}.parquet".encode()
                    file, n = _FolderFile(folder, name, file_mode, rows.schema.with_metadata(footer), codec), n + 1
                file.add(rows.slice(first, length))
        if file:
            file.close()
            yield pa.record_batch([pa.array([attempt]), pa.array([n], pa.int64())], names=["attempt", "files"])

    return write


def _merge(source: bytes, target: bytes) -> None:
    """Moves what ``source`` holds into ``target``; what a repeated attempt of
    the task has moved already is passed over."""
    try:
        entries = list(os.scandir(source))
    except FileNotFoundError:
        return
    for e in entries:
        to = os.path.join(target, e.name)
        try:
            os.rename(e.path, to)
        except FileNotFoundError:
            if os.path.lexists(e.path):
                raise
        except OSError as error:
            if error.errno not in (errno.ENOTEMPTY, errno.EEXIST) or not e.is_dir(follow_symlinks=False):
                raise
            _merge(e.path, to)


def _moving(tmp: str, attempts: list[str], root: str):
    def move(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                _merge(os.path.join(tmp, attempts[i]).encode(), root.encode())
        yield from ()

    return move


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` where it lies on Hadoop's own local file system
    (also a mounted folder), else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.makeQualified(path).toUri()
    if fs.getClass().getName() not in LOCAL or found.getScheme() != "file":
        return None
    return found.getPath() if found.getPath().isascii() else None


def takes(df: DataFrame, keys: list[str], codec: str) -> bool:
    """Whether the rows are of plain types; others go through Spark's writer."""
    names = [f.name.lower() for f in df.schema.fields]
    return (codec in CODECS and set(keys) < set(df.columns) and len(set(names)) == len(names)
            and all(type(f.dataType) in PLAIN and (type(f.dataType) is not T.StringType or f.dataType == T.StringType()) for f in df.schema.fields)
            and all(type(f.dataType) is not T.BinaryType for f in df.schema.fields if f.name in keys))


def write_folders(df: DataFrame, root: str, folder: str, keys: list[str]) -> None:
    """Adds the rows of ``df`` to ``<key>=<value>/...`` folders under ``root``
    (``folder`` is its ``local_folder``), one file for each folder and
    partition of ``df`` that holds some of its rows."""
    spark = df.sparkSession
    ship_package(spark)
    jvm, conf, run = spark._jvm, spark._jsc.hadoopConfiguration(), str(uuid.uuid4())
    hadoop = jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(conf)
    name, allowed = f"_land-{run}", hadoop.permission.FsPermission
    tmp, scratch = hadoop.Path(root, name), os.path.join(folder, name)
    modes = tuple(p.applyUMask(allowed.getUMask(conf)).toShort() for p in (allowed.getFileDefault(), allowed.getDirDefault()))
    data = [f for f in df.schema.fields if f.name not in keys]
    footer = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": T.StructType(data).json()}
    text = [F.nullif(F.col(quote_name(k)).cast("string"), F.lit("")).alias(f"_land_key_{i}") for i, k in enumerate(keys)]
    # mapInArrow takes no names with dots
    rows = df.select(*[F.col(quote_name(f.name)).alias(f"_land_{i}") for i, f in enumerate(data)], *text)
    rows = rows.sortWithinPartitions(*[f"_land_key_{i}" for i in range(len(keys))])
    write = _writing(scratch, run, [f.name for f in data], keys, footer, spark.conf.get("spark.sql.parquet.compression.codec").lower(), modes,
                     jvm.System.getProperty("sun.jnu.encoding"))
    fs.mkdirs(tmp)
    try:
        attempts = [r["attempt"] for r in rows.mapInArrow(write, "attempt string, files long").collect()]  # one row a task
        if attempts:
            spark.range(0, len(attempts), 1, len(attempts)).mapInArrow(_moving(scratch, attempts, folder), "id long").collect()
    finally:
        fs.delete(tmp, True)
    if conf.getBoolean("mapreduce.fileoutputcommitter.marksuccessfuljobs", True):
        fs.create(hadoop.Path(root, "_SUCCESS"), True).close()
    spark.catalog.refreshByPath(root)
