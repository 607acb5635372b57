"""The landed layout as the executor-side writer makes it (``sources.landing``)."""

import os

import pytest

from palletwise.sources import landing, sinks
from tests.conftest import rows


def _started():
    """Processes and threads started on this machine so far."""
    with open("/proc/stat") as fh:
        return int(next(x for x in fh if x.startswith("processes")).split()[1])


def _tree(root):
    return {os.path.relpath(d, root) for d, _, names in os.walk(root) if any(x.endswith(".parquet") for x in names)}


def test_no_process_is_started_for_a_folder(spark, scratch):
    files = lambda n: spark.range(n).selectExpr("concat('f', id) AS nombre", "'csv' AS tipo", "cast(id AS string) AS user_id")
    sinks.land(files(10), os.path.join(scratch, "first"))  # starts the Python workers
    before = _started()
    sinks.land(files(1500), os.path.join(scratch, "landed"))
    assert _started() - before < 1500  # it was three a folder: folder, file, checksums
    assert len(_tree(os.path.join(scratch, "landed"))) == 1500


def test_folders_and_values_are_those_of_sparks_writer(spark, scratch):
    names = ["7", "007", "", None, " a b ", "ü€", "a/b", "x:y", "50%", "k=v", "..", "'q' \"q\"", "[1]", "{x}^", "a\\b", "\x01\t\n\x7f", "~!@$&()+,;<>|`}-_."]
    mine, theirs = os.path.join(scratch, "with space %41", "mine"), os.path.join(scratch, "theirs")
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, user_id string").selectExpr(
        "IF(i % 3 = 0, null, i) AS n", "i % 2 AS tipo", "user_id", "cast(i AS tinyint) AS b", "cast(i AS smallint) AS s", "cast(i AS int) AS d", "i / 3 AS x",
        "cast(i AS float) / 7 AS f", "i % 2 = 0 AS flag", "cast(i / 8 AS decimal(9, 3)) AS small", "cast(-i / 8 AS decimal(38, 6)) AS large",
        "cast(concat(user_id, '!') AS binary) AS bytes", "make_date(1500 + 40 * cast(i AS int), 2, 28) AS day",
        "make_timestamp(1500 + 40 * cast(i AS int), 2, 28, 1, 2, 3.456789) AS ts", "make_timestamp_ntz(1500 + 40 * cast(i AS int), 2, 28, 1, 2, 3.456789) AS ntz",
        "user_id AS `a.b`")
    sinks.land(df, mine)
    df.repartition(1).write.partitionBy("tipo", "user_id").parquet(theirs)
    assert _tree(mine) == _tree(theirs)
    assert sorted(os.listdir(mine)) == sorted(os.listdir(theirs))
    got, want = spark.read.parquet(mine), spark.read.parquet(theirs)
    assert got.schema == want.schema and rows(got) == rows(want)
    for folder, _, held in os.walk(mine):
        assert os.stat(folder).st_mode & 0o777 == 0o755
        assert all(os.stat(os.path.join(folder, x)).st_mode & 0o777 == 0o644 for x in held)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    assert all(landing.escape_name(chr(c)) == escape(chr(c)) for c in range(1, 300))


def test_rows_added_to_landed_folders(spark, scratch):
    root = os.path.join(scratch, "landed")
    for i in range(3):  # the second and third find folders there
        sinks.land(spark.range(40 * i, 40 * i + 40).selectExpr("id AS tamano", "'csv' AS tipo", "cast(id % 4 AS string) AS user_id"), root)
    sinks.land(spark.range(0).selectExpr("id AS tamano", "'csv' AS tipo", "'9' AS user_id"), root)
    back = sinks.read_landed(spark, root)
    assert rows(back, "tamano", "user_id") == sorted(((i, str(i % 4)) for i in range(120)), key=repr)
    assert len(back.inputFiles()) == 12 and sorted(os.listdir(root)) == ["._SUCCESS.crc", "_SUCCESS", "tipo=csv"]


def test_landed_files_have_checksums(spark, scratch):
    root = os.path.join(scratch, "landed")
    sinks.land(spark.range(3000, numPartitions=1).selectExpr("uuid() AS nombre", "'csv' AS tipo", "'7' AS user_id"), root)
    assert len({r[0] for r in sinks.read_landed(spark, root, "csv", "7").select("nombre").collect()}) == 3000
    folder = os.path.join(root, "tipo=csv", "user_id=7")
    name = next(x for x in os.listdir(folder) if x.endswith(".parquet"))
    with open(os.path.join(folder, name), "r+b") as fh:
        fh.seek(20_000)
        byte = fh.read(1)
        fh.seek(20_000)
        fh.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="[Cc]hecksum"):
        spark.read.parquet(root).collect()


def test_a_failed_landing_leaves_nothing(spark, scratch):
    root = os.path.join(scratch, "landed")
    df = spark.range(2000, numPartitions=4).selectExpr("IF(id = 1999, raise_error('broken row'), id) AS tamano", "'csv' AS tipo", "cast(id % 50 AS string) AS user_id")
    with pytest.raises(Exception, match="broken row"):
        sinks.land(df, root)
    assert not os.path.exists(root) or os.listdir(root) == []


def test_a_repeated_move_goes_on_where_the_first_ended(scratch):
    source, target = os.path.join(scratch, "a").encode(), os.path.join(scratch, "b").encode()
    for path in ("a/t=1/u=1/x", "a/t=1/u=2/x", "a/t=2/u=1/x", "b/t=1/u=1/y"):
        os.makedirs(os.path.join(scratch, os.path.dirname(path)), exist_ok=True)
        open(os.path.join(scratch, path), "w").close()
    os.rename(source + b"/t=1/u=1/x", target + b"/t=1/u=1/x")
    for _ in range(2):
        landing._merge(source, target)
    held = {os.path.relpath(os.path.join(d, n), target) for d, _, names in os.walk(target) for n in names}
    assert held == {b"t=1/u=1/x", b"t=1/u=1/y", b"t=1/u=2/x", b"t=2/u=1/x"}
    os.mkdir(source + b"/t=1/u=2")
    with open(source + b"/t=1/u=2/z", "w"):
        os.makedirs(target + b"/t=3")
    landing._merge(source + b"/t=1", target + b"/t=1")
    assert sorted(os.listdir(target + b"/t=1/u=2")) == [b"x", b"z"]


def test_large_folders_are_written_in_row_groups(scratch, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(landing, "ROW_GROUP_BYTES", 300_000)
    batch = pa.record_batch([pa.array([f"{i:0100d}" for i in range(1000)])], names=["nombre"])
    file = landing._FolderFile(scratch.encode(), b"part.parquet", 0o644, batch.schema, "snappy")
    for _ in range(10):
        file.add(batch)
    file.close()
    with open(os.path.join(scratch, "part.parquet"), "rb") as fh:
        found = pq.ParquetFile(fh)
        assert found.metadata.num_row_groups == 4 and found.read()["nombre"].to_pylist() == batch["nombre"].to_pylist() * 10


def test_other_types_and_modes_go_through_sparks_writer(spark, scratch):
    root = os.path.join(scratch, "landed")
    df = spark.range(4).selectExpr("map('a', id) AS m", "array(id) AS l", "'csv' AS tipo", "cast(id AS string) AS user_id")
    sinks.land(df, root)
    sinks.land(df.drop("m"), root, mode="overwrite")
    assert rows(spark.read.parquet(root).select("l")) == [([i],) for i in range(4)]
