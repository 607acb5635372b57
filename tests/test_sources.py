import os

from palletwise.sources import files as src
from palletwise.sources import sinks
from palletwise.sources.workbook import write_xlsx
from tests.conftest import rows


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_different_layouts_never_move_values(spark, scratch):
    write(os.path.join(scratch, "a.csv"), "item_id,quantity\n1,10\n2,20\n")
    write(os.path.join(scratch, "b.csv"), " Quantity ;ITEM_ID;extra\n30;3;x\nNA;4;\n")
    write(os.path.join(scratch, "c.txt"), "ignored\n")
    with open(os.path.join(scratch, "d.xlsx"), "wb") as fh:
        fh.write(b"not a zip")
    write_xlsx(os.path.join(scratch, "e.xlsx"), [["item_id", "quantity", "note"], [5, 50, "n/a"], ["006", 60.5, "ok"]])
    df, manifest = src.read_tabular(spark, scratch)
    assert set(df.columns) >= {"item_id", "quantity", "extra", "note", "source_file", "_pos"}
    got = rows(df, "source_file", "item_id", "quantity", "extra", "note")
    assert got == [
        ("a.csv", "1", "10", None, None), ("a.csv", "2", "20", None, None),
        ("b.csv", "3", "30", "x", None), ("b.csv", "4", None, None, None),
        ("e.xlsx", "006", "60.5", None, "ok"), ("e.xlsx", "5", "50", None, None),
    ]
    m = {r["source_file"]: (r["success"], r["error"]) for r in manifest.collect()}
    assert m["a.csv"] == (True, None) and m["b.csv"] == (True, None) and m["e.xlsx"][0]
    assert m["c.txt"] == (False, "unsupported format")
    assert m["d.xlsx"][0] is False and "zip" in m["d.xlsx"][1].lower()


def test_sniff_rules():
    assert src.sniff_head(b"a;b,c\n1;2\n")[0] == ","
    assert src.sniff_head(b"a;b\n1;2\n")[:2] == (";", ["a", "b"])
    assert src.sniff_head(b"")[2] == "empty file"
    assert src.sniff_head(b'"Item Id",x\n')[1] == ["item id", "x"]
    assert "duplicate" in src.sniff_head(b"A,a\n")[2]


def test_position_orders_rows_within_file(spark, scratch):
    lines = "\n".join(f"{i},{i}" for i in range(2000))
    write(os.path.join(scratch, "big.csv"), "item_id,quantity\n" + lines + "\n")
    df, _ = src.read_delimited_auto(spark, scratch)
    ordered = [r["item_id"] for r in df.orderBy("_pos").select("item_id").collect()]
    assert ordered == [str(i) for i in range(2000)]


def test_versioned_replace(spark, scratch):
    root = os.path.join(scratch, "item_reference")
    sinks.replace_table(spark.createDataFrame([("1", "a")], "item_number string, description string"), root)
    t = sinks.read_table(spark, root)
    assert rows(t) == [("1", "a")]
    # replace from a query that reads the table itself
    sinks.replace_table(t.union(spark.createDataFrame([("2", "b")], "item_number string, description string")), root)
    assert rows(sinks.read_table(spark, root)) == [("1", "a"), ("2", "b")]
    sinks.replace_table(spark.createDataFrame([], "item_number string, description string"), root)
    assert sinks.read_table(spark, root).count() == 0
    assert sinks.read_table(spark, root, ["item_number"]).columns == ["item_number"]


def test_append_rows_counts(spark, scratch):
    path = os.path.join(scratch, "t")
    n = sinks.append_rows(spark.range(5).toDF("id"), path)
    n2 = sinks.append_rows(spark.range(3).toDF("id"), path)
    assert (n, n2) == (5, 3) and spark.read.parquet(path).count() == 8


def test_catalogue_listing(spark, scratch):
    from palletwise.operators.catalogue import catalogue_from_listing

    for t, u, name in [("csv", "u1", "a.csv"), ("pdf", "u1", "b.pdf"), ("xlsx", "u2", "c.xlsx")]:
        os.makedirs(os.path.join(scratch, t, u), exist_ok=True)
        write(os.path.join(scratch, t, u, name), "x" * 7)
    cat = catalogue_from_listing(src.list_files(spark, scratch))
    assert rows(cat, "tipo", "user_id", "nombre", "tamano") == [
        ("csv", "u1", "a.csv", 7), ("pdf", "u1", "b.pdf", 7), ("xlsx", "u2", "c.xlsx", 7)]


def test_land_partitioned_layout(spark, scratch):
    df = spark.createDataFrame([("a.csv", "csv", "u1"), ("b.pdf", "pdf", "u2")], "nombre string, tipo string, user_id string")
    root = os.path.join(scratch, "landed")
    sinks.land(df, root)
    assert os.path.isdir(os.path.join(root, "tipo=csv", "user_id=u1"))
    back = spark.read.parquet(root).filter("tipo = 'pdf'")
    assert rows(back, "nombre", "user_id") == [("b.pdf", "u2")]


def test_quoted_newlines_and_bad_rows(spark, scratch):
    write(os.path.join(scratch, "q.csv"), 'item_id,item_desc\n1,"two\nlines"\n2,plain\n')
    write(os.path.join(scratch, "r.csv"), "item_id,quantity\n1,2\n3,4,5\n6\n")
    df, manifest = src.read_delimited_auto(spark, scratch)
    got = rows(df.select("source_file", "item_id", "item_desc").filter("source_file = 'q.csv'"))
    assert got == [("q.csv", "1", "two\nlines"), ("q.csv", "2", "plain")]
    bad = rows(src.bad_rows(df), "source_file", "extra")
    assert bad == [("r.csv", "5")]
    good = rows(df.filter("source_file = 'r.csv'").select("item_id", "quantity"))
    assert ("1", "2") in good


def test_workbook_dates(spark, scratch):
    import datetime as dt

    data = [["Item_ID", "Pub_Date", "Quantity"]] + [[f"{i:05d}", dt.datetime(2024, 1, 1 + i % 28, 8, 0), i] for i in range(30)]
    write_xlsx(os.path.join(scratch, "w.xlsx"), data)
    df, manifest = src.read_workbooks(spark, scratch)
    got = rows(df, "item_id", "pub_date", "quantity")
    assert len(got) == 30
    assert got[0] == ("00000", "2024-01-01 08:00:00", "0")
    assert got[29] == ("00029", "2024-01-02 08:00:00", "29")
    assert [r["row"] for r in df.orderBy("_pos").select("_pos.row").collect()] == list(range(1, 31))


def test_workbook_chunks_keep_row_order():
    import datetime as dt

    import pandas as pd

    from palletwise.sources import workbook

    path = os.path.join(__import__("tempfile").mkdtemp(dir="/tmp"), "c.xlsx")
    write_xlsx(path, [["a"]] + [[i] for i in range(50)])
    old = workbook.CHUNK_ROWS
    workbook.CHUNK_ROWS = 7
    try:
        frames = list(workbook.parse_workbooks([pd.DataFrame({"path": [path], "content": [open(path, "rb").read()]})]))
    finally:
        workbook.CHUNK_ROWS = old
    assert len(frames) == 8
    allrows = pd.concat(frames)
    assert list(allrows["row_idx"]) == list(range(51))
    assert allrows["values"].iloc[-1] == ["49"]


def test_workbooks_with_equivalent_headers_share_a_layout(spark, scratch):
    write_xlsx(os.path.join(scratch, "a.xlsx"), [["Item_ID", "Qty"], ["1", 2]])
    write_xlsx(os.path.join(scratch, "b.xlsx"), [[" item_id ", "QTY"], ["3", 4]])
    df, _ = src.read_workbooks(spark, scratch)
    assert rows(df, "source_file", "item_id", "qty") == [("a.xlsx", "1", "2"), ("b.xlsx", "3", "4")]


def test_wide_header_beyond_sample(spark, scratch):
    cols = [f"column_{i:04d}_" + "x" * 40 for i in range(1500)]  # ~70 KB header row
    write(os.path.join(scratch, "wide.csv"), ",".join(cols) + "\n" + ",".join(str(i) for i in range(1500)) + "\n")
    df, manifest = src.read_delimited_auto(spark, scratch)
    assert manifest.first()["success"]
    r = df.select(cols[0], cols[-1]).first()
    assert (r[0], r[1]) == ("0", "1499")


def test_data_that_no_version_names_is_not_read(spark, scratch):
    root = os.path.join(scratch, "t")
    sinks.replace_table(spark.createDataFrame([("1",)], "k string"), root)
    assert sinks.replace_table(spark.createDataFrame([("2",)], "k string"), root) == 2
    # as a writer leaves it that was lost before its commit
    spark.createDataFrame([("3",)], "k string").write.parquet(os.path.join(root, "data-lost"))
    assert rows(sinks.read_table(spark, root)) == [("2",)]


def test_of_two_writers_one_fails_and_tries_again(spark, scratch):
    import pytest

    root = os.path.join(scratch, "t")
    table = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    start = sinks.replace_table(table("a"), root)
    assert sinks.replace_table(table("a", "b"), root, based_on=start) == 2
    with pytest.raises(sinks.ConflictError):
        sinks.replace_table(table("a", "c"), root, based_on=start)
    with pytest.raises(sinks.ConflictError):
        sinks.replace_slice(table("z"), root, "k", "z", based_on=start)
    assert rows(sinks.read_table(spark, root)) == [("a",), ("b",)]
    calls = []

    def add(current):
        calls.append(current.count())
        if len(calls) == 1:  # another writer commits in between
            sinks.replace_table(current.union(table("other")), root)
        return current.union(table("mine"))

    sinks.change_table(spark, root, add)
    assert calls == [2, 3] and rows(sinks.read_table(spark, root)) == [("a",), ("b",), ("mine",), ("other",)]
    with pytest.raises(sinks.ConflictError):
        sinks.change_table(spark, root, lambda t: (sinks.replace_table(table("x"), root), table("y"))[1], attempts=2)


def test_slices_leave_other_files_alone(spark, scratch):
    root = os.path.join(scratch, "t")
    mixed = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", None)], "k string, user_id string")
    sinks.replace_table(mixed, root)
    for u in ("u1", "u4"):
        sinks.replace_slice(spark.createDataFrame([("9" + u, u)], "k string, user_id string"), root, "user_id", u)
    holding = lambda: {r[0] for r in sinks.read_table(spark, root).filter("user_id IS NULL OR user_id <> 'u4'").select("_metadata.file_path").collect()}
    before = holding()
    sinks.replace_slice(spark.createDataFrame([], "k string, user_id string"), root, "user_id", "u4")
    assert rows(sinks.read_table(spark, root)) == [("2", "u2"), ("3", None), ("9u1", "u1")]
    assert holding() == before and len(before) >= 2


def test_landed_rows_are_pruned(spark, scratch):
    root = os.path.join(scratch, "landed")
    sinks.land(spark.createDataFrame([("a", "csv", "007"), ("b", "csv", "2"), ("c", "pdf", "007")], "nombre string, tipo string, user_id string"), root)
    one = sinks.read_landed(spark, root, "csv", "007")
    assert rows(one) == [("a", "csv", "007")]
    assert "PartitionFilters: [isnotnull(tipo" in one._jdf.queryExecution().executedPlan().toString()


def test_landed_folders_hold_one_file_each(spark, scratch, monkeypatch):
    root = os.path.join(scratch, "landed")
    df = spark.range(4000, numPartitions=16).selectExpr(
        "concat('f', id) AS nombre", "'csv' AS tipo", "IF(id % 2 = 0, 'big', IF(id % 100 = 1, null, concat('u:', id % 10))) AS user_id", "id AS tamano")
    monkeypatch.setattr(sinks, "LAND_ROWS", 500)
    sinks.land(df, root)
    held = {u: [x for x in os.listdir(os.path.join(root, "tipo=csv", u)) if x.endswith(".parquet")] for u in os.listdir(os.path.join(root, "tipo=csv"))}
    assert len(held) == 7 and all(len(x) == 1 for u, x in held.items() if u != "user_id=big")
    assert 2 <= len(held["user_id=big"]) <= 4  # 2,000 rows, 500 a task
    assert rows(sinks.read_landed(spark, root), "nombre", "tipo", "user_id", "tamano") == rows(df)
    for user in ("big", "u:3", "none"):
        want = df.filter(f"user_id = '{user}'")
        assert rows(sinks.read_landed(spark, root, "csv", user), "nombre", "tipo", "user_id", "tamano") == rows(want)


def test_landed_folder_is_read_without_listing_the_others(spark, scratch):
    root = os.path.join(scratch, "landed")
    sinks.land(spark.createDataFrame([("a", "csv", "7"), ("b", "csv", "8")], "nombre string, tipo string, user_id string"), root)
    one = sinks.read_landed(spark, root, "csv", "7")
    assert rows(one) == [("a", "csv", "7")]
    assert [f.rsplit("/", 2)[-2] for f in one._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).relation().location().inputFiles()] == ["user_id=7"]


def test_workbooks_are_written_row_by_row(spark, scratch, monkeypatch):
    import tracemalloc

    from palletwise.plans import registry, views
    from tests.conftest import SF_SMALL

    tracemalloc.start()
    write_xlsx(os.path.join(scratch, "long.xlsx"), ([str(i), "x" * 100] for i in range(20_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20  # the rows are over 2 MB
    monkeypatch.setattr(registry, "WORKBOOK_ROWS", 50)
    files = src.list_files(spark, registry._export_workbooks(spark, SF_SMALL))
    n = views.inventory(spark, SF_SMALL).count()
    assert files.count() >= n / 50
    assert registry.files_workbook_rollup(spark, SF_SMALL).selectExpr("sum(quantity)").first() == registry.item_rollup(
        spark, SF_SMALL).selectExpr("sum(quantity)").first()


def test_built_uploads_need_no_task_with_all_rows(spark, scratch, monkeypatch):
    from palletwise.plans import registry
    from tests.conftest import SF_SMALL

    read = []
    monkeypatch.setattr(registry.files, "read_delimited_auto", lambda spark, paths, **k: (read.extend(paths), None)[1:] + (None,))
    registry.files_multiline(spark, SF_SMALL)
    bad = [x["path"][5:] for x in src.list_files(spark, [p for p in read if p.endswith("/bad")]).collect()]
    assert len(bad) > 1
    for path in bad:
        lines = open(path, "rb").read().splitlines()
        assert lines[0] == b"item_id,item_desc,quantity" and lines[-1] == b"1,bad,\xff" and lines.count(lines[0]) == 1
    # one upload is written from packed columns: its writer reads less than the file holds
    df = spark.range(100_000).selectExpr("cast(id % 100 AS string) AS item_id", "repeat(cast(id % 7 AS string), 50) AS item_desc")
    registry._as_file(spark, df, os.path.join(scratch, "up", "one.csv"))
    packed = max((p for p in os.scandir(registry.scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0])
                  if p.name.startswith("upload-rows-")), key=lambda p: p.stat().st_mtime)
    size = sum(x.stat().st_size for x in os.scandir(packed.path))
    assert size < os.path.getsize(os.path.join(scratch, "up", "one.csv")) / 5
    assert spark.read.csv(os.path.join(scratch, "up", "one.csv"), header=True).count() == 100_000


def test_file_catalogue(spark, scratch):
    for t, u, name in [("csv", "u1", "a.csv"), ("pdf", "u2", "b.pdf")]:
        os.makedirs(os.path.join(scratch, t, u), exist_ok=True)
        write(os.path.join(scratch, t, u, name), "xyz")
    assert rows(src.file_catalogue(spark, scratch), "tipo", "user_id", "nombre", "tamano") == [
        ("csv", "u1", "a.csv", 3), ("pdf", "u2", "b.pdf", 3)]


def test_workbook_with_colliding_headers_is_reported(spark, scratch):
    write_xlsx(os.path.join(scratch, "dup.xlsx"), [["A", "a "], ["1", "2"]])
    write_xlsx(os.path.join(scratch, "ok.xlsx"), [["a", "", "b"], ["1", "x", "2"]])
    df, manifest = src.read_workbooks(spark, scratch)
    m = {r["source_file"]: (r["success"], r["error"]) for r in manifest.collect()}
    assert m["dup.xlsx"] == (False, "duplicate columns") and m["ok.xlsx"] == (True, None)
    assert rows(df, "a", "unnamed: 1", "b") == [("1", "x", "2")]


def test_oversized_workbook_is_reported(spark, scratch):
    write_xlsx(os.path.join(scratch, "small.xlsx"), [["a"], ["1"]])
    write_xlsx(os.path.join(scratch, "big.xlsx"), [["a"]] + [[str(i)] for i in range(5000)])
    df, manifest = src.read_workbooks(spark, scratch, max_bytes=4000)
    m = {r["source_file"]: (r["success"], r["error"]) for r in manifest.collect()}
    assert m["small.xlsx"] == (True, None)
    assert m["big.xlsx"][0] is False and "larger than" in m["big.xlsx"][1]
    assert rows(df, "a") == [("1",)]


def _shared_string_workbook(main_ns: str, rel_ns: str) -> bytes:
    import io
    import zipfile

    sst = (f'<sst xmlns="{main_ns}" count="3" uniqueCount="3"><si><t>item_id</t></si>'
           '<si><r><t>Desc</t></r><r><t>ription</t></r></si><si><t xml:space="preserve">00123</t></si></sst>')
    sheet = (f'<worksheet xmlns="{main_ns}"><sheetData>'
             '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
             '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="str"><v>=A2</v></c></row>'
             '<row r="4"><c r="B4" t="b"><v>1</v></c></row>'
             '</sheetData></worksheet>')
    wb = (f'<workbook xmlns="{main_ns}" xmlns:r="{rel_ns}"><sheets>'
          '<sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Type="x" Target="/xl/worksheets/data.xml"/></Relationships>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("xl/worksheets/data.xml", sheet)
    return buf.getvalue()


def test_shared_strings_and_namespaces():
    from palletwise.sources.workbook import iter_rows

    expected = [["item_id", "Description"], ["00123", "=A2"], [None, "True"]]
    transitional = _shared_string_workbook("http://schemas.openxmlformats.org/spreadsheetml/2006/main",
                                           "http://schemas.openxmlformats.org/officeDocument/2006/relationships")
    strict = _shared_string_workbook("http://purl.oclc.org/ooxml/spreadsheetml/main",
                                     "http://purl.oclc.org/ooxml/officeDocument/relationships")
    assert list(iter_rows(transitional)) == expected
    assert list(iter_rows(strict)) == expected


def test_whole_files_are_checked(spark, scratch):
    plain = "".join(f"{i},plain text\n" for i in range(9000))  # more than the first 64 KB
    write(os.path.join(scratch, "late.csv"), "item_id,quantity\n" + plain + '9000,"two\nlines"\n9001,"a, b"\n')
    with open(os.path.join(scratch, "bytes.csv"), "wb") as fh:
        fh.write(("item_id,bytes\n" + plain).encode() + b"1,\xff\xfe\n")
    write(os.path.join(scratch, "long.csv"), "item_id,q\n1,2,3,4,5\n6,7\n8,9,,10\n11,12,,\n")
    df, manifest = src.read_delimited_auto(spark, scratch)
    m = {r["source_file"]: (r["success"], r["error"]) for r in manifest.collect()}
    assert m["late.csv"] == (True, None) and m["long.csv"] == (True, None)
    assert m["bytes.csv"][0] is False and "UTF-8" in m["bytes.csv"][1]
    late = df.filter("source_file = 'late.csv'")
    assert late.count() == 9002
    assert rows(late.filter("item_id >= 9000"), "item_id", "quantity") == [("9000", "two\nlines"), ("9001", "a, b")]
    bad = {r["item_id"]: r["_extra"] for r in df.filter("_extra is not null").collect()}
    assert bad == {"1": ["3", "4", "5"], "8": [None, "10"]}
    assert sorted(r["extras"][-1] for r in src.bad_rows(df).collect()) == ["10", "5"]


def test_header_row_beyond_16_mb(scratch):
    path = os.path.join(scratch, "w.csv")
    write(path, "a," + "x" * (17 << 20) + "\n1,2\n")
    with open(path, "rb") as fh:
        assert src.sniff_stream(fh)[1] == ["a", "x" * (17 << 20)]


def test_large_workbooks_are_opened_by_path(spark, scratch, monkeypatch):
    write_xlsx(os.path.join(scratch, "small.xlsx"), [["a"], ["1"]])
    write_xlsx(os.path.join(scratch, "big.xlsx"), [["a"]] + [[str(i)] for i in range(5000)])
    monkeypatch.setattr(src, "ROW_WORKBOOK_BYTES", 4000)
    df, manifest = src.read_workbooks(spark, scratch)
    assert df.count() == 5001 and all(r["success"] for r in manifest.collect())


def test_heads_with_quoted_breaks():
    assert src.sniff_head('\ufeff"Item\r\nid",qty\n1,2\n'.encode()) == (",", ["item\r\nid", "qty"], None)
    long = "x" * 3000
    assert src.sniff_head(f'"{long}\n{long}";b;"c""d"\n1;2\n'.encode())[1] == [f"{long}\n{long}", "b", 'c"d']
    assert src.sniff_head(b'\n  \na,5" pipe\n')[1] == ["a", '5" pipe']


def test_open_quotes(spark):
    cases = {'a,"b': True, 'a,"b"': False, 'a,5" pipe': False, 'a,"b""': True, 'a,"b"""': False, '""': False, '"""': True, 'a,"b"x"y': False,
             '"a,b",c': False, 'x,"' + '""' * 20000 + 'y': True, 'x,"' + '""' * 20000 + 'y"': False, "plain": False, '"a";"b': False}
    got = spark.createDataFrame([(k,) for k in cases], "line string").select("line", src.ends_open(src.F.col("line"), ",").alias("o")).collect()
    assert {r["line"]: r["o"] for r in got} == cases


def test_states_compose_over_splits(spark):
    import random

    rng = random.Random(3)
    files, steps = {}, []
    for f in range(40):
        state = False
        for row in range(rng.randint(1, 12)):
            f0, f1 = rng.choice([(False, True), (True, False), (False, False), (True, True)])
            steps.append((f"f{f}", row // 3, row, f0, f1))
            state = f1 if state else f0
        files[f"f{f}"] = state
    table = spark.createDataFrame(steps, "path string, block int, row int, f0 boolean, f1 boolean")
    whole = src.composed(src.composed(table, ["path", "block"], "row"), ["path"], "block")
    assert {r["path"]: r["f0"] for r in whole.collect()} == files


def test_small_splits_find_late_breaks(spark, scratch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        plain = "".join(f'{i},"a ""{i}"", b"\n' for i in range(6000))
        write(os.path.join(scratch, "late.csv"), "id,d\n" + plain + '6000,"two\nlines, ""x"""\n' + plain)
        write(os.path.join(scratch, "open.csv"), "id,d\n" + plain + '6000,"two\n' + plain.replace('"', ""))
        write(os.path.join(scratch, "stray.csv"), "id,d\n" + plain + '6000,5" pipe\n6001,"x"y"\n')
        df, manifest = src.read_delimited_auto(spark, scratch)
        m = {r["source_file"]: r["error"] for r in manifest.collect()}
        assert m == {"late.csv": None, "open.csv": "quoted field never closed", "stray.csv": None}
        got = {r["source_file"]: r["count"] for r in df.groupBy("source_file").count().collect()}
        assert got == {"late.csv": 12001, "stray.csv": 6002}
        assert rows(df.filter("id = 6000"), "source_file", "d") == [("late.csv", 'two\nlines, "x"'), ("stray.csv", '5" pipe')]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names_are_literal_and_hidden_names_reported(spark, scratch):
    for name in ["list[1].csv", "b c+d%20.csv", "{x}.csv", "_list.csv", "_SUCCESS", ".part.csv"]:
        write(os.path.join(scratch, name), "id,q\n1,2\n")
    write(os.path.join(scratch, "none.csv"), "")
    for folder in ("u1", "u2"):
        os.makedirs(os.path.join(scratch, folder))
        write(os.path.join(scratch, folder, "list.csv"), f"id,q\n{folder},2,x\n")
    df, manifest = src.read_tabular(spark, scratch)
    m = {r["path"][len("file:") + len(scratch) + 1 :]: r["error"] for r in manifest.collect()}
    assert m == {"list[1].csv": None, "b c+d%20.csv": None, "{x}.csv": None, "_list.csv": "hidden name", "none.csv": "empty file", "u1/list.csv": None, "u2/list.csv": None}
    assert sorted(r["source_file"] for r in df.collect()) == ["b c+d%20.csv", "list.csv", "list.csv", "list[1].csv", "{x}.csv"]
    assert len({r["_pos"]["file"] for r in df.collect()}) == 5
    assert sorted(r["_pos"]["file"][-11:] for r in src.bad_rows(df).collect()) == ["u1/list.csv", "u2/list.csv"]
    one, _ = src.read_tabular(spark, os.path.join(scratch, "list[1].csv"))
    assert one.count() == 1
