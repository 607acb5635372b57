import datetime as dt

import pytest

from palletwise.operators import catalogue
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 5, 10, 0, 0)


def cat(spark):
    data = [
        (".keep", "csv", "u1", T0, 0), ("", "csv", "u1", T0, 0), ("50%_off.csv", "csv", "u1", T0 + dt.timedelta(minutes=1), 10),
        ("REPORT_a.PDF", "pdf", "u1", T0 + dt.timedelta(minutes=2), 20), ("report_b.xlsx", "xlsx", "u1", T0 + dt.timedelta(minutes=2), 30),
        ("other.csv", "csv", "u2", T0, 5), ("report_c.csv", "csv", "u1", T0 + dt.timedelta(minutes=3), 7),
    ]
    df = spark.createDataFrame(data, "nombre string, tipo string, user_id string, fecha_subida timestamp, tamano long")
    return df.withColumn("url", df.nombre)


def test_search_literal_and_case(spark):
    c = cat(spark)
    assert rows(catalogue.search_files(c, None, "REPORT", "u1"), "nombre") == [("REPORT_a.PDF",), ("report_b.xlsx",), ("report_c.csv",)]
    assert rows(catalogue.search_files(c, "csv", "%_", "u1"), "nombre") == [("50%_off.csv",)]
    assert rows(catalogue.search_files(c, "PDF", "", "u1"), "nombre") == [("REPORT_a.PDF",)]
    assert rows(catalogue.search_files(c, "weird", "_", "u1"), "nombre") == [
        ("50%_off.csv",), ("REPORT_a.PDF",), ("report_b.xlsx",), ("report_c.csv",)]


def test_list_files_pages(spark):
    page, info = catalogue.list_files(cat(spark), "u1", page=1, limit=2)
    assert [r["nombre"] for r in page.collect()] == ["report_c.csv", "REPORT_a.PDF"]  # tie: pdf before xlsx
    i = info.first()
    assert (i["total"], i["page"], i["limit"], i["pages"]) == (4, 1, 2, 2)
    page3, info3 = catalogue.list_files(cat(spark), "u1", page=3, limit=2)
    assert page3.count() == 0 and info3.first()["total"] == 4
    with pytest.raises(ValueError):
        catalogue.list_files(cat(spark), "u1", page=0)
    with pytest.raises(ValueError):
        catalogue.list_files(cat(spark), "")


def test_pages_per_user(spark):
    got = catalogue.pages_per_user(catalogue.search_files(cat(spark)), page=1, limit=2)
    assert rows(got, "user_id", "position", "nombre") == [
        ("u1", 1, "report_c.csv"), ("u1", 2, "REPORT_a.PDF"), ("u2", 1, "other.csv")]


def test_expired(spark):
    got = catalogue.expired_files(cat(spark), T0 + dt.timedelta(minutes=6))
    # exactly five minutes old is not expired yet (age must exceed the window)
    assert sorted(r["nombre"] for r in got.collect()) == ["", ".keep", "other.csv"]


def test_upload_manifest(spark):
    files = spark.createDataFrame([("A b.XLSX",), ("old.xls",), ("x.pdf",), ("",)], "filename string")
    m = catalogue.upload_manifest(files, "u1", now=dt.datetime(2024, 1, 5, 10, 0, 0, 123456))
    got = {r["filename"]: r for r in m.collect()}
    assert got["A b.XLSX"]["success"] and got["A b.XLSX"]["stored_name"] == "A_b_20240105_100000_123456.xlsx"
    assert got["A b.XLSX"]["destination_path"] == "xlsx/u1/A_b_20240105_100000_123456.xlsx"
    assert got["old.xls"]["success"]
    assert not got["x.pdf"]["success"] and "not allowed" in got["x.pdf"]["error"]
    assert not got[""]["success"] and got[""]["error"] == "empty file name"
    s = catalogue.manifest_summary(m).first()
    assert (s["total_files"], s["successful_uploads"], s["failed_uploads"]) == (4, 2, 2)


def test_keyset_pages_follow_offset_pages(spark):
    c = catalogue.search_files(cat(spark), user_id="u1")
    p1 = catalogue.page_after(c, None, 2).collect()
    last = (p1[-1]["fecha_subida"], p1[-1]["tipo"], p1[-1]["nombre"])
    p2 = catalogue.page_after(c, last, 2).collect()
    off = catalogue.page_of(c, 2, 2).collect()
    assert [r["nombre"] for r in p2] == [r["nombre"] for r in off]
