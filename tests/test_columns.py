import pytest
from pyspark.sql import functions as F

from palletwise.functions import columns as C


def one(spark, expr, value, t="string"):
    df = spark.createDataFrame([(value,)], f"v {t}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("3", 3.0), (" 3 ", 3.0), ("2.9", 2.9), ("x", 0.0), (None, 0.0), ("1e3", 1000.0), (".5", 0.5),
    ("5.", 5.0), ("-5.5", -5.5), ("1d", 0.0), ("inf", 0.0), ("$5", 0.0), ("", 0.0), ("0x10", 0.0), ("1_000", 0.0),
])
def test_to_number(spark, text, expected):
    assert one(spark, C.to_number, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("12.5", 12.5), ("$12.99", 12.99), ("1,000", 1000.0), ("$ 7", 7.0), ("abc", 0.0), ("1d", 0.0),
    ("inf", 0.0), (None, 0.0),
])
def test_currency_to_number(spark, text, expected):
    assert one(spark, C.currency_to_number, text) == expected


def test_currency_strict_fails_on_bad_value(spark):
    assert one(spark, C.currency_strict, "$1,234.5") == 1234.5
    assert one(spark, C.currency_strict, None) is None
    with pytest.raises(Exception):
        one(spark, C.currency_strict, "abc")


@pytest.mark.parametrize("text,expected", [
    ("00123", "123"), ("123", "123"), ("9.78e12", "9780000000000"), ("12.7", "12"), ("-5.5", "-5"),
    (" 12 ", "12"), ("ABC", "ABC"), ("000", "0"), (None, "nan"), ("12345678901234567890", "12345678901234567890"),
    ("-007", "-7"), ("-0", "0"), ("+5", "5"), ("inf", "inf"), (" ABC ", " ABC "),
    ("1_000", "1000"), ("1__000", "1__000"), ("00_1", "1"), ("1_000.5", "1000"), ("_1", "_1"),
])
def test_format_item_id(spark, text, expected):
    assert one(spark, C.format_item_id, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("2024-01-05T10:00:00", "01/05/2024"), ("2024-1-5", "01/05/2024"), ("", "N/A"), (None, "N/A"),
    ("05/01/2024", "05/01/2024"), ("2024-01-05x", "2024-01-05x"),
])
def test_order_date(spark, text, expected):
    assert one(spark, C.format_order_date, text) == expected


@pytest.mark.parametrize("value,expected", [(1234.125, "$1,234.12"), (-5.0, "$-5.00"), (0.0, "$0.00"),
                                            (1234567.891, "$1,234,567.89")])
def test_money_text(spark, value, expected):
    assert one(spark, C.money_text, value, "double") == expected


def test_ascii_text_is_the_ascii_of_every_character(spark):
    import sys
    import unicodedata

    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    texts = ["a/" + "".join(map(chr, points[i : i + 64])) + "-z" for i in range(0, len(points), 64)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", C.ascii_text("v").alias("r")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == "".join(unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode() for ch in x), i


def test_scalars_are_worked_out_once(spark):
    """No translation tables of thousands of characters and no regular
    expression over them; number text is not split again for each use."""
    plan = lambda e: str(spark.createDataFrame([("x",)], "v string").select(e.alias("r"))._jdf.queryExecution().optimizedPlan().numberedTreeString())
    name = plan(C.safe_name("v"))
    assert "translate(" in name and "\u00c0" not in name and "RLIKE" not in name
    item = plan(C.format_item_id("v"))
    assert "split(" not in item and item.count("rpad(") == 1


@pytest.mark.parametrize("text,expected", [
    ("0.0005e4", "5"), ("-0.9", "0"), ("1.5E+3", "1500"), ("0e2000000000", "0"), ("1e-99999999999", "0"), ("1e999", "1e999"),
    ("000.000", "0"), ("0" * 900 + "12.5e1", "125"), ("." + "0" * 500 + "1e501", "1"), ("-" + "9" * 400, "-" + "9" * 400),
    ("9" * 400 + ".5", "9" * 400 + ".5"), ("12\u2028", "12\u2028"), ("+-5", "+-5"), (".", "."), ("e5", "e5"), ("", ""),
])
def test_format_item_id_odd_numbers(spark, text, expected):
    assert one(spark, C.format_item_id, text) == expected


def test_ellipsis(spark):
    assert one(spark, C.ellipsis, "a" * 40) == "a" * 40
    assert one(spark, C.ellipsis, "a" * 41) == "a" * 40 + "..."
    assert one(spark, C.ellipsis, None) == "nan"


@pytest.mark.parametrize("text,expected", [("00123", "123"), ("000", ""), ("0055", "55"), ("100", "100")])
def test_strip_zeros(spark, text, expected):
    assert one(spark, C.strip_zeros, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("A b.XLSX", "A_b.XLSX"), ("../../etc/passwd", "etc_passwd"), ("  My  file .csv", "My_file_.csv"),
    ("Año café.xlsx", "Ano_cafe.xlsx"), ("weird*name?.csv", "weirdname.csv"), ("._hidden_", "hidden"),
    ("Reference List (v2).csv", "Reference_List_v2.csv"),
])
def test_safe_name(spark, text, expected):
    assert one(spark, C.safe_name, text) == expected


@pytest.mark.parametrize("text,root,ext", [
    ("a.xlsx", "a", ".xlsx"), (".bashrc", ".bashrc", ""), ("a.b.c", "a.b", ".c"), ("noext", "noext", ""),
    ("..xlsx", "..xlsx", ""), (".x.xlsx", ".x", ".xlsx"), ("a.", "a", "."),
])
def test_split_ext_matches_os_path(spark, text, root, ext):
    import os

    assert os.path.splitext(text) == (root, ext)
    df = spark.createDataFrame([(text,)], "v string")
    r, e = C.split_ext(F.col("v"))
    got = df.select(r.alias("r"), e.alias("e")).first()
    assert (got["r"], got["e"]) == (root, ext)


@pytest.mark.parametrize("part,whole,expected", [(3, 4, 75.0), (0, 0, 0.0), (1, 3, 33.33), (2, 3, 66.67),
                                                 (1, 8, 12.5), (1, 800, 0.13)])
def test_percent_of(spark, part, whole, expected):
    df = spark.createDataFrame([(part, whole)], "p long, w long")
    assert df.select(C.percent_of("p", "w").alias("r")).first()["r"] == expected


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("x",), ("",), ("None",)], "v string")
    got = [r["r"] for r in df.select(C.null_tokens("v").alias("r")).collect()]
    assert got == [None, None, "x", None, None]


def test_file_parts(spark):
    df = spark.createDataFrame([("Report.Final.XLSX",), ("noext",)], "v string")
    got = [tuple(r["p"]) for r in df.select(C.file_parts("v").alias("p")).collect()]
    assert got == [("Report.Final", "xlsx"), ("noext", "noext")]


def test_exact_sum_of_large_and_small_values(spark):
    from palletwise.functions.columns import exact_sum

    df = spark.createDataFrame([(1e13,), (1e13,), (0.000001,)], "x double")
    assert df.agg(exact_sum("x").alias("s")).first().s == 20000000000000.000001


def test_currency_strict_rejects_number_suffixes(spark):
    import pytest

    from palletwise.functions.columns import currency_strict

    for bad in ("1d", "2f", "inf", "x"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            spark.createDataFrame([(bad,)], "p string").select(currency_strict("p")).collect()
    assert spark.createDataFrame([("$1,000.5",), (None,)], "p string").select(currency_strict("p").alias("v")).collect() == [(1000.5,), (None,)]
