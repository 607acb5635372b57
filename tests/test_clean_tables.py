import pytest

from palletwise.operators import clean, tables
from tests.conftest import rows


def raw_reference(spark):
    data = [
        ("00123", "Atlas", 1), ("00123", "Atlas again", 2), ("", "x", 3), (None, "y", 4),
        ("9", None, 5), ("88", "d" * 600, 6), ("  7 ", "  Tale ", 7), ("7", "later", 8),
    ]
    return spark.createDataFrame(data, "` No. ` string, `Description` string, _pos long")


def test_clean_reference(spark):
    ref = clean.clean_reference(raw_reference(spark), "My Ref.csv")
    got = rows(ref)
    assert got == [("00123", "Atlas", "My_Ref.csv"), ("7", "Tale", "My_Ref.csv"), ("88", "d" * 500, "My_Ref.csv")]


def test_clean_reference_requires_columns(spark):
    df = spark.createDataFrame([("1",)], "number string")
    with pytest.raises(clean.MissingColumnsError) as e:
        clean.clean_reference(df.withColumn("_pos", df.number.cast("long")), "x.csv")
    assert "no." in e.value.missing


def test_normalise_headers_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`A ` int, `a` int")
    with pytest.raises(ValueError):
        clean.normalise_headers(df)


def test_resolve_id_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`number` int, `no.` int, `item_number` int")
    assert clean.resolve_id_column(df) == "no."
    assert clean.resolve_id_column(df, "file_order") == "number"


def test_dedupe_first_keeps_first_by_position(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 5), ("j", "z", 9), ("k", "c", 1)], "key string, v string, _pos long")
    assert rows(clean.dedupe_first(df.repartition(3), "key")) == [("j", "z", 9), ("k", "c", 1)]


def test_table_maintenance(spark):
    table = spark.createDataFrame([("1", "one"), ("2", "two")], "k string, v string")
    new = spark.createDataFrame([("2", "TWO"), ("3", "three"), ("3", "drei")], "k string, v string")
    appended, inserted = tables.append_if_absent(new, table, "k")
    assert rows(appended) == [("1", "one"), ("2", "two"), ("3", "drei")]
    assert rows(inserted) == [("3", "drei")]
    updated, unknown = tables.update_by_key(table, new.filter("k = '2' or k = '9'").union(
        spark.createDataFrame([("9", "nine")], "k string, v string")), "k")
    assert rows(updated) == [("1", "one", False), ("2", "TWO", True)]
    assert rows(unknown) == [("9",)]
    assert rows(tables.delete_by_keys(table, new, "k")) == [("1", "one")]
