from pyspark.sql import functions as F

from palletwise.operators import rollups
from tests.conftest import rows

INV_SCHEMA = "series_desc string, pallet_id string, item_id string, item_desc string, us_price string, quantity string, source_file string, _pos long"

SAMPLE = [
    (None, "P2", "00123", "Atlas", "$12.50", "2", "a.csv", 1),
    ("Maps", "P2", "123", "Atlas", "12.5", "x", "a.csv", 2),
    ("Novels", "P1", "ABC", "Story", "abc", "4", "b.csv", 3),
    ("Novels", None, "7", "Tale", "3", "1", "b.csv", 4),
]


def test_pallet_rollup_fixture(spark):
    df = spark.createDataFrame(SAMPLE, INV_SCHEMA)
    got = rows(rollups.pallet_rollup(df, 20), "pallet_id", "series_desc", "quantity", "extended_percent")
    assert got == [("P1", "Novels", 4.0, 0.0), ("P2", "Maps", 2.0, 5.0)]


def test_pallet_rollup_without_currency_strip(spark):
    df = spark.createDataFrame(SAMPLE, INV_SCHEMA)
    got = rows(rollups.pallet_rollup(df, 20, strip_currency=False), "pallet_id", "series_desc", "quantity", "extended_percent")
    assert got == [("P1", "Novels", 4.0, 0.0), ("P2", "Maps", 2.0, 0.0)]


def test_first_description_follows_row_order_not_partitioning(spark):
    data = [("d%03d" % i if i % 3 else None, "P", "1", "x", "1", "1", "f", 1000 - i) for i in range(300)]
    df = spark.createDataFrame(data, INV_SCHEMA).repartition(7)
    got = rollups.pallet_rollup(df, 100).first()
    # smallest position with a description: i=299 -> pos 701, desc d299
    assert got["series_desc"] == "d299"
    assert got["quantity"] == 300.0


def test_item_rollup_fixture(spark):
    df = spark.createDataFrame(SAMPLE, INV_SCHEMA)
    got = rows(rollups.item_rollup(df), "item_id", "item_desc", "quantity")
    assert got == [("123", "Atlas", 2.0), ("7", "Tale", 1.0), ("ABC", "Story", 4.0)]


def test_item_rollup_uses_series_desc_when_item_desc_absent(spark):
    df = spark.createDataFrame([("S", "1", "2", 1.5)], "series_desc string, item_id string, quantity string, `Extended Retail` double")
    out = rollups.item_rollup(df)
    assert out.columns == ["item_id", "item_desc", "quantity"]
    assert rows(out) == [("1", "S", 2.0)]


def test_po_lines_totals_and_pages(spark):
    n = 24  # one more than a page
    data = [("desc %d" % i + "x" * 40, "P%03d" % i, "1", "d", "$1,000.10", "2.9", "f", i) for i in range(n)]
    df = spark.createDataFrame(data, INV_SCHEMA)
    lines = rollups.po_lines(rollups.pallet_rollup(df, 50))
    got = lines.orderBy(F.col("line_no").asc_nulls_last()).collect()
    assert [r["line_no"] for r in got[:-1]] == list(range(1, n + 1))
    assert [r["page"] for r in got[:-1]] == [1] * 23 + [2]
    assert all(r["pages"] == 2 for r in got)
    first = got[0]
    assert first["description"].endswith("...") and len(first["description"]) == 43
    assert first["ordered"] == 2 and first["ext_price"] == "$1,450.14"
    total = got[-1]
    assert total["description"] == "TOTAL:" and total["line_no"] is None
    assert total["ordered"] == int(2.9 * n) and total["page"] == 2
    assert total["page_label"] == "Page 2 of 2"


def test_po_lines_empty_input(spark):
    df = spark.createDataFrame([], INV_SCHEMA)
    got = rollups.po_lines(rollups.pallet_rollup(df, 20)).collect()
    assert len(got) == 1 and got[0]["description"] == "TOTAL:" and got[0]["ext_price"] == "$0.00"
    assert got[0]["pages"] == 1


def test_number_lines_bucketed_equals_global_window(spark):
    keys = ["k%05d" % ((i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long")
    small, n1 = rollups.number_lines(df, "k", rows_per_bucket=10_000_000)
    big, n2 = rollups.number_lines(df, "k", rows_per_bucket=300)
    assert n1 == n2 == 5000
    a = rows(small, "k", "line_no")
    b = rows(big, "k", "line_no")
    assert a == b
    assert sorted(x[1] for x in b) == list(range(1, 5001))


def test_number_lines_bucketed_with_ties_and_nulls(spark):
    data = [(None if i % 97 == 0 else "k%02d" % (i % 40), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v long")
    a, _ = rollups.number_lines(df, "k", rows_per_bucket=10_000_000)
    b, _ = rollups.number_lines(df, "k", rows_per_bucket=200)
    assert rows(a, "k", "v", "line_no") == rows(b, "k", "v", "line_no")


def test_po_header_defaults(spark):
    h = rollups.po_header(spark, {"order_date": "2024-1-5", "seller_name": "ACME"}, report_defaults=True).first()
    assert h["order_date"] == "01/05/2024" and h["seller_name"] == "ACME"
    assert h["purchase_info"] == "N/A" and h["company_name"] == ""
    h2 = rollups.po_header(spark, {}).first()
    assert h2["purchase_info"] == "" and h2["order_date"] == "N/A"


def test_recommended_conf_scales_with_input():
    from palletwise.session import recommended_conf

    small = recommended_conf(10 << 20, 8)
    big = recommended_conf(100 << 40, 8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(big["spark.sql.shuffle.partitions"]) == 64000
    assert big["spark.sql.adaptive.enabled"] == "true"


def test_po_lines_exactly_one_full_page(spark):
    data = [("d", "P%02d" % i, "1", "d", "1", "1", "f", i) for i in range(23)]
    lines = rollups.po_lines(rollups.pallet_rollup(spark.createDataFrame(data, INV_SCHEMA), 100)).collect()
    assert {r["pages"] for r in lines} == {1} and {r["page"] for r in lines} == {1}
    assert max(r["line_no"] or 0 for r in lines) == 23


def test_number_lines_of_one_large_group_of_equal_rows(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id END AS k", "'x' AS `a.b`")
    got, n = rollups.number_lines(df, "k", rows_per_bucket=100)
    assert n == 3000 and got.columns == ["k", "a.b", "line_no"]
    lines = got.orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == list(range(1, 3001))
    assert [r["k"] for r in lines] == sorted(r["k"] for r in lines)


def test_number_lines_of_an_empty_table(spark):
    got, n = rollups.number_lines(spark.createDataFrame([], "k string"), "k")
    assert n == 0 and got.collect() == []
