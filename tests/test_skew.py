"""A key holding a third of all rows must give whole, correct results."""

from pyspark.sql import functions as F

from palletwise.operators import catalogue, clean, compare, rollups, tables


N = 30_000


def skewed_inventory(spark):
    # pallet HOT and item 42 hold a third of the rows each
    df = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("P"), (F.col("id") % 997).cast("string"))).alias("pallet_id"),
        F.when(F.col("id") % 3 == 1, F.lit("42")).otherwise((F.col("id") % 101).cast("string")).alias("item_id"),
        F.lit("desc").alias("item_desc"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("series_desc"),
        F.lit("$2.50").alias("us_price"),
        F.lit("2").alias("quantity"),
        F.concat(F.lit("f"), (F.col("id") % 13).cast("string"), F.lit(".csv")).alias("source_file"),
        F.col("id").alias("_pos"),
    )
    return df.repartition(16)


def test_hot_pallet(spark):
    df = skewed_inventory(spark)
    got = {r["pallet_id"]: r for r in rollups.pallet_rollup(df, 50).collect()}
    hot = got["HOT"]
    assert hot["quantity"] == 2.0 * (N // 3)
    assert hot["extended_percent"] == 2.5 * (N // 3)
    assert hot["series_desc"] == "s3"  # id 0 has no description (0 % 7 == 0)
    assert sum(r["quantity"] for r in got.values()) == 2.0 * N


def test_hot_item_comparison(spark):
    df = skewed_inventory(spark)
    items = compare.distinct_items(df)
    ref = spark.createDataFrame([("0042",), ("7",)], "item_number string")
    s = compare.comparison_summary(items, ref).first()
    assert s["total_processed_items"] == 101  # ids 0..100 (42 included)
    assert s["exact_matches"] == 1 and s["normalized_matches"] == 2
    files = {r["item_id"]: r["source_files"] for r in compare.item_files(items).collect()}
    assert len(files["42"]) == 13


def test_hot_key_dedupe_and_rollup(spark):
    df = skewed_inventory(spark)
    first = clean.dedupe_first(df.select("item_id", "series_desc", "_pos"), "item_id")
    assert {r["item_id"]: r["_pos"] for r in first.collect()}["42"] == 1
    items = {r["item_id"]: r["quantity"] for r in rollups.item_rollup(df).collect()}
    hot_rows = sum(1 for i in range(N) if i % 3 == 1 or i % 101 == 42)
    assert items["42"] == 2.0 * hot_rows


def test_hot_user_pages(spark):
    df = spark.range(N).select(
        F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".csv")).alias("nombre"),
        F.lit("csv").alias("tipo"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("user_id"),
        F.timestamp_seconds(F.col("id")).alias("fecha_subida"),
        F.lit(1).cast("long").alias("tamano"),
    ).repartition(16)
    page = catalogue.pages_per_user(df, page=3, limit=10).filter(F.col("user_id") == "hot")
    got = [r["nombre"] for r in page.orderBy("position").collect()]
    newest = [f"f{i}.csv" for i in range(N - 1, -1, -1) if i % 3 == 0]
    assert got == newest[20:30]
    info = {r["user_id"]: r["total"] for r in catalogue.page_info(df, 3, 10, by="user_id").collect()}
    assert info["hot"] == N // 3


def test_exists_and_count(spark):
    assert tables.exists(spark.range(3)) and not tables.exists(spark.range(0))
    assert tables.row_count(spark.range(7)) == 7
