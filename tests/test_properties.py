"""Properties: results do not depend on partitioning, split size or file
order; totals are preserved."""

import os

from pyspark.sql import functions as F

from palletwise.functions.columns import to_number
from palletwise.operators import clean, compare, rollups
from palletwise.plans import views
from palletwise.sources import files as src
from tests.conftest import SF_SMALL, rows

COLS = ["series_desc", "pallet_id", "item_id", "item_desc", "us_price", "quantity"]


def test_rollups_independent_of_partitioning(spark):
    inv = views.inventory(spark, SF_SMALL)
    base = rows(rollups.pallet_rollup(inv, 20))
    for n in (1, 7, 23):
        assert rows(rollups.pallet_rollup(inv.repartition(n), 20)) == base
    items = rows(rollups.item_rollup(inv))
    assert rows(rollups.item_rollup(inv.repartition(5, "pallet_id"))) == items


def test_item_rollup_preserves_total_quantity(spark):
    inv = views.inventory(spark, SF_SMALL)
    total_in = inv.filter(F.col("item_desc").isNotNull()).agg(F.sum(to_number("quantity"))).first()[0]
    total_out = rollups.item_rollup(inv).agg(F.sum("quantity")).first()[0]
    assert abs(total_in - total_out) < 1e-6


def test_keep_first_independent_of_split_size(spark, scratch):
    inv = views.inventory(spark, SF_SMALL)
    out = os.path.join(scratch, "one")
    inv.orderBy("_pos").select(*COLS).coalesce(1).write.option("header", True).csv(out)
    whole, _ = src.read_delimited_auto(spark, out)
    expected = rows(rollups.pallet_rollup(whole, 20))
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        split, _ = src.read_delimited_auto(spark, out)
        assert split.rdd.getNumPartitions() > 4
        assert rows(rollups.pallet_rollup(split, 20)) == expected
        first = clean.dedupe_first(split.select("item_id", "series_desc", "_pos"), "item_id")
        first_whole = clean.dedupe_first(whole.select("item_id", "series_desc", "_pos"), "item_id")
        assert rows(first, "item_id", "series_desc") == rows(first_whole, "item_id", "series_desc")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    # and equal to the view itself (file order reproduces row order)
    assert expected == rows(rollups.pallet_rollup(inv, 20))


def test_comparison_independent_of_file_order(spark):
    inv = views.inventory(spark, SF_SMALL)
    ref = views.reference(spark, SF_SMALL)
    a = compare.comparison_summary(compare.distinct_items(inv), ref).first()
    b = compare.comparison_summary(compare.distinct_items(inv.orderBy(F.desc("source_file")).repartition(3)), ref).first()
    assert a == b
