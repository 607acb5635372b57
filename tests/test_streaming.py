import os

from pyspark.sql import functions as F

from palletwise import streaming
from palletwise.operators import rollups
from palletwise.plans import views
from tests.conftest import SF_SMALL, rows

COLS = ["series_desc", "pallet_id", "item_id", "item_desc", "us_price", "quantity"]


def test_running_rollups_equal_batch(spark, scratch):
    inv = views.inventory(spark, SF_SMALL)
    landing = os.path.join(scratch, "landing")
    # two waves of uploads
    inv.filter(F.col("source_file").startswith("file_A")).select(*COLS).write.option("header", True).csv(
        os.path.join(landing, "w1"))
    stream = streaming.inventory_stream(spark, os.path.join(landing, "*"))
    q = streaming.start(streaming.running_item_rollup(stream), os.path.join(scratch, "ck1"), query_name="items_rt")
    q.awaitTermination()
    first = spark.table("items_rt")
    assert rows(first) == rows(rollups.item_rollup(inv.filter(F.col("source_file").startswith("file_A"))))

    inv.filter(~F.col("source_file").startswith("file_A")).select(*COLS).write.option("header", True).csv(
        os.path.join(landing, "w2"))
    q2 = streaming.start(streaming.running_item_rollup(streaming.inventory_stream(spark, os.path.join(landing, "*"))),
                         os.path.join(scratch, "ck1"), query_name="items_rt2")
    q2.awaitTermination()
    assert rows(spark.table("items_rt2")) == rows(rollups.item_rollup(inv))

    pt = streaming.start(streaming.running_pallet_totals(streaming.inventory_stream(spark, os.path.join(landing, "*")), 20),
                         os.path.join(scratch, "ck2"), query_name="pallets_rt")
    pt.awaitTermination()
    batch = rollups.pallet_rollup(inv, 20).select("pallet_id", "quantity", "extended_percent")
    assert rows(spark.table("pallets_rt")) == rows(batch)


def test_landing_manifest_appends_new_files(spark, scratch):
    land = os.path.join(scratch, "land")
    os.makedirs(land)
    for n in ("A b.XLSX", "x.pdf"):
        with open(os.path.join(land, n), "w") as fh:
            fh.write("x")
    ck = os.path.join(scratch, "ck-m")
    out = os.path.join(scratch, "manifest")

    def sink(batch, epoch):  # idempotent: a retried epoch rewrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = streaming.start(streaming.landing_manifest(spark, land, "u1"), ck, sink=sink, output_mode="append")
    q.awaitTermination()
    got = {r["filename"]: r for r in spark.read.parquet(out).collect()}
    assert got["A b.XLSX"]["success"] and got["A b.XLSX"]["stored_name"].startswith("A_b_")
    assert got["A b.XLSX"]["stored_name"].endswith(".xlsx") and not got["x.pdf"]["success"]
    with open(os.path.join(land, "old.xls"), "w") as fh:
        fh.write("y")
    q2 = streaming.start(streaming.landing_manifest(spark, land, "u1"), ck, sink=sink, output_mode="append")
    q2.awaitTermination()
    assert sorted(r["filename"] for r in spark.read.parquet(out).collect()) == ["A b.XLSX", "old.xls", "x.pdf"]
