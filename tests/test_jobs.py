import os

from pyspark.sql import functions as F

from palletwise.operators import compare, rollups
from palletwise.plans import jobs, views
from palletwise.sources.workbook import write_xlsx
from tests.conftest import SF_SMALL, rows


def export_inventory(spark, scratch):
    """Writes the sf0.001 inventory view as three CSV layouts and one
    workbook, the way uploads arrive."""
    inv = views.inventory(spark, SF_SMALL).drop("_pos")
    cols = ["series_desc", "pallet_id", "item_id", "item_desc", "us_price", "quantity"]
    a = inv.filter(F.col("source_file") == "file_AF.csv").select(*cols)
    n = inv.filter(F.col("source_file").startswith("file_N")).select(*reversed(cols))
    r = inv.filter(F.col("source_file") == "file_RF.csv").select(*cols)
    a.coalesce(1).write.option("header", True).csv(os.path.join(scratch, "in", "a"))
    n.coalesce(1).write.option("header", True).option("sep", ";").csv(os.path.join(scratch, "in", "n"))
    r_rows = [list(x) for x in r.collect()]
    write_xlsx(os.path.join(scratch, "in", "r.xlsx"), [[c.upper() for c in cols]] + r_rows)
    exported = (F.col("source_file") == "file_AF.csv") | F.col("source_file").startswith("file_N") | (
        F.col("source_file") == "file_RF.csv")
    return inv.filter(exported)


def test_purchase_order_job_matches_direct_operators(spark, scratch):
    inv = export_inventory(spark, scratch)
    ref = views.reference(spark, SF_SMALL)
    out = jobs.build_purchase_order(spark, os.path.join(scratch, "in"), ref, 20.0,
                                    attrs={"order_date": "2024-01-05T10:00:00"}, out_dir=os.path.join(scratch, "out"))
    expected_items = rollups.item_rollup(inv)
    assert rows(out["item_rollup"]) == rows(expected_items)
    lines = out["po_lines"]
    total = lines.filter(F.col("line_no").isNull()).first()
    assert total["description"] == "TOTAL:"
    n_pallets = inv.select("pallet_id").distinct().count()
    assert lines.filter(F.col("line_no").isNotNull()).count() == n_pallets
    direct = rollups.pallet_rollup(inv.withColumn("_pos", F.monotonically_increasing_id()), 20.0)
    assert rows(lines.filter(F.col("line_no").isNotNull()), "pallet_id", "ordered") == rows(
        direct.select("pallet_id", F.col("quantity").cast("long").alias("ordered")))
    s = out["summary"].first()
    s2 = compare.comparison_summary(compare.distinct_items(inv), ref).first()
    assert s["total_processed_items"] == s2["total_processed_items"]
    assert s["unmatched_count"] == s2["unmatched_count"]
    assert out["po_header"].first()["order_date"] == "01/05/2024"
    assert all(r["success"] for r in out["manifest"].collect())
    landed = jobs.read_outputs(spark, os.path.join(scratch, "out"))
    assert landed["item_rollup"].count() == expected_items.count()
    assert rows(landed["po_lines"]) == rows(lines)
    parts = sorted(p for p in os.listdir(os.path.join(scratch, "out", "csv", "-")) if p.startswith("item_rollup_"))
    folder = os.path.join(scratch, "out", "csv", "-", parts[0])
    keys = []
    for part in sorted(x for x in os.listdir(folder) if x.startswith("part-")):
        with open(os.path.join(folder, part)) as fh:
            keys += [tuple(line.rstrip("\n").split(",")[:2]) for line in fh.readlines()[1:]]
    assert keys == sorted(keys) and len(keys) == expected_items.count()
    assert out["counts"].first().asDict() == {"n_rows": inv.count(), "null_ids": 0, "bad_rows": 0, "files_read": out["manifest"].count(), "files_failed": 0}


def test_refresh_reference_replaces_table(spark, scratch):
    path = os.path.join(scratch, "Ref List.csv")
    with open(path, "w") as fh:
        fh.write(" No. ,Description\n00123,Atlas\n00123,Atlas again\n,x\n9,NA\n88,Tale\n")
    table = os.path.join(scratch, "item_reference")
    ref, n = jobs.refresh_reference(spark, path, table)
    assert n == 2
    assert rows(ref) == [("00123", "Atlas", "Ref_List.csv"), ("88", "Tale", "Ref_List.csv")]
    with open(path, "w") as fh:
        fh.write("no.;description\n7;Seven\n")
    ref2, n2 = jobs.refresh_reference(spark, path, table)
    assert n2 == 1 and rows(ref2) == [("7", "Seven", "Ref_List.csv")]


def test_refresh_reference_per_user(spark, scratch):
    table = os.path.join(scratch, "item_reference")
    a = os.path.join(scratch, "a.csv")
    with open(a, "w") as fh:
        fh.write("No.,Description\n1,One\n2,Two\n")
    b = os.path.join(scratch, "b.csv")
    with open(b, "w") as fh:
        fh.write("No.;Description\n9;Nine\n")
    jobs.refresh_reference(spark, a, table, user_id="u1")
    jobs.refresh_reference(spark, b, table, user_id="u2")
    _, n = jobs.refresh_reference(spark, b, table, user_id="u1")
    from palletwise.sources import sinks

    got = rows(sinks.read_table(spark, table), "user_id", "item_number")
    assert got == [("u1", "9"), ("u2", "9")] and n == 1


def test_refresh_of_one_user_keeps_a_global_table(spark, scratch):
    root = scratch + "/table"
    for name, rows in (("global", [("1", "one"), ("2", "two")]), ("user", [("1", "mine")])):
        spark.createDataFrame(rows, "`No.` string, Description string").coalesce(1).write.option("header", True).csv(f"{scratch}/{name}.csv")
    jobs.refresh_reference(spark, f"{scratch}/global.csv", root)
    mine, n = jobs.refresh_reference(spark, f"{scratch}/user.csv", root, user_id="u1")
    assert n == 1
    from palletwise.sources import sinks

    got = {(r.item_number, r.description, r.user_id) for r in sinks.read_table(spark, root).collect()}
    assert got == {("1", "one", None), ("2", "two", None), ("1", "mine", "u1")}


def test_price_extension_names_every_missing_column(spark):
    import pytest

    from palletwise.functions.constants import INVENTORY_REQUIRED
    from palletwise.operators.clean import MissingColumnsError

    whole = views.inventory(spark, SF_SMALL)
    assert "extended_retail" in jobs.extend_prices(whole, 20).columns
    for column in INVENTORY_REQUIRED:
        with pytest.raises(MissingColumnsError) as e:
            jobs.extend_prices(whole.drop(column), 20)
        assert e.value.missing == [column]


def test_outputs_of_a_lost_run_are_not_found(spark, scratch):
    from palletwise.sources import sinks

    out = os.path.join(scratch, "out")
    assert jobs.read_outputs(spark, out) == {}
    for name in ("csv/u/a", "csv/u/b"):
        sinks.write_sorted_csv(spark.createDataFrame([(name, "d", 1.0)], "item_id string, item_desc string, quantity double"), f"{out}/{name}", ["item_id"])
        spark.range(2).write.parquet(f"{out}/pdf/{name}")
    sinks.commit_paths(spark, out, {"item_rollup": "csv/u/a", "po_lines": "pdf/csv/u/a"})
    assert jobs.read_outputs(spark, out)["item_rollup"].first()["item_id"] == "csv/u/a"
