"""Work per row of the file jobs: what is sorted, decoded and summed."""

import random

from palletwise.functions import columns as C
from palletwise.plans import views
from palletwise.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exports_sort_numbers_before_text_is_made(spark):
    for view, text in ((views.inventory, "pallet_id"), (views.reference_upload, "description")):
        lines = plan(view(spark, SF, ordered=True).drop("_pos")).splitlines()
        sort = next(i for i, x in enumerate(lines) if "Sort [" in x)
        assert "Sort [l_orderkey" in lines[sort]
        assert any(f"AS {text}" in x for x in lines[:sort]) and not any(f"AS {text}" in x for x in lines[sort:])
        rows = [tuple(r["_pos"]) for r in view(spark, SF, ordered=True).collect()]
        assert rows == sorted(rows)
        assert sorted(map(str, view(spark, SF).collect())) == sorted(map(str, view(spark, SF, ordered=True).collect()))


def test_paths_are_decoded_after_grouping_and_stay_plain(spark, scratch):
    names = ["plain.csv", "50% a+b ü.csv", "x%20y.csv"]
    for n in names:
        with open(f"{scratch}/{n}", "w") as fh:
            fh.write('a,b\n1,"two\nlines"\n')
    paths = [f"{scratch}/{n}" for n in names]
    lines = files.body_checks(spark, paths, ",")._jdf.queryExecution().analyzed().toString().splitlines()
    top = next(i for i, x in enumerate(lines) if "Aggregate" in x)
    assert any("url_decode" in x for x in lines[: top + 1]) and not any("url_decode" in x for x in lines[top + 1 :])
    found = {r.path.rsplit("/", 1)[-1]: (r.bad_lines, r.multiline) for r in files.body_checks(spark, paths, ",").collect()}
    assert found == {n: (0, True) for n in names}
    rows, _ = files.read_tabular(spark, scratch)
    got = {(r.source_file, r["_pos"]["file"].rsplit("/", 1)[-1], r.b) for r in rows.collect()}
    assert got == {(n, n, "two\nlines") for n in names}


def test_double_sums_are_those_of_decimals(spark):
    rng = random.Random(7)
    values = [None, 0.0, -0.0, 5e-7, -5e-7, 4.9e-7, 1.5e-6, 0.1234565, -0.1234575, 999999.9999995, 1e6, -1e6, 1e20, 5e-324]
    values += [(rng.randint(-(10**8), 10**8) * 10 + 5) / 1e7 for _ in range(2000)]  # halves of the sixth decimal
    values += [rng.uniform(-10, 10) * 10 ** rng.randint(-8, 12) for _ in range(2000)]
    df = spark.createDataFrame([(i // k, v) for k in (1, 9, 5000) for i, v in enumerate(values)], "g long, v double")
    got = df.groupBy("g").agg(C.exact_sum("v").alias("a"), C.exact_double_sum("v").alias("b"))
    assert got.filter("not (a <=> b)").count() == 0
    assert df.filter("v is null").agg(C.exact_double_sum("v").alias("s")).first().s == 0.0


def test_ids_of_digits_alone(spark):
    ids = {"0": "0", "000": "0", "007": "7", "9" * 40: "9" * 40, "0" * 30 + "12": "12", "12\n": "12", "+05": "5", "٣": "٣", "": "", None: "nan"}
    df = spark.createDataFrame([(k,) for k in ids], "x string")
    assert {r.x: r.y for r in df.select("x", C.format_item_id("x").alias("y")).collect()} == ids
