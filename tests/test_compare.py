from palletwise.operators import compare
from tests.conftest import rows


def fixture(spark):
    items = spark.createDataFrame(
        [("00123", "a"), ("123", "a"), ("55", "a"), ("55", "b"), ("0", "b"), (None, "b"), (" 55 ", "b")],
        "item_id string, source_file string",
    )
    ref = spark.createDataFrame([("123",), ("0055",)], "item_number string")
    return compare.distinct_items(items), ref


def test_summary_fixture(spark):
    items, ref = fixture(spark)
    s = compare.comparison_summary(items, ref).first().asDict()
    assert s == dict(total_reference_items=2, total_processed_items=4, exact_matches=1, normalized_matches=2,
                     matched_items_count=2, unmatched_count=1, zero_padding_issues=1, match_percentage=75.0)


def test_unmatched_and_files(spark):
    items, ref = fixture(spark)
    assert rows(compare.unmatched_items(items, ref)) == [("0", ["b"])]
    assert rows(compare.files_with_missing(items, ref)) == [("b",)]
    assert rows(compare.exact_matches(items, ref)) == [("123",)]
    assert rows(compare.normalised_matches(items, ref)) == [("123",), ("55",)]


def test_row_level(spark):
    items, ref = fixture(spark)
    got = rows(compare.compare_items(items, ref), "item_id", "is_matched", "matched_with", "exact")
    assert got == [("0", False, None, False), ("00123", True, "123", False), ("123", True, "123", True),
                   ("55", True, "0055", False)]


def test_empty_input(spark):
    items = compare.distinct_items(spark.createDataFrame([], "item_id string, source_file string"))
    ref = spark.createDataFrame([("1",)], "item_number string")
    s = compare.comparison_summary(items, ref).first()
    assert s["total_processed_items"] == 0 and s["match_percentage"] == 0.0 and s["total_reference_items"] == 1


def test_properties(spark):
    import random

    rnd = random.Random(3)
    ids = ["0" * rnd.randint(0, 3) + str(rnd.randint(0, 60)) for _ in range(400)]
    items = compare.distinct_items(spark.createDataFrame([(i, "f%d" % rnd.randint(0, 4)) for i in ids],
                                                         "item_id string, source_file string"))
    ref = spark.createDataFrame([("0" * rnd.randint(0, 2) + str(rnd.randint(0, 60)),) for _ in range(50)], "item_number string")
    s = compare.comparison_summary(items, ref).first()
    # brute force on the driver (small fixture)
    P = {r["item_id"] for r in items.collect()}
    R = {r["item_number"] for r in ref.collect()}
    RN = {x.lstrip("0") for x in R}
    exact = P & R
    norm = {p.lstrip("0") for p in P} & RN
    unmatched = {p for p in P if p not in exact and p.lstrip("0") not in norm}
    assert s["exact_matches"] == len(exact)
    assert s["normalized_matches"] == len(norm)
    assert s["unmatched_count"] == len(unmatched)
    assert s["matched_items_count"] == len(exact) + len(norm) - len({e.lstrip("0") for e in exact} & norm)
    assert s["total_processed_items"] - s["unmatched_count"] + len(unmatched) == len(P)
