"""End-to-end use of the library.

    python examples/purchase_order.py <uploads folder> <reference file> <table folder> [percent]

Refreshes the reference catalogue from a .csv/.xlsx file (versioned table),
builds the purchase-order package from every .csv/.xlsx file under the
uploads folder, and prints the report lines, the comparison summary and the
files with missing references.  Paths may be local or on any file system the
session can read; intermediate Parquet goes to ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from palletwise.plans import jobs  # noqa: E402
from palletwise.session import get_spark  # noqa: E402
from palletwise.sources import sinks  # noqa: E402


def main(argv: list[str]) -> None:
    uploads, reference_file, table = argv[1], argv[2], argv[3]
    pct = float(argv[4]) if len(argv) > 4 else 20.0
    spark = get_spark()

    _, n_ref = jobs.refresh_reference(spark, reference_file, table)
    print(f"reference catalogue: {n_ref} items")

    out = jobs.build_purchase_order(
        spark, uploads, sinks.read_table(spark, table), pct,
        attrs={"purchase_info": "PO-1", "order_date": "2024-01-05T10:00:00", "seller_name": "Seller"},
    )
    out["manifest"].show(truncate=False)
    out["po_lines"].orderBy(F.col("line_no").asc_nulls_last()).show(30, truncate=False)
    out["summary"].show(truncate=False)
    out["files_with_missing"].show(truncate=False)


if __name__ == "__main__":
    main(sys.argv)
