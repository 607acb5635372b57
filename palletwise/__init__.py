"""Spark-native inventory and purchase-order analytics.

Sub-packages:
  functions  -- Column -> Column helpers (numeric coercion, id formats, text)
  sources    -- file scans (delimited, workbooks, listings) and table sinks
  operators  -- DataFrame -> DataFrame operators (clean, roll-ups, compare,
                catalogue, table maintenance)
  plans      -- composite jobs and the views over the driver's test tables
  streaming  -- incremental variants over a landing folder
"""

from palletwise.session import checkpoint_dir, get_spark, recommended_conf, stage

__all__ = ["checkpoint_dir", "get_spark", "recommended_conf", "stage"]
