"""Incremental roll-ups over a landing folder with Structured Streaming.

Uploaded inventory files are picked up as they land (file source, every
column as text, fixed layout per stream); the same operators as the batch
jobs run as a stateful streaming aggregation, so each trigger only reads
the new files.  Sums are exact long micro-units, so the running state gives
the same numbers as a batch run over all files at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwise.functions.columns import exact_sum, extended_percent, null_tokens, currency_to_number, to_number
from palletwise.functions.constants import INVENTORY_REQUIRED
from palletwise.operators.catalogue import upload_manifest
from palletwise.operators.rollups import item_rollup

LANDING_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def inventory_stream(spark: SparkSession, landing: str, sep: str = ",", columns=INVENTORY_REQUIRED,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming rows of the delimited files landing in ``landing`` (header
    row, given column layout), with ``source_file``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = (
        spark.readStream.format("csv").schema(schema)
        .option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
    )
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(landing)
    return df.select(*[null_tokens(F.col(c)).alias(c) for c in columns], F.col("_metadata.file_name").alias("source_file"))


def running_item_rollup(stream: DataFrame) -> DataFrame:
    """Quantity per (canonical item id, description), kept as streaming state."""
    return item_rollup(stream)


def running_pallet_totals(stream: DataFrame, pct: float) -> DataFrame:
    """Quantity and extended percent per pallet, kept as streaming state."""
    q = to_number("quantity")
    amount = extended_percent(q * currency_to_number("us_price"), pct)
    return (
        stream.filter(F.col("pallet_id").isNotNull())
        .groupBy("pallet_id")
        .agg(exact_sum(q).alias("quantity"), exact_sum(amount).alias("extended_percent"))
    )


def landing_manifest(spark: SparkSession, landing: str, user_id: str) -> DataFrame:
    """Upload manifest rows for files as they land (stateless, append-only):
    each file is stamped with its own modification time.  File contents are
    not read."""
    files = spark.readStream.format("binaryFile").schema(LANDING_SCHEMA).load(landing)
    names = files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "modificationTime"
    )
    return upload_manifest(names, user_id, stamp_col="modificationTime")


def start(result: DataFrame, checkpoint: str, sink=None, query_name: str | None = None,
          available_now: bool = True, output_mode: str = "complete"):
    """Run a streaming result.  Roll-ups use ``complete`` mode: ``sink(batch_df,
    epoch)`` receives the complete current result each trigger (e.g.
    ``lambda d, e: replace_table(d, root)``).  Stateless results such as the
    landing manifest use ``append``.  Without a sink the result goes to an
    in-memory table ``query_name`` (tests, notebooks).  For append results
    keep the sink idempotent -- e.g. overwrite ``<out>/epoch=<epoch>`` -- so a
    batch replayed after a failure does not write twice.  ``available_now``
    processes what has landed and stops."""
    w = result.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    if sink is not None:
        w = w.foreachBatch(sink)
    else:
        w = w.format("memory").queryName(query_name or "rollup")
    return w.start()
