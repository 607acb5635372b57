"""Keyed table maintenance expressed as joins: append-if-absent, update by
key, delete by keys.  Each returns the new table content (and, where the
caller needs it, a report); writing it is the sink's job
(``palletwise.sources.sinks.replace_table``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.operators.clean import c, dedupe_first


def _one_per_key(df: DataFrame, key: str, pos: str | None) -> DataFrame:
    """Deterministic de-duplication: first in ``pos`` order, or the smallest
    row when no order is given."""
    if pos and pos in df.columns:
        return dedupe_first(df, key, pos).drop(pos)
    others = [x for x in df.columns if x != key]
    if not others:
        return df.select(c(key)).distinct()
    return (
        df.groupBy(c(key))
        .agg(F.min(F.struct(*[c(x) for x in others])).alias("_r"))
        .select(c(key), *[F.col("_r")[x].alias(x) for x in others])
    )


def append_if_absent(new: DataFrame, table: DataFrame, key: str, pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table, inserted rows): rows of ``new`` whose key the table does
    not hold yet, one per key, appended."""
    fresh = _one_per_key(new, key, pos).join(table.select(c(key)), key, "left_anti")
    fresh = fresh.select(*[c(x) for x in table.columns if x in fresh.columns])
    return table.unionByName(fresh, allowMissingColumns=True), fresh


def update_by_key(table: DataFrame, changes: DataFrame, key: str, pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(updated table, unknown keys).  Columns present in ``changes`` replace
    the table's values for matching keys; ``updated`` flags touched rows.
    Keys of ``changes`` the table lacks are reported, not inserted."""
    ch = _one_per_key(changes, key, pos)
    cols = [x for x in ch.columns if x != key and x in table.columns]
    ch = ch.select(c(key), *[c(x).alias("_new_" + x) for x in cols], F.lit(True).alias("_hit"))
    j = table.join(ch, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = j.select(
        *[F.when(hit, F.col("_new_" + x)).otherwise(c(x)).alias(x) if x in cols else c(x) for x in table.columns],
        hit.alias("updated"),
    )
    unknown = changes.select(c(key)).distinct().join(table.select(c(key)), key, "left_anti")
    return out, unknown


def delete_by_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Table without the rows whose key is listed.  The key list is
    de-duplicated first (map-side), so a key repeated many times costs one
    row per task in the join."""
    return table.join(keys.select(c(key)).distinct(), key, "left_anti")


def row_count(df: DataFrame) -> int:
    """Number of rows (one aggregate job)."""
    return df.count()


def exists(df: DataFrame) -> bool:
    """Whether any row exists; stops after the first row found."""
    return len(df.limit(1).take(1)) > 0
