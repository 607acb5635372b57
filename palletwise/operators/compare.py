"""Comparison of processed item ids with the reference catalogue.

Exact match on the trimmed id, flexible match on the id without leading
zeros, down to the source files of every unmatched id.

Plan shape: the processed side is reduced to distinct (id, file) pairs with
a partial aggregate before any shuffle, so an id repeated in a third of all
rows costs one row per map task.  The reference side is reduced to one row
per zero-stripped key carrying its (at most ~100, since ids are cut to 100
characters) padded variants, so one equi-join on the stripped key answers
both the exact and the flexible question.  AQE picks broadcast or
sort-merge for it from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.functions.columns import percent_of, strip_ws, strip_zeros
from palletwise.operators.clean import c


def distinct_items(df: DataFrame, id_col: str = "item_id", file_col: str = "source_file") -> DataFrame:
    """Distinct (item_id, source_file) with trimmed ids; missing ids dropped."""
    return (
        df.select(strip_ws(c(id_col)).alias("item_id"), c(file_col).alias("source_file"))
        .filter(F.col("item_id").isNotNull())
        .distinct()
    )


def reference_ids(ref: DataFrame, col: str = "item_number") -> DataFrame:
    """Distinct trimmed reference ids."""
    return ref.select(strip_ws(c(col)).alias("item_number")).filter(F.col("item_number").isNotNull()).distinct()


def reference_keys(ref: DataFrame, col: str = "item_number") -> DataFrame:
    """One row per zero-stripped key: ``norm``, ``first_ref`` (smallest id)
    and ``variants`` (every id with that key)."""
    return (
        reference_ids(ref, col)
        .groupBy(strip_zeros("item_number").alias("norm"))
        .agg(F.min("item_number").alias("first_ref"), F.collect_set("item_number").alias("variants"))
    )


def _keys(ref: DataFrame | None, keys: DataFrame | None) -> DataFrame:
    """Reference keys, computed from ``ref`` unless given (a job computes
    them once and passes them to every comparison output)."""
    if keys is not None:
        return keys
    if ref is None:
        raise ValueError("either ref or keys is required")
    return reference_keys(ref)


def comparison_rows(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The comparison record of every (item, file): item_id, source_file,
    is_matched, matched_with (see ``compare_items``)."""
    found = compare_items(items, ref, keys).select("item_id", "is_matched", "matched_with")
    return items.select("item_id", "source_file").distinct().join(found, "item_id")


def compare_items(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Row-level comparison per distinct processed id.

    item_id, norm, exact, normalised, is_matched (= normalised, since an
    exact match implies a flexible one), matched_with (the exact reference
    id, else the smallest reference id with the same stripped key)."""
    pids = items.select("item_id").distinct().withColumn("norm", strip_zeros("item_id"))
    keys = _keys(ref, keys)
    j = pids.join(keys, "norm", "left")
    exact = F.coalesce(F.array_contains("variants", F.col("item_id")), F.lit(False))
    return j.select(
        "item_id",
        "norm",
        exact.alias("exact"),
        F.col("first_ref").isNotNull().alias("normalised"),
        F.col("first_ref").isNotNull().alias("is_matched"),
        F.when(exact, F.col("item_id")).otherwise(F.col("first_ref")).alias("matched_with"),
    )


def exact_matches(items: DataFrame, ref: DataFrame) -> DataFrame:
    """Processed ids present verbatim in the reference."""
    pids = items.select("item_id").distinct()
    return pids.join(reference_ids(ref), pids.item_id == F.col("item_number"), "left_semi")


def normalised_matches(items: DataFrame, ref: DataFrame) -> DataFrame:
    """Zero-stripped keys present on both sides."""
    pn = items.select(strip_zeros("item_id").alias("norm")).distinct()
    return pn.join(reference_keys(ref).select("norm"), "norm", "left_semi")


def unmatched_ids(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Processed ids matching neither exactly nor without leading zeros."""
    pids = items.select("item_id").distinct().withColumn("norm", strip_zeros("item_id"))
    return pids.join(_keys(ref, keys).select("norm"), "norm", "left_anti").select("item_id")


def item_file_rows(items: DataFrame) -> DataFrame:
    """The distinct (item_id, source_file) pairs, one row each: bounded rows
    however many files hold an id."""
    return items.select("item_id", "source_file").distinct()


def _files_as_array(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_id").agg(F.array_sort(F.collect_list("source_file")).alias("source_files"))


def item_files(items: DataFrame) -> DataFrame:
    """item_id -> sorted array of the files it occurs in (an output option;
    ``item_file_rows`` has one row per file).  Built from the distinct pairs,
    so an array is bounded by the file count."""
    return _files_as_array(item_file_rows(items))


def unmatched_item_files(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Unmatched ids with their source files, one row per (item_id,
    source_file): distinct pairs (combined map-side), then one anti-join on
    the stripped key.  No array, so no row grows with the number of files."""
    pairs = item_file_rows(items).withColumn("norm", strip_zeros("item_id"))
    return pairs.join(_keys(ref, keys).select("norm"), "norm", "left_anti").select("item_id", "source_file")


def unmatched_items(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Unmatched ids with their source files as a sorted array: the rows of
    ``unmatched_item_files`` gathered per id, after the join."""
    return _files_as_array(unmatched_item_files(items, ref, keys))


def files_with_missing(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Distinct files holding at least one unmatched id (one anti-join on
    the stripped key, then a distinct of the file names)."""
    keys = _keys(ref, keys).select("norm")
    return (
        items.withColumn("norm", strip_zeros("item_id"))
        .join(keys, "norm", "left_anti")
        .select("source_file")
        .distinct()
    )


def comparison_summary(items: DataFrame, ref: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One row: total_reference_items, total_processed_items, exact_matches,
    normalized_matches, matched_items_count, unmatched_count,
    zero_padding_issues, match_percentage.

    No join: the ids of both sides are rows of one union, marked with their
    side, and reduced three times by combinable hash aggregates -- per id
    (exact match: both sides hold it), per stripped key (flexible match: both
    sides hold an id of it), in total.  Each side is read once."""
    if keys is None and ref is not None:
        refs = ref.select(strip_ws(c("item_number")).alias("item_number")).filter(F.col("item_number").isNotNull())
    else:
        refs = _keys(ref, keys).select(F.explode("variants").alias("item_number"))
    sides = items.select("item_id", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        refs.select(F.col("item_number").alias("item_id"), F.lit(0).alias("p"), F.lit(1).alias("r")))
    per_id = sides.groupBy(strip_zeros("item_id").alias("norm"), "item_id").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    per_norm = per_id.groupBy("norm").agg(
        F.sum("r").alias("n_ref"), F.sum("p").alias("n"), F.sum(F.col("p") * F.col("r")).alias("n_exact"))
    hit = (F.col("n") > 0) & (F.col("n_ref") > 0)
    s = per_norm.agg(
        F.coalesce(F.sum("n_ref"), F.lit(0)).cast("long").alias("total_reference_items"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_processed_items"),
        F.coalesce(F.sum("n_exact"), F.lit(0)).cast("long").alias("exact_matches"),
        F.count_if(hit).alias("normalized_matches"),
        F.count_if(F.col("n_exact") > 0).alias("_exact_norms"),
        F.coalesce(F.sum(F.when(F.col("n_ref") == 0, F.col("n"))), F.lit(0)).cast("long").alias("unmatched_count"),
    )
    return s.select(
        "total_reference_items",
        "total_processed_items",
        "exact_matches",
        "normalized_matches",
        (F.col("exact_matches") + F.col("normalized_matches") - F.col("_exact_norms")).alias("matched_items_count"),
        "unmatched_count",
        (F.col("normalized_matches") - F.col("exact_matches")).alias("zero_padding_issues"),
        percent_of(F.col("total_processed_items") - F.col("unmatched_count"), "total_processed_items").alias(
            "match_percentage"
        ),
    )
