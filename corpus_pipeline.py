"""Corpus pipeline: operators of ``palletwise.llm`` chained over ``documents``.

quality rules -> line dedup -> SimHash near-dedup -> mixing sources to target
weights -> best-fit packing.  Every stage takes all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from palletwise.llm import lines, mixing, packing, quality, simhash  # noqa: E402
from palletwise.session import scratch_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go, but for the first; a document
    that loses all its lines goes with them.  ``n_chars`` follows the text."""
    rows = lines.dedup(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_lines")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: of its rows with the
    smallest ``doc_id`` the one with the smallest fingerprint, then text hash,
    then other columns; unlike texts under one id are groups of their own.
    Rows with a null ``doc_id`` cannot stand for a group and stay."""
    docs = docs.select(*COLUMNS)
    rows = docs.withColumn("key", F.xxhash64("text"))
    found = simhash.groups(rows, shingle=3, radius=2, keep=("key",))
    heads = found.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp", "key")).alias("head"))
    rows = rows.join(heads.select("head.doc_id", "head.key"), ["doc_id", "key"], "left_semi")
    kept = rows.groupBy("doc_id", "key").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix selects, once per epoch that takes them."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and the bins they are packed into."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
# MinHash, XXH64 fingerprints and bin packing have no SQL form; the tests hold
# the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written as
    Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
