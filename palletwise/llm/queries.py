"""Registered queries of the operators in this package: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palletwise.llm import (
    audit, imatch, licenses, lines, mixing, packing, quality, resampling, simhash, substring, tokens, topk, toxicity)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")


@register
def op4_substring_dedup(spark, sf):
    return substring.dedup(_documents(spark, sf)).drop("n_factors")


@register
def op8_simhash_near_dedup(spark, sf):
    found = simhash.near_duplicates(_documents(spark, sf), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op5_quality_rules(spark, sf):
    return quality.verdicts(_documents(spark, sf))


@register
def op2_topk_maxscore(spark, sf):
    rows = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet")
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


#: Target weights of the mix, by level; sources of one language share alike.
MIX_WEIGHTS = {"domain": {0: 40, 1: 30, 2: 20, 3: 10}, "lang": {"en": 55, "de": 15, "fr": 15, "es": 15}}


@register
def op3_source_mixing(spark, sf):
    return mixing.mix(_documents(spark, sf), weights=MIX_WEIGHTS).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


@register
def op7_best_fit_packing(spark, sf):
    return packing.pack(_documents(spark, sf))


@register
def op6_token_counts(spark, sf):
    found = tokens.count_tokens(_documents(spark, sf), ("source", "lang", "text"))

    def field_tokens(field: int) -> F.Column:
        own = F.filter("sections", lambda s: s["field"] == field)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["n_tokens"])

    return found.select(
        "doc_id", "n_tokens", F.size("sections").alias("n_sections"), field_tokens(0).alias("source_tokens"),
        field_tokens(1).alias("lang_tokens"), field_tokens(2).alias("text_tokens"),
        F.col("sections")["n_tokens"].alias("section_tokens"))


@register
def op1_license_scan(spark, sf):
    return licenses.scan(_documents(spark, sf))


@register
def op9_toxicity(spark, sf):
    return toxicity.score(_documents(spark, sf), spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet"))


@register
def op10_line_dedup(spark, sf):
    return lines.counts(_documents(spark, sf))


@register
def op11_importance_resampling(spark, sf):
    target = spark.read.parquet(f"{sf.rstrip('/')}/benchmark.parquet")
    return resampling.scores(_documents(spark, sf), target, max_n=1).drop("n_words")


@register
def op13_filter_audit(spark, sf):
    return audit.audit(_documents(spark, sf), spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet"))


@register
def op12_imatch_fingerprints(spark, sf):
    return imatch.compared(_documents(spark, sf))
