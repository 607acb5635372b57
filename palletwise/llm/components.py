"""Connected components of an edge table, by DataFrame operations only.

Alternating large-star / small-star: every round rewires each node to the
smallest node of its neighbourhood until every edge points at the smallest
node of its component.  Edges never grow beyond their first count, every
step is a combinable ``min`` and a join (AQE splits a hub's rows), and each
round is written to the shared checkpoint folder, so neither lineage nor
the driver grows with the data; the round before it is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.session import Stages


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges`` (u long, v long, any direction, repeats allowed) ->
    (node long, component long): the smallest node reachable.  Nodes without
    an edge to another node are not listed (they are their own component);
    edges with a null end are left out.

    Raises RuntimeError if ``max_rounds`` rounds do not settle it (a path of
    n nodes needs about log n rounds)."""
    edges = edges.filter("u is not null and v is not null and u <> v")
    rounds = Stages()
    edges = rounds(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = rounds(_star(_star(edges, True), False), "cc")
        rounds.clear(keep=1)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
