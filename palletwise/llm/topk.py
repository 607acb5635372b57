"""Exact top-k search by inner product with MaxScore.

A vector is a document whose terms are its components; term d of a query
contributes ``q[d] * x[d]``.  The rows are spread over shards by a hash of
their id.  A shard holds its postings term by term and, for every block of
rows, the largest and smallest value of each term, which bound a term's
contribution to a query.  For a query and a block the terms are sorted by
the spread of that contribution; the tail whose spreads together cannot lift
a row from the block's base score to the query's current k-th score is
non-essential.  The essential postings are traversed for every row of the
block; the others are probed, strongest first, only for the rows that can
still reach the k-th score.  Shards return k rows a query, merged at the end.

Queries are the given set against all rows, in blocks: a task holds one
shard and one query block, both of bounded size.  Scores are exact: the
arithmetic runs in float32, float64 or int64, whichever holds every partial
sum exactly.  Where a product of a shard and a query could leave 64 bits, that
query is scored against that shard without bounds, the rows in question in
integers of any size; only a returned score beyond 64 bits fails the job.

Defined results: vectors that are null or hold a null or non-finite
component take no part, nor do rows with a null id; shorter vectors count as
padded with zeros (a missing posting); rows repeating an id are candidates
each, but not for the query of their own id, and of a query id's vectors the
smallest asks; ties go to the smaller id; fewer than k other rows
give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palletwise.session import ship_package, stage

SHARD_ROWS = 8192
QUERY_ROWS = 4096
BLOCK_ROWS = 1024


_EXACT = 2.0**60  # bounds below it leave every partial sum within 64 bits


def integers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _arithmetic(bound: float):
    """The narrowest type that holds integers up to ``bound`` exactly."""
    if bound < 2**24:
        return np.float32
    if bound < 2**53:
        return np.float64
    if bound < 2**63:
        return np.int64
    raise OverflowError("an inner product may exceed 64 bits")


class Shard:
    """Postings of a shard: ``ids`` ascending, ``terms[d]`` the values of
    term d, and the value range of each term in each block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block_rows: int = BLOCK_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        cuts = range(0, len(ids), block_rows)
        self.blocks = [(lo, min(lo + block_rows, len(ids))) for lo in cuts]
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in self.blocks])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in self.blocks])
        self.typed: dict = {}

    def terms(self, kind) -> list[np.ndarray]:
        """Per block the posting lists, one row a term."""
        if kind not in self.typed:
            self.typed[kind] = [np.ascontiguousarray(self.vectors[a:b].T).astype(kind) for a, b in self.blocks]
        return self.typed[kind]


def maxscore(shard: Shard, query_id: int, query: np.ndarray, k: int, kind) -> list[tuple[int, int]]:
    """The (id, score) of the k best rows of the shard other than
    ``query_id``, best first, ties to the smaller id."""
    q = query.astype(kind)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, kind)
    lists = shard.terms(kind)
    a, b = shard.low * query, shard.high * query
    least, spread = np.minimum(a, b), np.abs(a - b)
    base_of = least.sum(axis=1)
    for n, (lo, hi) in enumerate(shard.blocks):
        full = len(best) == k
        floor = best[-1] if full else None
        post, order = lists[n], np.argsort(-spread[n], kind="stable")
        tail = np.append(np.cumsum(spread[n][order][::-1])[::-1], 0)  # spread of terms order[i:]
        if full and base_of[n] + tail[0] <= floor:
            continue  # no row of the block competes; later rows lose ties
        cut = len(order) if not full else int(np.searchsorted(-(base_of[n] + tail), -floor, side="left"))
        essential = order[:cut]
        score = q[essential] @ post[essential]
        rows = np.arange(hi - lo)
        at = cut
        rest = least[n][order][::-1].cumsum()[::-1] if full else None
        while at < len(order):  # probe the non-essential terms while competitive
            alive = score + rest[at].astype(kind) + tail[at].astype(kind) > floor
            if not alive.all():
                rows, score = rows[alive], score[alive]
            if not len(rows):
                break
            step = order[at : at + 8]
            score = score + q[step] @ post[np.ix_(step, rows)]
            at += 8
        keep = shard.ids[lo + rows] != query_id
        if full:
            keep &= score > floor
        if not keep.any():
            continue
        ids, got = np.concatenate([best_ids, shard.ids[lo + rows[keep]]]), np.concatenate([best, score[keep]])
        top = np.lexsort((ids, -got))[:k]
        best_ids, best = ids[top], got[top]
    return [(int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]


def scored(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``maxscore`` for products of any size, by scoring every row."""
    size = np.abs(vectors.astype(np.float64)) @ np.abs(query.astype(np.float64))
    score = (vectors @ query).astype(object)  # rows beyond 64 bits are replaced
    for i in np.flatnonzero(size >= 2**62):
        score[i] = sum(a * b for a, b in zip(vectors[i].tolist(), query.tolist(), strict=True))
    best = sorted((-score[i], int(ids[i])) for i in np.flatnonzero(ids != query_id))[:k]
    if any(not -(2**63) <= -s < 2**63 for s, _ in best):
        raise OverflowError(f"a score of query {query_id} exceeds 64 bits")
    return [(i, -s) for s, i in best]


def _matrix(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _search(candidates, queries, k: int):
    """Cogrouped pandas frames (shard, query block) -> best rows."""
    import pandas as pd

    out = []
    if len(candidates) and len(queries):
        width = max(max(map(len, candidates["v"])), max(map(len, queries["v"])))
        x, q = _matrix(candidates["v"], width), _matrix(queries["v"], width)
        size = np.abs(q.astype(np.float64))
        each = size @ np.abs(x.astype(np.float64)).max(axis=0, initial=0)  # bound of each query's products
        most = float(each[each < _EXACT].max(initial=0))
        kind = _arithmetic(4 * most + 1)
        shard = Shard(candidates["vec_id"].to_numpy(np.int64), x)
        for qid, vector, bound in zip(queries["query_id"].tolist(), q, each, strict=True):
            found = maxscore(shard, qid, vector, k, kind) if bound < _EXACT else scored(shard.ids, shard.vectors, qid, vector, k)
            out += [(qid, i, s) for i, s in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0,
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``rows`` (vec_id, embedding) -> (query_id, rank, vec_id, score): for
    each row that satisfies ``is_query`` its k best other rows."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = rows.sparkSession
    ship_package(spark)
    data = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    data = data.select("vec_id", integers(F.col("embedding"), scale).alias("v"), "q")
    # the place in the input spreads the rows of a repeated id over the shards
    data = stage(data.withColumn("place", F.xxhash64("vec_id", F.monotonically_increasing_id())), "topk")
    asking = data.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = data.count(), asking.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    left = data.select(
        "vec_id", "v", F.pmod("place", F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asking.select(
        F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
