"""Importance resampling towards a target distribution, by Arrow kernels.

Texts are lower-cased in A-Z only and split into words; features are the runs
of 1 to ``max_n`` consecutive words.  The kernels do the work on whole
batches: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` turn texts into dictionary indices; indices shifted by
one word form pairs (index of the shorter run, index of the next word), so
every distinct run is hashed (CRC-32) once a batch, however often it occurs;
``take`` on the buckets' gains and a segmented sum give each text's total.

A bucket's gain is the logarithm of its share of the target's features over
its share of the documents' features (add-one smoothed, in thousandths,
floored).  The counts cover every row of both tables; what the driver and
the tasks hold is one number a bucket, whatever the input.  A document's
weight is the floored mean gain of its features, its score adds Gumbel noise
seeded by its id, and the documents with the highest scores are drawn: a
sample without replacement in proportion to the weights' exponentials.

Ranks need no single task: a histogram of the scores (integers within about
+-100,000, so a table of bounded size) gives the score at which the draw
ends; only documents up to there are sorted, by range partitions, and
numbered in them with the counts of the earlier partitions added.

Defined results: null text has no words; a text without words has weight 0;
documents under ``min_words`` words are scored and never drawn; an empty
target or table leaves all gains to the smoothing; ties go to the smaller
id, null ids come last, and rows that share id and score follow one another
in an unspecified order; repeated rows are counted and scored each; other
columns are kept by ``draw``, except that columns named like the results are
replaced.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.session import ship_package, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: all ASCII but digits and a-z
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
BATCH_BYTES = 4 << 20
RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def word_indices(texts):
    """(dictionary of distinct words, index of every word, words of each
    text) of an Arrow string column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # a copy that begins at offset 0: lower-casing a cast slice mixes up places
    texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    pieces = pc.split_pattern_regex(texts, pattern=SEPARATORS)
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    parent = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(pieces)
    real = pc.not_equal(flat, "")  # a text may begin or end with a separator
    coded = pc.dictionary_encode(flat.filter(real))
    owner = parent[real.to_numpy(zero_copy_only=False)]
    count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), count


def features(texts, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, owning text of every feature, words of each
    text); features are ordered by length, then place."""
    names, word, count = word_indices(texts)
    owner = np.repeat(np.arange(len(count)), count)
    raw = [x.encode() for x in names]
    crc = np.fromiter((zlib.crc32(x) for x in raw), dtype=np.int64, count=len(raw))
    run = word  # index of the run that begins at each word, among distinct runs
    buckets_of, owners = [crc[run] % buckets], [owner]
    for n in range(2, max_n + 1):
        inside = owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)] if len(owner) >= n else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        pair, run_at = np.unique(np.stack([run[at], word[at + n - 1]], axis=1), axis=0, return_inverse=True)
        # the CRC of a longer run goes on from that of the shorter one
        crc = np.fromiter((zlib.crc32(b" " + raw[w], int(crc[r])) for r, w in pair), dtype=np.int64, count=len(pair))
        run = np.full(len(owner), -1, dtype=np.int64)
        run[at] = run_at.ravel()
        buckets_of.append(crc[run[at]] % buckets)
        owners.append(owner[at])
    return np.concatenate(buckets_of), np.concatenate(owners), count


def bucket_counts(rows: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows by bucket, summed in each task
    before the shuffle."""
    ship_package(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, dtype=np.int64)
        for part in _text.slices(batches, "text", BATCH_BYTES):
            total += np.bincount(features(part.column("text"), max_n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    found = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, in thousandths; ``buckets`` numbers."""
    counts = []
    for rows in (docs, target):
        own = np.zeros(buckets, dtype=np.int64)
        for bucket, n in bucket_counts(rows, max_n, buckets).collect():  # one row a bucket at most
            own[bucket] = n
        counts.append(own)
    s, t = counts
    s_all, t_all = int(s.sum()) + buckets, int(t.sum()) + buckets
    value = [math.log((int(b) + 1.0) * s_all / ((int(a) + 1.0) * t_all)) for a, b in zip(s, t, strict=True)]
    return np.floor(1000.0 * np.array(value)).astype(np.int64)


def _weights(docs: DataFrame, gain: np.ndarray, max_n: int, carry: tuple[str, ...]) -> DataFrame:
    """Rows of ``docs`` reduced to the columns ``carry`` (as c0, c1, ...)
    with n_words, n_features and weight."""
    spark = docs.sparkSession
    ship_package(spark)
    sent, buckets = spark.sparkContext.broadcast(gain), len(gain)
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        values = pa.array(sent.value)
        for part in _text.slices(batches, "t", BATCH_BYTES):
            bucket, owner, n_words = features(part.column("t"), max_n, buckets)
            own = pc.take(values, pa.array(bucket)).to_numpy()
            order = np.argsort(owner, kind="stable")
            n = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
            total = np.zeros(part.num_rows, dtype=np.int64)
            if len(own):
                first = np.cumsum(n) - n
                total[n > 0] = np.add.reduceat(own[order], first[n > 0])
            mean = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(n_words), pa.array(n), pa.array(mean)], [*names, *RESULTS[:3]])

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col("text").cast("string").alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "t")
    return rows.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths (floored), fixed by seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked(rows: DataFrame, percent: int, min_words: int, doc_id: str) -> DataFrame:
    """``rows`` (staged: n_words, score and the id column) with ``rank``, the
    place in the draw, null where not drawn."""
    able = rows.filter(F.col("n_words") >= min_words)
    by_score = able.groupBy("score").agg(F.count("*").alias("n"))
    # one row a distinct score: a table bounded by the range of the scores
    above = by_score.select("score", "n", F.sum("n").over(
        Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    n_able, = able.agg(F.count("*")).first()
    draw = percent * n_able // 100
    last, = above.filter(F.col("upto") >= draw).agg(F.max("score")).first() if draw else (None,)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select("*", none)
    is_near = (F.col("n_words") >= min_words) & (F.col("score") >= last)
    near, far = rows.filter(is_near), rows.filter(~is_near)
    order = [F.desc("score"), F.asc_nulls_last(doc_id)]
    placed = near.withColumn("place", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, F.asc("place")).sortWithinPartitions(*order, F.asc("place"))
    # numbers each sorted partition from 0: partition << 33 | place
    placed = stage(placed.withColumn("place", F.monotonically_increasing_id()), "resampling-order")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("part", part).withColumn("at", at).drop("place")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(sizes.select("part", before.alias("before")), "part")
    rank = F.col("before") + F.col("at") + 1
    placed = placed.select(*rows.columns, F.when(rank <= draw, rank).cast("long").alias("rank"))
    return placed.unionByName(far.select("*", none))


def _resampled(docs: DataFrame, target: DataFrame, carry: tuple[str, ...], max_n: int, buckets: int, min_words: int,
               percent: int, seed: str) -> DataFrame:
    if max_n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("max_n and buckets must be positive, percent from 0 to 100")
    rows = _weights(docs, gains(docs, target, max_n, buckets), max_n, carry)
    own = f"c{carry.index('doc_id')}"
    rows = stage(rows.withColumn("score", F.col("weight") + noise(F.col(own), seed)), "resampling-scores")
    rows = ranked(rows, percent, min_words, own)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *RESULTS)


def scores(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
           percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of
    ``docs`` (doc_id, text); ``target`` (text) is the target distribution."""
    return _resampled(docs, target, ("doc_id",), max_n, buckets, min_words, percent, seed)


def draw(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
         percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns and the results."""
    keep = tuple(c for c in docs.columns if c not in RESULTS)
    return _resampled(docs, target, keep, max_n, buckets, min_words, percent, seed).filter("rank is not null")
