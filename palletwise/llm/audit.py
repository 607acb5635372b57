"""Filter interaction audit: what each filter of a cascade removes in every
order of the filters.

One pass gives each text its failures as a bit mask and the SHA-256 digest of
its whole text, so only narrow rows are kept.  Copies are found in two steps.
A counting Bloom filter holds two counters a text: every task sums its own
and Spark's additive aggregation merges them; counters that reached two are
packed into bits and sent to all tasks.  A text with a counter of one is
unique for certain and takes no further part.  Only possible repeats are
shuffled, by digest, for the smallest id of their text; their repeat flags
then meet the other rows in additive counts by (part, mask), and every
figure of every order is a sum over at most 32 masks.

The sketch has 16 counters a document, at most 2^28, so what is sent to every
task never passes 32 MB; a fuller sketch clears fewer texts and the exact
step decides on more, so the counts stay exact at any size.  A text with very
many copies is reduced to its smallest id in each task before the shuffle,
and its rows are spread by (digest, id) afterwards.

Defined results: null text is empty, null source is the empty part; rows
with a null id are judged, but are never repeats nor make others repeats;
rows that share the smallest id of a text are all first; a label holds for
every row of its id, and of several labels of an id one that says so is
enough; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.session import ship_package, stage

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
COUNTERS_PER_TEXT = 16
MOST_COUNTERS = 1 << 28
BLOCK = 1 << 15  # bits of a block of the packed sketch

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that begin no code point


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text fails, A the lowest bit."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < MIN_WORDS)
            + 2 * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
            + 4 * (100 * capitals > CAPITALS_PERCENT * points)
            + 8 * (len(text.translate(None, SYMBOLS)) < len(text)))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h1, h2, digest) of every row; h1 and h2 are the
    first 64-bit words of the digest."""
    ship_package(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for piece in _text.slices(batches):
            texts = _text.as_bytes(piece.column("text"))
            digests = [hashlib.sha256(t).digest() for t in texts]
            heads = np.frombuffer(b"".join(d[:16] for d in digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("part"), pa.array([failures(t) for t in texts], pa.int32()),
                 pa.array(heads[:, 0]), pa.array(heads[:, 1]), pa.array(digests, pa.binary())],
                ["doc_id", "part", "mask", "h1", "h2", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, h1 long, h2 long, digest binary")


def sketch(rows: DataFrame, counters: int) -> DataFrame:
    """(block, bits): the merged counting Bloom filter of ``rows`` (h1, h2)
    as one bit a counter, set where it reached two; blocks without such a
    counter have no row."""
    slots = F.array_distinct(F.array(*[F.pmod(h, F.lit(counters)) for h in ("h1", "h2")]))
    merged = rows.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    some = merged.filter("n > 1").select((F.col("slot") / BLOCK).cast("long").alias("block"), F.pmod("slot", F.lit(BLOCK)).alias("bit"))
    return some.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def possible(rows: DataFrame, counters: int) -> DataFrame:
    """``rows`` with ``maybe``: false for texts that are certainly unique."""
    blocks = F.broadcast(stage(sketch(rows.filter("doc_id is not null"), counters), "audit-sketch"))
    found = F.col("doc_id").isNotNull()
    for h in ("h1", "h2"):
        slot = F.pmod(h, F.lit(counters))
        own = blocks.select(F.col("block").alias(f"{h}_block"), F.col("bits").alias(f"{h}_bits"))
        rows = rows.withColumn(f"{h}_slot", slot).join(own, F.floor(F.col(f"{h}_slot") / BLOCK) == F.col(f"{h}_block"), "left")
        found = found & _is_set(F.col(f"{h}_bits"), F.pmod(f"{h}_slot", F.lit(BLOCK)))
    return rows.select("doc_id", "part", "mask", "digest", found.alias("maybe"))


def mask_counts(docs: DataFrame, labels: DataFrame, counters_per_text: int = COUNTERS_PER_TEXT,
                most_counters: int = MOST_COUNTERS) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, and
    those labelled of good quality and toxic."""
    rows = stage(masks(docs), "audit-masks")
    counters = BLOCK
    while counters < min(counters_per_text * rows.count(), most_counters):
        counters *= 2
    rows = stage(possible(rows, counters), "audit-possible")
    maybe = rows.filter("maybe").drop("maybe")
    first = maybe.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flagged = maybe.join(first, ["digest", "doc_id"], "left")
    repeat = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    flagged = flagged.select("doc_id", "part", F.col("mask").bitwiseOR(repeat).alias("mask"))
    every = flagged.unionByName(rows.filter("not maybe").select("doc_id", "part", "mask"))
    label = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return every.join(label, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of every part, order and step from ``mask_counts`` (bit i of
    a mask is a failure of ``filters[i]``)."""
    steps = [{"filter_order": "".join(o), "step": i + 1, "own": 1 << filters.index(f), "before": sum(1 << filters.index(x) for x in o[:i])}
             for o in permutations(filters) for i, f in enumerate(o)]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2^filters at most
    rows = per_part.select("part", "masks", F.explode(plan).alias("s")).select("part", "masks", "s.*")
    own, before, orders = F.col("own"), F.col("before"), math.factorial(len(filters))

    def total(test, value) -> Column:
        picked = F.filter("masks", lambda m: test(m["mask"]))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, m: a + value(m))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(own) != 0

    def passed(mask: Column) -> Column:
        return mask.bitwiseAND(before) == 0

    def here(mask: Column) -> Column:
        return fails(mask) & passed(mask)

    def n(m: Column) -> Column:
        return m["n"]

    # of the orders, a k-th of all have a given one of k failing filters first
    share = {"kept": total(lambda k: k.bitwiseAND(own.bitwiseOR(before)) == 0, n), "removed": total(here, n),
             "redundant": total(lambda k: fails(k) & ~passed(k), n), "unique_fails": total(lambda k: k == own, n),
             "good_lost": total(here, lambda m: m["good"]), "toxic_lost": total(here, lambda m: m["toxic"]),
             "shapley": total(fails, lambda m: (m["n"] * orders / F.bit_count(m["mask"])).cast("long"))}
    return rows.select("part", "filter_order", "step", *[c.alias(k) for k, c in share.items()])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) of ``docs`` (doc_id, source, text)."""
    return interactions(stage(mask_counts(docs, labels), "audit-counts"))
