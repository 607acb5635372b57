"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces of
that length; every piece is packed whole.  The pieces are spread over shards
of bounded size by a hash, and each shard packs its own in order of falling
length: a piece goes to the open bin with the least room that still takes
it.  If none does, a bin is opened.  All permitted lengths that take the
piece are priced together: the cost of a bin (its length plus a fixed
overhead per sequence) over the tokens it can be expected to hold, which are
the piece and as much of its remaining room as pieces still to come, small
enough for it and not already due to the room of open bins, can fill.  The
least cost per token wins, ties to the shorter length.  At the end each bin
is downsized to the smallest permitted length that holds its contents.

Only (id, length) pairs are shuffled, never texts.  Defined results: null or
blank text has no tokens and is not packed; repeated rows are packed each;
null ids are packed like any id; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.llm.quality import words
from palletwise.session import ship_package, stage

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
SHARD_PIECES = 32768


def best_fit(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Pack ``pieces`` (token counts, longest first) -> (bin of each piece,
    offset of each piece in its bin, downsized length of each bin).

    ``rooms`` is a bit per room size that some open bin has, so the bin with
    the least sufficient room is the lowest set bit from the piece's size."""
    top = lengths[-1]
    upto = [0] * (top + 1)  # tokens in pieces of at most each size
    for p in pieces:
        upto[p] += p
    for i in range(1, top + 1):
        upto[i] += upto[i - 1]
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    rooms = free = done = 0
    used: list[int] = []
    size: list[int] = []
    bins, offsets = [], []
    for p in pieces:
        done += p
        fits = rooms >> p
        if fits:
            room = p + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            free -= room
        else:
            left = upto[top] - done  # tokens of the pieces still to come
            best = None
            for c in lengths[bisect_left(lengths, p) :]:
                fill = max(0, min(c - p, min(upto[c - p], left) - free))
                price = ((c + overhead) / (p + fill), c)
                if best is None or price < best:
                    best = price
            b, room = len(used), best[1]
            used.append(0)
            size.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += p
        room = size[b] - used[b]
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
            free += room
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, tokens=None,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset): one
    row per piece.  ``tokens`` is the length column (default: the words of
    ``text``); ``start`` is the piece's first token in its document,
    ``bin_offset`` its place in the bin, ``bin_id`` unique in the result."""
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    ship_package(docs.sparkSession)
    top = lengths[-1]
    n = F.size(words(F.col("text").cast("string"))) if tokens is None else tokens
    rows = docs.select("doc_id", n.cast("long").alias("total")).filter("total > 0")
    # rows alike are counted first and numbered apart, so that they spread
    # over the shards however many there are
    rows = rows.groupBy("doc_id", "total").agg(F.count("*").alias("copies"))
    rows = rows.select("doc_id", "total", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    pieces = rows.select("doc_id", "copy", "total", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / top).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "copy", "piece", (F.col("piece") * top).alias("start"),
                           F.least(F.lit(top).cast("long"), F.col("total") - F.col("piece") * top).alias("n_tokens"))
    pieces = stage(pieces, "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)))

    def shard(part):
        part = part.sort_values(["n_tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, sizes = best_fit(part["n_tokens"].tolist(), lengths, overhead)
        part["bin_id"] = [part["shard"].iloc[0] * (1 << 32) + b for b in bins]
        part["bin_length"] = [sizes[b] for b in bins]
        part["bin_offset"] = offsets
        return part[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_offset"]]

    kind = dict(docs.dtypes)["doc_id"]
    return pieces.groupBy("shard").applyInPandas(
        shard, f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_length long, bin_offset long")
