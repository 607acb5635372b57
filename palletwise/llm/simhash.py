"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius.

Fingerprints (one Arrow pass) are collapsed to distinct values.  With radius
r the 64 bits are cut into r + 2 bands; two fingerprints within r bits agree
on at least two bands, so every pair of bands is a lossless block key.  A
block is compared bit-sliced: the bit planes of up to 64 x n fingerprints
are stored vertically, one machine word holds a bit of 64 fingerprints, and
the distances of all of them to a query are kept in carry-save counters that
saturate at r + 1; once every counter of the block has passed the radius the
query is abandoned.  A block larger than ``BLOCK_ROWS`` is cut into pieces
and every pair of pieces is a task of its own, so no task holds a block of
unbounded size.  Each task returns a spanning forest of the links it found
(at most one per row), never all pairs; components follow by stars.

Defined results: null or word-less text has fingerprint 0 and is linked like
any other; repeated rows share a fingerprint, hence a component; rows with a
null ``doc_id`` take part in fingerprints and links, but a component is named
by its smallest non-null ``doc_id`` (null if it has none); an empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.llm.components import components
from palletwise.session import ship_package, stage

BLOCK_ROWS = 4096
SMALL = 48  # groups up to this size are compared pair by pair, many groups at once
QUERIES = 128
SEED = 42
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_bytes(text: bytes, shingle: int) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    k = min(shingle, len(words))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(lens + 1) - lens - 1
    stop = (start + lens)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = [digest(norm[a:b], SEED) for a, b in zip(start.tolist(), stop, strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 65536):
        part = np.array(h[lo : lo + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long): the signed 64-bit fingerprint of each row, with its
    columns ``keep``."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for part in _text.slices(batches):
            fp = np.array([fingerprint_bytes(t, shingle) for t in _text.as_bytes(part.column("text"))], dtype=np.uint64)
            kept = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), *kept], ["doc_id", "fp", *keep])

    schema = ", ".join(["doc_id long, fp long", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(run, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of word j of plane b is bit b of
    fingerprint 64 j + i.  The last word is padded with zeros."""
    pad = np.zeros(-(-len(fps) // 64) * 64, dtype=np.uint64)
    pad[: len(fps)] = fps
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Words whose bits say: this counter is greater than ``radius``."""
    more = np.zeros_like(counter[0])
    same = np.full_like(counter[0], _FULL)
    for c in range(len(counter) - 1, -1, -1):
        if radius >> c & 1:
            same &= counter[c]
        else:
            more |= same & counter[c]
            same &= ~counter[c]
    return more


def _count(planes, shape: tuple, radius: int, abandon):
    """Carry-save distance counters over 64 difference planes.

    ``planes(b)`` gives the words whose bits are set where bit b differs.
    counter[c] holds bit c of 64 distances a word; a carry out of the top
    counter is kept in ``over``.  Every 8 planes ``abandon(far)`` is shown
    the distances already beyond the radius and may return a row mask that
    keeps only the rows worth finishing (None: stop).  Returns the words
    whose bits mark distances within the radius."""
    counter = [np.zeros(shape, dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(shape, dtype=np.uint64)
    for b in range(64):
        carry = planes(b)
        for c in range(len(counter)):
            counter[c], carry = counter[c] ^ carry, counter[c] & carry
        over |= carry
        if b % 8 == 7 and b < 63:
            keep = abandon(over | _beyond(counter, radius))
            if keep is None:
                return np.zeros((0, *shape[1:]), dtype=np.uint64)
            if keep is not True:
                counter, over = [x[keep] for x in counter], over[keep]
    return ~(over | _beyond(counter, radius))


def pairs_within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the positions where ``left`` and ``right`` differ in at most
    ``radius`` bits (bit-sliced, 64 pairs a word)."""
    planes = bit_planes(left ^ right)
    near = _count(lambda b: planes[b], planes.shape[1:], radius, lambda far: None if far.min() == _FULL else True)
    if near.shape != planes.shape[1:]:
        return np.zeros(len(left), dtype=bool)
    return np.unpackbits(near.view(np.uint8), bitorder="little")[: len(left)].astype(bool)


def block_within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query position, block position) of every pair within ``radius``;
    ``planes`` are the bit planes of a block of ``n`` fingerprints.  A query
    leaves as soon as all of the block is beyond the radius."""
    alive = np.arange(len(queries))

    def plane(b: int) -> np.ndarray:
        flip = np.where((queries[alive] >> np.uint64(b)) & np.uint64(1), _FULL, np.uint64(0))
        return planes[b][None, :] ^ flip[:, None]

    def abandon(far: np.ndarray):
        nonlocal alive
        keep = far.min(axis=1) != _FULL
        if keep.all():
            return True
        alive = alive[keep]
        return keep if len(alive) else None

    near = _count(plane, (len(queries), planes.shape[1]), radius, abandon)
    if not len(near):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, at = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n])
    return alive[q], at


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning links between fingerprints within ``radius``; ``right`` is
    None for a block against itself."""
    every = left if right is None else np.concatenate([left, right])
    parent = list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    target, shift = (left, 0) if right is None else (right, len(left))
    planes = bit_planes(target)
    signed, links = every.view(np.int64), []
    for lo in range(0, len(left), QUERIES):
        q, at = block_within(left[lo : lo + QUERIES], planes, len(target), radius)
        for i, j in zip((q + lo).tolist(), (at + shift).tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                links.append((int(signed[i]), int(signed[j])))
    return links


def links(fps: DataFrame, radius: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct fingerprints (fp long) -> spanning links (u, v) of the graph
    that joins fingerprints at most ``radius`` bits apart.

    Exact: no pair within the radius ends up in different components."""
    if not 0 <= radius <= 14:
        raise ValueError("radius must be 0..14")
    spark = fps.sparkSession
    ship_package(spark)
    bands = radius + 2
    cut = [64 * i // bands for i in range(bands + 1)]

    def band(i: int):
        return F.shiftrightunsigned("fp", cut[i]).bitwiseAND((1 << (cut[i + 1] - cut[i])) - 1)

    keys = F.array(*[F.struct(F.lit(n).alias("t"), band(i).alias("a"), band(j).alias("b"))
                     for n, (i, j) in enumerate(combinations(range(bands), 2))])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.a", "k.b")
    size = rows.groupBy("t", "a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    pieces = F.ceil(F.col("n") / block_rows).cast("int")
    rows = rows.join(size.select("t", "a", "b", pieces.alias("p")), ["t", "a", "b"])
    own = F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")
    # the piece pairs (x, y), x <= y, that a row of piece `own` belongs to
    pairs = F.transform(F.sequence(F.lit(0), F.col("p") - 1),
                        lambda x: F.struct(F.least(x, F.col("own")).alias("x"), F.greatest(x, F.col("own")).alias("y")))
    rows = rows.withColumn("own", own).select("fp", "t", "a", "b", "own", F.explode(pairs).alias("q"))
    rows = rows.select("fp", "t", "a", "b", "own", "q.x", "q.y")

    return _by_block(rows, radius)


def _by_block(rows: DataFrame, radius: int) -> DataFrame:
    """Compare each (t, a, b, x, y) group; many small groups share a batch."""
    key = ["t", "a", "b", "x", "y"]
    rows = rows.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key)

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*key, "own", "fp"]]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:5]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            if not len(at):
                held = cols
                continue
            bounds = [0, *at.tolist()]
            yield _compared(cols, bounds, radius, pa)
            held = [c[bounds[-1] :] for c in cols]
        if held is not None:
            yield _compared(held, [0, len(held[0])], radius, pa)

    return rows.mapInArrow(run, "u long, v long")


def _compared(cols: list[np.ndarray], bounds: list[int], radius: int, pa):
    """Links of the groups cut at ``bounds``: small ones together, shifted
    against themselves; large ones block by block."""
    x, y, own = cols[3], cols[4], cols[5]
    fp = np.ascontiguousarray(cols[6]).view(np.uint64)
    edge = np.asarray(bounds)
    size = np.diff(edge)
    found = [np.zeros((0, 2), dtype=np.int64)]
    stop = np.repeat(np.where(size <= SMALL, edge[1:], 0), size)
    at = np.flatnonzero(stop > 0)
    for shift in range(1, SMALL):
        at = at[at + shift < stop[at]]
        if not len(at):
            break
        i = at[(x[at] == y[at]) | (own[at] != own[at + shift])]
        for lo in range(0, len(i), 1 << 16):
            a = i[lo : lo + (1 << 16)]
            a = a[pairs_within(fp[a], fp[a + shift], radius)]
            found.append(np.stack([fp[a], fp[a + shift]], axis=1).view(np.int64))
    for g in np.flatnonzero(size > SMALL).tolist():
        lo, hi = int(edge[g]), int(edge[g + 1])
        part = fp[lo:hi]
        if x[lo] == y[lo]:
            forest = _forest(part, None, radius)
        else:
            side = own[lo:hi] == x[lo]
            forest = _forest(part[side], part[~side], radius)
        found.append(np.array(forest, dtype=np.int64).reshape(-1, 2))
    out = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, *keep): one row per row of ``docs``.
    ``root`` tells components apart that have the same smallest doc_id."""
    rows = stage(fingerprints(docs, shingle, keep), "simhash")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-fp")
    cc = components(links(distinct.select("fp"), radius))
    named = distinct.join(cc, distinct.fp == cc.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))
    root = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(root, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", *keep)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; the component
    id is the smallest doc_id reachable over links of at most ``radius``
    differing bits."""
    return groups(docs, shingle, radius).select("doc_id", "fp", "component_id")
