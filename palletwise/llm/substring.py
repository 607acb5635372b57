"""Substring dedup by Relative Lempel-Ziv parsing over an indexed corpus.

The reference is the whole corpus.  Its index maps a window of ``window``
consecutive words to the smallest document holding it, hash-partitioned into
blocks over the cluster.  Indexing all windows would move several times the
text, so the index only holds windows that can repeat: every window is
anchored at the smallest hash among its ``gram``-word grams (equal windows
have equal anchors), and a window whose anchor occurs once in the corpus is
unique.  A document is then factored greedily, left to right: a factor is a
maximal run of words whose consecutive windows all occur earlier in one
source document; where a factor ends, the windows straddling the boundary
are looked up as well, so a repeat split over two factors is still found.
Words covered by factors of at least ``window`` words are duplicate spans.

All decisions are made on the input: a window counts as repeated if the same
word sequence starts in a document of smaller ``doc_id``, or earlier in the
same document, whether or not that text is itself removed.

To keep the index small, the consecutive windows of one anchor place are one
entry (a run); only where different runs meet at an anchor, which is at the
ends of repeats, are windows entered one by one.  Runs and windows are
identified by 128 hash bits (anchor, and run or window).  Every shuffled row
is a (hash, document) pair or a compressed text; hot anchors, runs and
windows are reduced by map-side ``count`` / ``min`` first and joined (AQE
splits their rows); only a document's own entries are gathered in one place.

Defined results: null or blank text has no words (0, 0 and the digest of the
empty text); texts under ``window`` words keep everything; a row with null
``doc_id`` is compared with itself only; rows that share a ``doc_id`` are
separate texts that do not make each other repeated; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.session import ship_package, stage

WINDOW = 20
GRAM = 8


def _anchored(words: _text.Words, window: int, gram: int):
    """(start, anchor hash, anchor place, window hash) of every window."""
    h = words.hashes()
    w, whole = words.windows(h, window, seed=11)
    if not whole.any():
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, np.zeros(0, np.int64), z
    g, _ = words.windows(h, gram, seed=7)
    span = window - gram + 1
    low = g[: len(w)].copy()
    place = np.zeros(len(w), dtype=np.int64)
    for j in range(1, span):  # leftmost smallest gram
        nxt = g[j : j + len(w)]
        less = nxt < low
        low = np.where(less, nxt, low)
        place[less] = j
    start = np.flatnonzero(whole)
    return start, low[start], start + place[start], w[start]


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id, n): the anchors of each text with their number of
    places in it."""

    def run(batches):
        import pyarrow as pa

        for part in _text.slices(batches):
            words = _text.Words(_text.as_bytes(part.column("text")))
            start, anchor, place, _ = _anchored(words, window, gram)
            first = np.ones(len(start), dtype=bool)
            first[1:] = (place[1:] != place[:-1])
            a, d = anchor[first], words.doc[start[first]]
            order = np.lexsort((a, d))
            a, d = a[order], d[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(a)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[at].view(np.int64)), part.column("doc_id").take(pa.array(d[at])), pa.array(n.astype(np.int32))],
                ["anchor", "doc_id", "n"])

    return docs.mapInArrow(run, "anchor long, doc_id long, n int")


def _lookup(table_doc: np.ndarray, table: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position in the (doc, key) table of each (doc, key), -1 if absent."""
    both_doc, both = np.concatenate([table_doc, doc]), np.concatenate([table, key])
    order = np.lexsort((np.arange(len(both)), both, both_doc))
    d, k = both_doc[order], both[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.where(head < len(table), head, -1)
    return out[len(table) :]


def _lists(column, dtype=np.int64):
    """(row index, value) of a list column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    value = pc.list_flatten(column)
    return row.astype(np.int64), value.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(dtype)


def _runs(doc: np.ndarray, anchor: np.ndarray, place: np.ndarray, win: np.ndarray):
    """Consecutive windows with one anchor place form a run: (first window
    of each run, number of windows, hash of the run's windows)."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    if not len(head):
        return head, head, np.zeros(0, np.uint64)
    size = np.diff(np.append(head, len(doc)))
    step = (np.arange(len(doc)) - np.repeat(head, size)).astype(np.uint64)
    return head, size, _text.mix(np.add.reduceat(_text.mix(win + step * np.uint64(0x9E3779B97F4A7C15)), head))


def _pack(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): the text as zstd, for shuffles."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for part in _text.slices(batches):
            packed = pa.array([press.compress(t) for t in _text.as_bytes(part.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed], ["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _unpack(part) -> _text.Words:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return _text.Words([press.decompress(t) for t in part.column("packed").to_pylist()])


def _run_rows(packed: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, run, doc_id, wins): the distinct runs of windows of each text
    whose anchor is among the row's ``anchors``."""

    def run(batches):
        import pyarrow as pa

        for part in _text.slices(batches, "packed", _text.CHUNK_BYTES // 2):
            words = _unpack(part)
            start, anchor, place, win = _anchored(words, window, gram)
            doc = words.doc[start]
            row, known = _lists(part.column("anchors"))
            hit = _lookup(row, known, doc, anchor.view(np.int64)) >= 0
            anchor, place, win, doc = anchor[hit], place[hit], win[hit], doc[hit]
            head, size, digest = _runs(doc, anchor, place, win)
            a, d = anchor[head], doc[head]
            order = np.lexsort((digest, a, d))
            new = np.ones(len(order), dtype=bool)
            o, prev = order[1:], order[:-1]
            new[1:] = (a[o] != a[prev]) | (d[o] != d[prev]) | (digest[o] != digest[prev])
            keep = np.sort(order[new])
            first = np.cumsum(size[keep]) - size[keep]
            at = np.repeat(head[keep] - first, size[keep]) + np.arange(int(size[keep].sum()))
            wins = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(win[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep].view(np.int64)), pa.array(digest[keep].view(np.int64)),
                 part.column("doc_id").take(pa.array(d[keep])), wins], ["anchor", "run", "doc_id", "wins"])

    return packed.mapInArrow(run, "anchor long, run long, doc_id long, wins array<long>")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _text.mix(a * np.uint64(3) + b).view(np.int64)


def _found(part, doc, anchor, other, names: tuple[str, str, str]):
    """Whether (anchor, other) of each entry is in the row's parallel lists
    ``names`` (anchors, others, sources), and its source.  The pair is looked
    up as one number, then its second half is compared itself."""
    row, a = _lists(part.column(names[0]))
    _, b = _lists(part.column(names[1]))
    _, refs = _lists(part.column(names[2]))
    at = _lookup(row, _pair(a.view(np.uint64), b.view(np.uint64)), doc, _pair(anchor, other))
    hit = at >= 0
    hit[hit] = b[at[hit]] == other.view(np.int64)[hit]
    source = np.zeros(len(doc), dtype=np.int64)
    source[hit] = refs[at[hit]]
    return hit, source


def _parse(part, window: int, gram: int):
    """Factor the texts of an Arrow slice that carries what the index found:
    whole runs (``ra``, ``rr``, ``rs``) and single windows (``wa``, ``ww``,
    ``ws``) that occur in an earlier document, with that document.

    Returns the words, and arrays (text, start, length, source, inner) of the
    factors; inner marks repeats of the text's own earlier words."""
    words = _unpack(part)
    start, anchor, place, win = _anchored(words, window, gram)
    doc = words.doc[start]
    head, size, digest = _runs(doc, anchor, place, win)
    run_hit, run_source = _found(part, doc[head], anchor[head], digest, ("ra", "rr", "rs"))
    whole, whole_source = np.repeat(run_hit, size), np.repeat(run_source, size)
    # at the boundary of a factor: window by window
    single, single_source = _found(part, doc, anchor, win, ("wa", "ww", "ws"))
    earlier = whole | single
    source = np.where(whole, whole_source, single_source)
    # the same window earlier in the same text
    o = np.lexsort((np.arange(len(start)), win, anchor, doc))
    same = np.zeros(len(start), dtype=bool)
    same[o[1:]] = (doc[o[1:]] == doc[o[:-1]]) & (anchor[o[1:]] == anchor[o[:-1]]) & (win[o[1:]] == win[o[:-1]])
    hit = np.flatnonzero(earlier | same)
    inner, source, d, s = ~earlier[hit], source[hit], doc[hit], start[hit]
    begin = np.ones(len(hit), dtype=bool)  # greedy: consecutive windows with one source
    begin[1:] = (s[1:] != s[:-1] + 1) | (inner[1:] != inner[:-1]) | (source[1:] != source[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(begin)
    length = np.diff(np.append(first, len(hit))) + window - 1
    return words, d[first], s[first], length, source[first], inner[first]


def _with_index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Each row of (doc_id, text), packed, with the runs and windows of its
    document that also occur in a document of smaller id."""
    ship_package(docs.sparkSession)
    anchors = stage(_anchor_rows(docs, window, gram), "rlz-anchors")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("places")).filter("places > 1").select("anchor")
    mine = anchors.filter("doc_id is not null").join(repeated, "anchor").groupBy("doc_id").agg(
        F.collect_set("anchor").alias("anchors"))
    packed = _pack(docs)
    runs = stage(_run_rows(packed.join(mine, "doc_id"), window, gram), "rlz-runs")
    # a run of windows that an earlier document has as a whole
    first = stage(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("ref"), F.count("*").alias("n")), "rlz-first")
    whole = runs.select("anchor", "run", "doc_id").join(first.filter("n > 1"), ["anchor", "run"]).filter("ref < doc_id")
    # the first holders of different runs around one anchor: their windows
    # are compared one by one (a later holder's are all covered above)
    kinds = first.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor")
    heads = first.join(kinds, "anchor").select("anchor", "run", F.col("ref").alias("doc_id"))
    wins = runs.join(heads, ["anchor", "run", "doc_id"]).select("anchor", "doc_id", F.explode("wins").alias("win"))
    wins = stage(wins, "rlz-windows")
    early = wins.groupBy("anchor", "win").agg(F.min("doc_id").alias("ref"), F.count("*").alias("n")).filter("n > 1")
    part = wins.join(early, ["anchor", "win"]).filter("ref < doc_id")
    found = whole.select("doc_id", F.lit(False).alias("one"), "anchor", F.col("run").alias("key"), "ref").unionByName(
        part.select("doc_id", F.lit(True).alias("one"), "anchor", F.col("win").alias("key"), "ref"))
    found = found.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("one"), F.struct("anchor", "key", "ref"))).alias("r"),
        F.collect_list(F.when(F.col("one"), F.struct("anchor", "key", "ref"))).alias("w"))
    none = F.array().cast("array<long>")
    return packed.join(found, "doc_id", "left").select(
        "doc_id", "packed", *[F.coalesce(F.col(c)[f], none).alias(to) for c, f, to in (
            ("r", "anchor", "ra"), ("r", "key", "rr"), ("r", "ref", "rs"),
            ("w", "anchor", "wa"), ("w", "key", "ww"), ("w", "ref", "ws"))])


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse: (doc_id, start, length, source): words [start, start +
    length) of the document repeat a run of document ``source`` (the
    document itself for a repeat of its own earlier words)."""
    _check(window, gram)

    def run(batches):
        import pyarrow as pa

        for part in _text.slices(batches, "packed", _text.CHUNK_BYTES // 2):
            words, text, start, length, source, inner = _parse(part, window, gram)
            ids = part.column("doc_id").take(pa.array(text))
            own = [i if n else s for i, n, s in zip(ids.to_pylist(), inner.tolist(), source.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(start - words.first[text]), pa.array(length.astype(np.int64)), pa.array(own, pa.int64())],
                ["doc_id", "start", "length", "source"])

    return _with_index(_columns(docs), window, gram).mapInArrow(run, "doc_id long, start long, length long, source long")


def _check(window: int, gram: int) -> None:
    if not 1 <= gram <= window:
        raise ValueError("need 1 <= gram <= window")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed,
    kept_sha256, n_factors[, kept]).  ``kept`` is the remaining words joined
    by one space; the digest is of its UTF-8 bytes."""
    _check(window, gram)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long" + (", kept string" if with_text else "")

    def run(batches):
        import pyarrow as pa

        for part in _text.slices(batches, "packed", _text.CHUNK_BYTES // 2):
            words, text, start, length, _, _ = _parse(part, window, gram)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.bincount(words.doc[gone], minlength=part.num_rows).astype(np.int64)
            digests, texts = [], []
            for i, t in enumerate(words.texts):
                w = t.split()
                if removed[i]:
                    lo = words.first[i]
                    w = [w[j] for j in np.flatnonzero(~gone[lo : lo + len(w)]).tolist()]
                kept = b" ".join(w)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            out = [part.column("doc_id"), pa.array(words.count), pa.array(removed), pa.array(digests, pa.string()),
                   pa.array(np.bincount(text, minlength=part.num_rows).astype(np.int64))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"]
            if with_text:
                out.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names)

    return _with_index(_columns(docs), window, gram).mapInArrow(run, schema)
