"""I-Match fingerprints over randomised lexicon subsets, in DataFrame
functions only.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies
in a band: neither the words of every text nor rare ones and misspellings.
df counts documents; the copies of a text that makes up a ten-thousandth of
all rows or more count as one document, so a large group of copies doesn't
push its own words out of the band.  A text keeps its terms in the lexicon,
sorted and distinct.  Terms are known by uniform 64-bit hashes, so a range of
hashes is a random subset of the lexicon and a run of the sorted terms; for
each of several rates (a quarter to a 1024th of all terms) up to ``SUBSETS``
such subsets hash the terms they hold.  The first hash is that of all the
terms; a text without any in the lexicon has that of all its terms there.
Likeness is the share of equal hashes among the subsets that hold a term of
either text: sparse subsets still agree where dense ones no longer do.

Sizes: the band bounds the lexicon: terms of df >= N e^-hi number at most
the mean count of distinct terms a document times e^hi, whatever the input;
the bound is checked before the lexicon goes to every task, as a constant
hash table of the plan that array functions look terms up in.  Texts that
count once are ten thousand at most.  The rest is one shuffle: documents go
by ranges of ids to buckets, where a window finds the next document.

A term is a run of ASCII letters and digits and non-ASCII characters,
lower-cased.  Defined results: null text is empty; empty texts are alike;
rows that share an id follow one another by a hash of their texts (equal
rows in one window group, which spills); null ids come last; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palletwise.session import stage

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
IDF_BAND = (3.0, 7.0)
SUBSETS = 16
LEVELS = (2, 4, 6, 8, 10)  # a subset holds 1 in 2^level terms
COPY_SHARE = 10_000  # texts of at least 1 / COPY_SHARE of all rows count once
UNIT = 1 << 20  # weight of a document
BUCKET_CHARS = 8 << 20
BUCKETS = (64, 65_536)
MOST_TERMS = 1 << 20


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column) -> Column:
    """The distinct terms of a text as sorted 64-bit hashes."""
    words = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda x: F.xxhash64(x))))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term): hashes of the terms in the band, staged; its size is checked."""
    rows = _rows(docs).select("text", F.xxhash64("text").alias("copy"))
    copies = stage(rows.groupBy("copy").agg(F.count("*").alias("n")), "imatch-copies")
    n_rows = copies.agg(F.sum("n")).first()[0] or 0
    once = (F.col("n") > 1) & (F.col("n") * COPY_SHARE >= n_rows)
    share = F.when(once, F.floor(F.lit(UNIT) / F.col("n"))).otherwise(UNIT).cast("long")
    n_docs = copies.agg(F.sum(F.col("n") * share)).first()[0] or 0
    many = F.broadcast(copies.filter(once).select("copy", share.alias("weight")))  # COPY_SHARE rows at most
    rows = rows.join(many, "copy", "left").select("text", F.coalesce("weight", F.lit(UNIT)).alias("weight"))
    df = rows.select("weight", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("weight").alias("df"))
    lo, hi = (n_docs / math.exp(x) for x in band)
    found = stage(df.filter(F.col("df").between(hi, lo)).select("term"), "imatch-lexicon")
    size = found.count()
    if size > MOST_TERMS:
        raise ValueError(f"{size} terms in the band, {MOST_TERMS} allowed: lower its upper end")
    return found


def lookup(lex: DataFrame):
    """A test of a term column for ``lex`` (at most ``MOST_TERMS`` rows): a
    hash table of lists as a constant, folded once by the optimizer."""
    found = [r[0] for r in lex.collect()]
    slots = 1 << max(len(found) - 1, 1).bit_length()
    table: list[list[int]] = [[] for _ in range(slots)]
    for x in found:
        table[x % slots].append(x)
    held = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")
    return lambda x: F.array_contains(F.get(held, F.pmod(x, F.lit(slots)).cast("int")), x)


def ranges(subsets: int = SUBSETS, levels: tuple[int, ...] = LEVELS) -> list[tuple[int, int]]:
    """The hash ranges (first, end) of the subsets."""
    return [(c << (64 - k), (c + 1) << (64 - k)) for k in levels for c in range(min(subsets, 1 << k))]


def signature(text: Column, known, subsets: int = SUBSETS, levels: tuple[int, ...] = LEVELS) -> Column:
    """Hashes (32 bits, 0 if the subset holds no term) of the terms of a text
    that pass the test ``known``."""
    low = -(1 << 63)  # hashes are signed
    bounds = sorted({x for r in ranges(subsets, levels) for x in r} - {0, 1 << 64})
    marks = F.array(*[F.lit(low + x).cast("long") for x in bounds])

    def short(h: Column) -> Column:
        return h.bitwiseAND(F.lit(0xFFFFFFFF))

    def every(found: Column, whole: Column, at: Column) -> Column:
        def place(x: int) -> Column:
            if x in (0, 1 << 64):
                return F.size(found).cast("long") if x else F.lit(0).cast("long")
            return F.get(at, F.lit(bounds.index(x)))

        def subset(first: Column, end: Column) -> Column:
            held = F.slice(found, first.cast("int") + 1, (end - first).cast("int"))
            return F.when(end > first, short(F.xxhash64(held))).otherwise(F.lit(0)).cast("long")

        first = short(F.xxhash64(F.when(F.size(found) > 0, found).otherwise(whole)))
        return F.array(first, *[subset(place(x), place(y)) for x, y in ranges(subsets, levels)])

    def places(found: Column) -> Column:  # of each bound, the terms below it
        return _let(F.sort_array(F.concat(found, marks)), lambda m: F.array(
            *[F.array_position(m, F.lit(low + x).cast("long")) - F.lit(1 + i) for i, x in enumerate(bounds)]))

    return _let(terms(text), lambda whole: _let(F.filter(whole, known), lambda found: _let(
        places(found), lambda at: every(found, whole, at))))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal hashes of two signatures where either is not 0."""
    held = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    return _let(held, lambda h: F.when(F.size(h) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(h, lambda p: p["x"] == p["y"])) / F.size(h)))


def as_text(sig: Column) -> Column:
    """A signature as one string, eight hex digits a hash."""
    return F.array_join(F.transform(sig, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def _sized(n_chars: int, bucket_chars: int) -> int:
    return min(max(BUCKETS[0], -(-n_chars // bucket_chars)), BUCKETS[1])


def _bucket(doc_id: Column, u: Column, cuts: list[int]) -> Column:
    """Number of the id range of a row, by descending id; ``cuts`` descend.
    An id that fills several ranges is spread over them by ``u``."""
    n = len(cuts)
    # folded to one constant by the optimizer
    table = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(n, 1).bit_length()))])

    def count(test) -> Column:  # of the leading cuts that pass
        return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & test(F.get(table, p + s - 1)), p + s).otherwise(p))

    above, upto = count(lambda c: c > doc_id), count(lambda c: c >= doc_id)
    share = u / F.lit(float(1 << 63))
    own = above + F.floor(share * F.greatest(upto - above, F.lit(1))).cast("int")
    return F.when(doc_id.isNull(), n + 1 + F.floor(share * (n + 1)).cast("int")).otherwise(own)


def _order():
    return Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "u")


def followed(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(bucket, extra, doc_id, u, text, next_text): every row with the text
    of the next row by descending id, the first after the last; rows of
    ``extra`` only lend their text to the end of a bucket.  Rows follow one
    another as in ``_order``."""
    rows = _rows(docs).withColumn("u", F.shiftrightunsigned(F.xxhash64("text"), 1))
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = _sized(size, bucket_chars)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), F.col("u"), sorted(cuts, reverse=True)))
    key = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), F.col("u").alias("u"))
    first = rows.groupBy("bucket").agg(F.min(key).alias("k")).orderBy("bucket").collect()  # one row a bucket
    spark = docs.sparkSession
    lent = [(-r["k"]["down"] if r["k"]["down"] is not None else None, r["k"]["u"], first[i - 1]["bucket"]) for i, r in enumerate(first)]
    lent = F.broadcast(spark.createDataFrame(lent, "first_id long, first_u long, goes int"))
    extra = rows.join(lent, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("u") == F.col("first_u")))
    extra = extra.groupBy("goes", "doc_id", "u").agg(F.first("text").alias("text"))  # of equal rows one
    every = rows.withColumn("extra", F.lit(False)).unionByName(
        extra.select("doc_id", "text", "u", F.col("goes").alias("bucket"), F.lit(True).alias("extra")))
    return every.select("bucket", "extra", "doc_id", "u", "text", F.lead("text").over(_order()).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last half of code points replaced by the first as
    many of ``next_text``, or all."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame, band: tuple[float, float] = IDF_BAND, subsets: int = SUBSETS,
                 levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(doc_id, signature) of every row, the signature an array of hashes."""
    known = lookup(lexicon(docs, band))
    return _rows(docs).select("doc_id", signature(F.col("text"), known, subsets, levels).alias("signature"))


def compared(docs: DataFrame, band: tuple[float, float] = IDF_BAND, subsets: int = SUBSETS, levels: tuple[int, ...] = LEVELS,
             bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs`` (doc_id, text)."""
    known = lookup(lexicon(docs, band))
    rows = followed(docs, bucket_chars).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    signed = F.transform(F.array("text", "edited"), lambda t: signature(t, known, subsets, levels))
    rows = rows.select("bucket", "extra", "doc_id", "u", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"), signed.alias("signatures"))
    sig, cut = F.col("signatures")[0], F.col("signatures")[1]
    rows = rows.withColumn("after", F.lead(sig).over(_order())).filter("not extra")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(sig).alias("fingerprint"), as_text(cut).alias("edited_fingerprint"),
                       likeness(sig, cut).alias("near_edited"), likeness(sig, F.col("after")).alias("near_next"))
