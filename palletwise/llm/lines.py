"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are cut into character shingles: the (up to) ``SHINGLE`` characters
from each character of the trimmed line on.  Equal lines are one entry.  Its
MinHash signature comes from its shingles' hashes: each falls into one bin,
and value j of the signature is the smallest hash in bin j or, where that is
empty, in the first bin with any in a fixed order of j's own (any shingle of
two sets' union decides value j with equal chance, so the values agree with
their similarity).  Signatures are banded; lines that share a band are
candidates.  In a band every line is compared with the band's leaders, its
first ``LEADERS`` lines, by the exact Jaccard similarity of the shingle sets
(a shingle identified by 64 hash bits), unless the sizes or sketches of the
sets rule it out; so bands of up to ``LEADERS`` + 1 lines are compared whole.
In larger bands the lines that the links so far leave in different
components are compared by an exact prefix filter: sets of similarity
s >= 4/5 share one of the |set| - ceil(s |set|) + 1 first shingles of either
in any common order; taken is the order by frequency, rarest first.  All
they share stands from their first common shingle on, so pairs without
enough room behind it are ruled out too.  A sketch holds for each of its
bits whether an odd number of the members falls on it: sets whose sketches
differ in more bits than similar sets of their sizes differ in members are
not similar.  So every pair of a band is compared, joined already or ruled
out by proof.  Verified links are joined into components by distributed
union-find, and of each component one line stays, the first in
(doc_id, line number) order.

With b bands of r rows a pair of similarity s meets with probability
1 - (1 - s^r)^b: 0.991 at 0.8, 0.999 at 0.85, 0.99998 at 0.9.

Skew: equal lines collapse map-side; bands are counted map-side and leaders
taken below the shuffle (``WindowGroupLimit``); members of a hot band are
narrow rows of a join, which AQE splits.  Nothing is collected.

Defined results: lines are compared without surrounding white space; lines
without a word are kept as they are; null text stays null; rows with null
``doc_id`` are kept whole and take no part; rows repeating a ``doc_id`` count
as one document; an empty table gives an empty result; other columns are
kept by ``dedup`` (clashing ``n_lines``/``n_removed`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palletwise.llm.components import components
from palletwise.llm.quality import SPACES
from palletwise.session import Stages, stage

SHINGLE = 9
BANDS, ROWS = 9, 4
WORDS = 16  # of 64 bits in a sketch
LEADERS = 8
SIMILARITY = (4, 5)  # 0.8 as a fraction


def _cut(line: Column, size: int = SHINGLE) -> Column:
    """The shingles from each character on, with repeats."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{1,{size}}}))"), F.lit(1))


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """The distinct character shingles of a trimmed line, one from each
    character on (those of the last characters are shorter)."""
    return F.array_distinct(_cut(line, size))


def _raw(line: Column) -> Column:
    """The 64-bit hashes of the shingles, with repeats."""
    return F.transform(_cut(line), lambda x: F.xxhash64(x))


def hashes(line: Column) -> Column:
    """The 64-bit hashes of the shingles, distinct and sorted."""
    return F.sort_array(F.array_distinct(_raw(line)))


def sizes_allow(x: Column, y: Column) -> Column:
    """Sets of these sizes can reach ``SIMILARITY``."""
    return F.least(x, y) * SIMILARITY[1] >= F.greatest(x, y) * SIMILARITY[0]


def similar(x: Column, y: Column, x_size: Column, y_size: Column) -> Column:
    """Exact Jaccard similarity of two sets, as arrays, reaches ``SIMILARITY``:
    n / (x_size + y_size - n) for n common members."""
    return F.size(F.array_intersect(x, y)) * sum(SIMILARITY) >= (x_size + y_size) * SIMILARITY[0]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, k1, k2) of every line with a word; (k1, k2) is
    the line's 128-bit identity."""
    rows = docs.filter("doc_id is not null").select(
        "doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "line_no", F.btrim("line", F.lit(SPACES)).alias("line")).filter("line <> ''")
    return rows.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def signatures(lines: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(k1, k2, doc, n, bands): distinct lines with their smallest document,
    number of occurrences and band keys.

    Every shingle is cut and hashed in generated code: characters of four
    bytes are cut at a constant cost, and the shingles of one line meet below
    the shuffle, where each changes the one bin it falls into."""
    bins = bands * rows
    wide = lines.select("doc_id", "k1", "k2", F.encode("line", "UTF-32").alias("b"))
    at = wide.select("doc_id", "k1", "k2", "b", F.explode(F.expr("sequence(0, length(b) div 4 - 1)")).alias("i"))
    sh = at.select("doc_id", "k1", "k2", "i", F.expr(f"xxhash64(substring(b, 4 * i + 1, {4 * SHINGLE}))").alias("h"))
    # the bin by the first bits of the hash, the value there by the last ones
    sh = sh.select("doc_id", "k1", "k2", "i", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 40) * {bins}, 24) as int)").alias("bin"),
                   F.expr(f"cast(h & {2**31 - 1} as int)").alias("v"))
    sig = sh.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.expr("count(*) FILTER (WHERE i = 0)").alias("n"),
                                     *[F.expr(f"min(v) FILTER (WHERE bin = {j})").alias(f"m{j}") for j in range(bins)])
    # where its own bin is empty a value is that of the first other one of its
    # group of bins, then of the other groups, in a fixed order; the values of
    # a group go to different bands
    one = ["k1", "k2", "doc", "n", *[f"m{j}" for j in range(bins)]]
    sig = sig.select(*one, *[F.coalesce(*[f"m{j}" for j in range(g * rows, g * rows + rows)]).alias(f"g{g}") for g in range(bands)])
    step = 1
    for part in _factors(bands):
        near = [[g - g // step % part * step + (g // step + d) % part * step for d in range(part)] for g in range(bands)]
        sig = sig.select(*one, *[F.coalesce(*[f"g{x}" for x in near[g]]).alias(f"g{g}") for g in range(bands)])
        step *= part
    keys = [F.xxhash64(F.lit(b), *[F.coalesce(f"m{j}", f"g{j // rows}") for j in range(b, bins, bands)]) for b in range(bands)]
    return sig.select("k1", "k2", "doc", "n", F.array(*keys).alias("bands"))


def _factors(n: int) -> list[int]:
    """The prime factors of n, smallest first."""
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out


def sketches(texts: DataFrame) -> DataFrame:
    """(k1, size, p0, p1, ...): of each line (k1, line) the number of its distinct
    shingles and, per bit of the words p, whether an odd number of them falls
    on that bit.  Each member that two sets do not share changes one bit at
    most, so the bits that differ are no more than these members."""
    one = texts.select("k1", F.explode(F.array_distinct(_raw(F.col("line")))).alias("h"))
    one = one.select("k1", F.expr(f"shiftright(h, 6) & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    return one.groupBy("k1").agg(F.count("*").alias("size"), *[
        F.expr(f"coalesce(bit_xor(bit) FILTER (WHERE word = {j}), 0L)").alias(f"p{j}") for j in range(WORDS)])


def sketches_allow(x_size: Column, y_size: Column) -> Column:
    """Sets of these sizes and sketches (p and v_p) can reach ``SIMILARITY``:
    similar sets have at most (x_size + y_size) / 9 members that only one has."""
    apart = F.bit_count(F.col("p0").bitwiseXOR(F.col("v_p0")))
    for j in range(1, WORDS):
        apart = apart + F.bit_count(F.col(f"p{j}").bitwiseXOR(F.col(f"v_p{j}")))
    return apart * sum(SIMILARITY) <= (x_size + y_size) * (SIMILARITY[1] - SIMILARITY[0])


def _verified(pairs: DataFrame, rows: DataFrame, as_set) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v, u_size, v_size) whose sets are similar;
    ``as_set`` makes the members, repeated or not, of the column ``x`` of
    ``rows`` (k1, x)."""
    left = pairs.distinct().join(rows.select(F.col("k1").alias("u"), F.col("x").alias("x")), "u")
    both = left.join(rows.select(F.col("k1").alias("v"), F.col("x").alias("y")), "v")
    same = similar(as_set(F.col("x")), as_set(F.col("y")), F.col("u_size"), F.col("v_size"))
    return stage(both.filter(same).select("u", "v"), "line-pairs")


def links(distinct: DataFrame, lines: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """Verified links (u, v) between similar lines, as k1 values; the graph
    joins every similar pair of lines that share a band."""
    with Stages() as tmp:
        return _links(distinct, lines, leaders, tmp)


def _links(distinct: DataFrame, lines: DataFrame, leaders: int, tmp: Stages) -> DataFrame:
    """``links``, with intermediate tables in ``tmp``."""
    member = distinct.select("k1", F.explode(F.array_distinct("bands")).alias("band"))
    many = member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    todo = tmp(member.join(many, "band").select("band", "n", "k1"), "line-bands")
    wanted = tmp(todo.select("k1").distinct(), "line-keys")
    text = lines.select("k1", "line").join(wanted, "k1", "left_semi")
    text = tmp(text.dropDuplicates(["k1"]), "line-texts")
    sketch = tmp(sketches(text), "line-sketches")
    text = text.withColumnRenamed("line", "x")
    order = Window.partitionBy("band").orderBy("k1")
    lead = todo.select("band", "k1", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= leaders)
    met = todo.select("band", F.col("k1").alias("u")).join(lead.select("band", F.col("k1").alias("v")), "band").filter("v < u")
    met = met.select("u", "v").distinct().join(sketch.withColumnRenamed("k1", "u"), "u").join(_other(sketch), "v")
    met = met.filter(sizes_allow(F.col("size"), F.col("v_size")) & sketches_allow(F.col("size"), F.col("v_size")))
    # texts move, an eighth of their sets
    found = _verified(met.select("u", "v", F.col("size").alias("u_size"), "v_size"), text, _raw)
    large = todo.filter(F.col("n") > leaders + 1).select("band", "k1")
    if large.isEmpty():
        return found
    cc = components(found).withColumnRenamed("node", "k1")
    large = large.join(cc, "k1", "left").select("band", "k1", F.coalesce("component", "k1").alias("root"))
    apart = large.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    rest = tmp(large.join(apart, "band", "left_semi").select("k1", "root").distinct().join(sketch, "k1"), "line-rest")
    sets = tmp(text.join(rest.select("k1"), "k1", "left_semi").select("k1", hashes(F.col("x")).alias("x")), "line-sets")
    return found.unionByName(_verified(_prefix_pairs(rest, sets, tmp), sets, lambda x: x))


def _other(rows: DataFrame) -> DataFrame:
    """``rows`` as the other side of pairs: v for k1, v_ before other names."""
    return rows.select(*[F.col(c).alias("v" if c == "k1" else f"v_{c}") for c in rows.columns])


def _prefix_pairs(rest: DataFrame, sets: DataFrame, tmp: Stages) -> DataFrame:
    """(u, v, u_size, v_size): the pairs of lines of ``rest`` (k1, root and
    sketch) with different roots that can be similar, among them all that are."""
    token = rest.join(sets, "k1").select("k1", "size", "root", F.explode("x").alias("token"))
    # tokens of one line alone come first in the order; their number is enough
    seen = token.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 1")
    token = token.join(seen, "token").withColumn("apart", F.expr("lo < hi"))
    row = token.groupBy("k1", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token", "apart"))).alias("all"))
    # all but ceil(s |set|) of the tokens, and one more
    length = F.floor(F.col("size") * (SIMILARITY[1] - SIMILARITY[0]) / SIMILARITY[1]).cast("int") + 1
    alone = (F.col("size") - F.size("all")).cast("int")
    row = row.select("k1", F.size("all").alias("n"), F.posexplode(F.slice("all", F.lit(1), F.greatest(length - alone, F.lit(0)))).alias("at", "t"))
    # left: the members from this token on, itself included
    row = row.filter("t.apart").select("k1", "t.token", (F.col("n") - F.col("at")).cast("long").alias("left"))
    row = tmp(row.join(rest, "k1"), "line-prefixes")
    met = row.join(_other(row).withColumnRenamed("v_token", "token"), "token").filter("v < k1 and root <> v_root")
    met = met.filter(sizes_allow(F.col("size"), F.col("v_size")))
    # at their first common token, similar sets have room for the members they need to share
    met = met.filter(F.least("left", "v_left") * sum(SIMILARITY) >= (F.col("size") + F.col("v_size")) * SIMILARITY[0])
    met = met.filter(sketches_allow(F.col("size"), F.col("v_size")))
    return met.select(F.col("k1").alias("u"), "v", F.col("size").alias("u_size"), "v_size")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, k1, root): the lines to remove, with the component
    (``root``) whose first line stays."""
    lines = occurrences(docs)
    with Stages() as tmp:
        rows = lines.select("doc_id", "line_no", "k1", "k2").join(_named(lines, tmp), ["k1", "k2"])
        # read twice: the texts are cut into lines once
        rows = stage(rows.select("doc_id", "line_no", "k1", "root", "home"), "line-rows")
    away = rows.filter("doc_id <> home").drop("home")
    home = rows.filter("doc_id = home").drop("home")
    first = home.groupBy("doc_id", "root").agg(F.min("line_no").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = home.join(first, ["doc_id", "root"]).filter("line_no > first").drop("first")
    return away.unionByName(again.select(away.columns))


def _named(lines: DataFrame, tmp: Stages) -> DataFrame:
    """(k1, k2, root, home): the lines that have equal or linked ones, with
    their component and the smallest document that holds a line of it."""
    distinct = tmp(signatures(lines), "line-signatures")
    cc = components(links(distinct, lines))
    named = distinct.join(cc, distinct.k1 == cc.node, "left").select(
        "k1", "k2", "doc", "n", F.coalesce("component", "k1").alias("root"), F.col("component").isNotNull().alias("linked"))
    named = named.filter("linked or n > 1")
    root = named.groupBy("root").agg(F.min("doc").alias("home"))
    return tmp(named.join(root, "root").select("k1", "k2", "root", "home"), "line-roots")


def _removed(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): per document the (line number, line key) to remove."""
    return removals(docs).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "k1")).alias("gone"))


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): per document the lines with a
    word, and the numbers (from 0) of those removed."""
    n = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"),
                        lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long")
    rows = docs.select("doc_id", n.alias("n_lines"))
    gone = _removed(docs).select("doc_id", F.array_sort(F.array_distinct(F.col("gone")["line_no"])).alias("removed"))
    rows = rows.join(gone, "doc_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; ``n_lines``
    (lines with a word before) and ``n_removed`` are added."""
    rows = docs.drop("n_lines", "n_removed")
    tmp = "gone"
    while tmp in rows.columns:
        tmp += "_"
    rows = rows.join(_removed(docs).withColumnRenamed("gone", tmp), "doc_id", "left")
    text = F.col("text").cast("string")
    parts = F.split(text, "\n")

    def is_gone(x: Column, i: Column) -> Column:
        key = F.struct(i.alias("line_no"), F.xxhash64(F.btrim(x, F.lit(SPACES))).alias("k1"))
        return F.array_contains(F.col(tmp), key)

    lines = F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    cut = F.size(F.filter(parts, is_gone))
    out = F.array_join(F.filter(parts, lambda x, i: ~is_gone(x, i)), "\n")
    return rows.select(*[F.when(F.col(tmp).isNull(), text).otherwise(out).alias("text") if c == "text" else F.col(c)
                         for c in docs.columns if c not in ("n_lines", "n_removed")],
                       F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"),
                       F.when(F.col(tmp).isNull(), 0).otherwise(cut).cast("long").alias("n_removed"))
