"""Mixing sources to target weights over a domain - language - source tree.

A token budget flows down the tree.  Each node splits what it was given
among its children in proportion to their target weights; a child that
cannot use its share (its documents, repeated at most ``max_epochs`` times,
hold fewer tokens) gives the shortage to its siblings first, and only what
all of them together cannot use stays with the parent's own siblings: a
subtree's capacity limits its share one level up.  A leaf's quota is then
filled from seeded epochs: whole passes over the leaf, and of the last epoch
the longest prefix, in that epoch's seeded order, that fits.

Everything is a DataFrame operation.  Budgets are integers; a split rounds
down, so at most one token per child is left over.  A leaf, however hot, is
never sorted as one: its documents are cut into slices of the hashed order,
slices are summed map-side, and only the slice the prefix ends in is ordered
document by document.

Defined results: null or blank text has no tokens and is selected as often
as its leaf's whole epochs, and with the prefix; null language, source or
domain is a branch of its own; repeated rows are separate documents (equal
places in the order, the prefix takes them one by one); weights that are
null, missing or not positive count as ``DEFAULT_WEIGHT``; an empty table
gives an empty result; columns ``domain``, ``epoch`` and ``n_tokens`` are
replaced, all others kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palletwise.llm.quality import words
from palletwise.session import stage

DEFAULT_WEIGHT = 100
SLICE_ROWS = 4096
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The default domain of a source: its numbers in fives (``src0``-``src4``
    is domain 0, ...); sources without a number share domain -1."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(source.isNotNull(), F.when(number == "", F.lit(-1)).otherwise(F.floor(number.try_cast("int") / 5).cast("int")))


def _weight(level: str, weights: dict) -> Column:
    """The integer weight of a node at ``level``: by its key, null key None."""
    col = F.col(level).cast("string")
    out = F
    for key, value in weights.get(level, {}).items():
        if value and value > 0:
            out = out.when(col.isNull() if key is None else col == F.lit(str(key)), F.lit(int(value)))
    return (out.otherwise(F.lit(DEFAULT_WEIGHT)) if out is not F else F.lit(DEFAULT_WEIGHT)).cast("long")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe keys, keeping ``a``'s key columns."""
    b = b.select(*[F.col(k).alias("_" + k) if k in keys else F.col(k) for k in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col("_" + k))
    return a.join(b, cond, how).drop(*["_" + k for k in keys])


def split(children: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Water-filling of ``budget`` (one value per parent) over ``children``
    with ``capacity`` and ``weight``: adds ``quota``.

    Children sorted by capacity per weight fill up one after the other; a
    child is full if its capacity is at most its share of what the fuller
    ones left.  All products are decimals, all quotients rounded down."""
    big = "decimal(38,0)"
    order = Window.partitionBy(*parents).orderBy(F.col("capacity").cast("double") / F.col("weight"), F.col(key).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rows = children.select(
        "*", F.coalesce(F.sum(F.col("capacity").cast("decimal(27,0)")).over(before), F.lit(0)).cast(big).alias("_used"),
        F.sum("weight").over(after).alias("_weights"))
    rows = rows.withColumn("_full", F.col("capacity").cast(big) * F.col("_weights")
                           <= (F.col("budget").cast(big) - F.col("_used")) * F.col("weight"))
    whole = Window.partitionBy(*parents)
    rows = rows.withColumn("_filled", F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity").cast("decimal(27,0)"))).over(whole), F.lit(0)).cast(big))
    rows = rows.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole))
    left = (F.col("budget").cast(big) - F.col("_filled")) * F.col("weight")
    share = ((left - left % F.col("_open").cast(big)) / F.col("_open").cast(big)).cast("long")
    return rows.withColumn("quota", F.when(F.col("_full"), F.col("capacity")).otherwise(share)).drop(
        "_used", "_weights", "_full", "_filled", "_open")


def quotas(leaves: DataFrame, budget: int, weights: dict | None = None, max_epochs: int = 2) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) -> the same with ``quota``:
    the leaf's token budget."""
    weights = weights or {}
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    given = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("long"))
        else:
            nodes = _same(nodes, given, keys[:-1])
        given = split(nodes, keys[:-1], level).select(*keys, F.col("quota").alias("budget"))
    return _same(leaves.drop("capacity"), given.withColumnRenamed("budget", "quota"), list(LEVELS))


def _place(seed: int, epoch: Column) -> Column:
    """A document's place in the order of an epoch: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, budget: int | None = None, weights: dict | None = None, max_epochs: int = 2,
        seed: int = 17, domain: Column | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The selected rows of ``docs``, once per epoch that takes them, with
    ``domain``, ``epoch`` (from 0) and ``n_tokens`` added.

    ``budget`` None means as many tokens as the documents hold."""
    if max_epochs < 1:
        raise ValueError("max_epochs must be positive")
    dom = domain_of(F.col("source").cast("string")) if domain is None else domain
    # the caller's columns travel as one, so that none clashes with those here
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("domain", "epoch", "n_tokens")])
    rows = docs.select(own.alias("row"), "doc_id", dom.alias("domain"), "lang", "source",
                       F.size(words(F.col("text").cast("string"))).cast("long").alias("n_tokens"))
    light = stage(rows.select("doc_id", *LEVELS, "n_tokens"), "mix-tokens")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    if budget is None:
        budget = light.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = quotas(leaves, int(budget), weights, max_epochs)
    plan = stage(plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long"))
                 .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
                 .withColumn("slices", F.pow(F.lit(16), F.least(F.lit(6), F.ceil(F.log(F.greatest(F.lit(1.0), F.col("docs") / slice_rows)) / F.log(F.lit(16.0))))).cast("long"))
                 .withColumn("digits", F.round(F.log(F.col("slices").cast("double")) / F.log(F.lit(16.0))).cast("int")), "mix-plan")
    # one row a leaf: no leaf's documents need to meet in one task
    small = plan.count() <= BROADCAST_LEAVES
    # the slice of each leaf that its last epoch's prefix ends in
    open_ = _same(light, plan.filter("tokens > 0").select(*LEVELS, "epochs", "rest", "digits"), list(LEVELS))
    open_ = open_.withColumn("place", _place(seed, F.col("epochs"))).withColumn("slice", F.expr("substring(place, 1, digits)"))
    sums = open_.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice")
    sums = sums.withColumn("before", F.sum("t").over(upto) - F.col("t"))
    last = sums.filter("before + t > rest").groupBy(*LEVELS).agg(F.min("slice").alias("slice"))
    cut = _same(sums, last, [*LEVELS, "slice"]).select(*LEVELS, "slice", "before")
    inside = _same(open_, cut, [*LEVELS, "slice"])
    step = Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(step))
    # the place of the first document that no longer fits, and how many of
    # the rows at that very place (repeated rows) still do
    over = inside.filter("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("place", "upto")).alias("stop"))
    tied = _same(inside, over.select(*LEVELS, F.col("stop.place").alias("place")), [*LEVELS, "place"]).groupBy(*LEVELS).agg(
        F.first("place").alias("stop"), F.count_if(F.col("upto") <= F.col("rest")).alias("fit"))
    ends = _same(plan, tied, list(LEVELS), "left").select(*LEVELS, "tokens", "epochs", "stop", "fit")
    ends = stage(ends, "mix-ends")
    got = _same(rows, F.broadcast(ends) if small else ends, list(LEVELS)).withColumn("place", _place(seed, F.col("epochs")))
    at_stop = F.col("place") == F.col("stop")
    # rows at the stop place are told apart by their number of tokens, then
    # by an arbitrary but fixed order of their text
    tie = Window.partitionBy(*LEVELS, "place").orderBy("doc_id", "n_tokens", F.xxhash64("row.text"))
    stopped = got.filter(at_stop & (F.col("fit") > 0)).withColumn("nth", F.row_number().over(tie)).filter("nth <= fit").drop("nth")
    prefix = (F.col("tokens") > 0) & (F.col("epochs") < max_epochs) & (F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    times = F.col("epochs") + F.when(prefix, F.lit(1)).otherwise(F.lit(0))
    taken = got.withColumn("times", times).filter("times > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    taken = taken.select("row.*", "domain", "epoch", "n_tokens")
    return taken.unionByName(stopped.select("row.*", "domain", F.col("epochs").alias("epoch"), "n_tokens"))
