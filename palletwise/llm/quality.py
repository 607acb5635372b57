"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measures`` holds the statistics of a text as Column expressions;
``RULES`` are named rejection tests on them.  ``estimate`` counts every rule's
rejections and times its own work, without its job's, on a bounded sample of
the columns the cascade reads; ``cascade`` orders the rules
by rejections per second and evaluates them as one CASE expression, so a
later rule only runs on the texts that every earlier one let through.  The
order changes the work, never the verdict: a text is kept if no rule rejects
it.

A word is a run outside ``[\\x20\\x09-\\x0D]``.  Defined results: null or
blank text has no words, no lines and fails ``min_words``; texts of any
length are measured whole; repeated rows are judged alike; an empty table
gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwise.session import Stages

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
REPEAT_WINDOW = 8
SAMPLE_ROWS = 2000
SAMPLE_PARTS = 8  # tasks that time a rule
SAMPLE_TIMES = 8  # runs of a rule on each row of the sample


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text (empty array for null)."""
    return F.array_remove(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPACE), "")


def lines(text: Column) -> Column:
    """The ``\\n``-separated lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def word_chars(w: Column) -> Column:
    return F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))


def repeat_words(w: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words lying in a window of ``size`` words that occurs at least twice
    in the text, the first occurrence included.

    Windows are hashed once; only a text with two equal hashes is sorted by
    hash, its neighbours compared word by word, and the covered words counted
    from the sorted starts of the repeated windows."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.transform(F.sequence(F.lit(1), n), lambda k: F.coalesce(
            F.least(F.get(starts, k) - F.get(starts, k - 1), F.lit(size)), F.lit(size)))
        return F.when(n > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))

    def repeated(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, size) == F.slice(w, b["i"] + 1, size)), F.lit(False))

        starts = _let(order, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, k: same(x, F.when(k > 0, F.get(s, k - 1))) | same(x, F.get(s, k + 1))), lambda x: x["i"])))
        return _let(starts, covered)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) >= size + 1, found).otherwise(F.lit(0).cast("long"))


def stutter(w: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, F.greatest(i - 1, F.lit(0))) == x))).cast("long")


def measures(text: Column, w: Column) -> dict[str, Column]:
    """Statistics of a text; ``w`` is its word array as a column."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": word_chars(w),
        "n_symbols": count_of(text, SYMBOLS),
        "n_lines": F.size(lines(text)).cast("long"),
        "n_dup_lines": _let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_capitals": count_of(text, "[A-Z]"),
        "n_shouts": count_of(text, "!"),
        "n_stutter": stutter(w),
    }


#: A text is rejected by a rule if its test is true.
RULES = {
    "min_words": lambda m: m["n_words"] < MIN_WORDS,
    "repeats": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "dup_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "capitals": lambda m: 10 * m["n_capitals"] > 3 * m["word_chars"],
    "shouts": lambda m: 10 * m["n_shouts"] > 3 * m["n_words"],
    "stutter": lambda m: 10 * m["n_stutter"] > 3 * m["n_words"],
}
BASE = ("min_words", "repeats")
#: The measures ``verdicts`` takes of every text, before the cascade.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(sample: DataFrame, tests: dict[str, Column], repeats: int = 2, times: int = SAMPLE_TIMES) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) of each test on ``sample``, sorted by
    rejection per cost, then cost.

    A rule's seconds are those of one aggregate that runs it ``times`` times
    on every row, less those of the same aggregate with an empty test that
    reads the same columns; the best of ``repeats`` runs counts.  What is
    left is the rule's own work, not the scheduling of its job.  Costs below
    a hundredth of the empty run cannot be told apart and count as that."""
    rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_time"))
    empty = F.lit(True)
    for name in sample.columns:
        empty &= F.col(name).isNull()

    def seconds(test: Column) -> tuple[float, float]:
        job = rows.agg(F.count("*").alias("n"), F.count_if(test).alias("bad"))
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            row = job.first()
            best = min(best, time.perf_counter() - t0)
        return row.bad / max(1, row.n), best

    seconds(empty)  # the first run also reads file footers
    base = seconds(empty)[1]
    out = []
    for name, test in tests.items():
        bad, spent = seconds(test)
        out.append((name, bad, max(spent - base, base / 100)))
    return sorted(out, key=lambda r: (-r[1] / r[2], r[2], r[0]))


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7, computed: tuple[str, ...] = ()) -> DataFrame:
    """About ``sample_rows`` rows of ``docs`` with the columns the cascade
    reads: ``text``, ``w`` and the measures named in ``computed``.  Only the
    order of the cascade depends on them."""
    n = docs.count()
    part = docs if n <= sample_rows else docs.sample(min(1.0, sample_rows / n), seed)
    part = part.select(F.col("text").cast("string").alias("text")).repartition(SAMPLE_PARTS)
    part = part.select("text", F.explode(F.array(words(F.col("text")))).alias("w"))
    m = measures(F.col("text"), F.col("w"))
    return part.select("text", "w", *[m[c].alias(c) for c in computed])


def cascade(tests: dict[str, Column], order: list[str]) -> Column:
    """True if a test rejects the row; a test only runs where all before it
    in ``order`` passed."""
    out = F
    for name in order:
        out = out.when(tests[name], F.lit(True))
    return out.otherwise(F.lit(False)) if order else F.lit(False)


def ordered(docs: DataFrame, rules=None, sample_rows: int = SAMPLE_ROWS, computed: tuple[str, ...] = ()) -> list[str]:
    """The rules' names in cascade order for ``docs``; measures named in
    ``computed`` are columns already when the cascade runs."""
    rules = RULES if rules is None else rules
    m = measures(F.col("text"), F.col("w")) | {c: F.col(c) for c in computed}
    with Stages() as tmp:
        sample = tmp(sampled(docs, sample_rows, computed=computed), "quality-sample")
        return [name for name, _, _ in estimate(sample, {k: r(m) for k, r in rules.items()})]


def keep(docs: DataFrame, rules=None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    rules = RULES if rules is None else rules
    order = ordered(docs, rules, sample_rows)
    names = docs.columns
    tmp = "w"
    while tmp in names:
        tmp += "_"
    text = F.col("text").cast("string")
    m = measures(text, F.col(tmp))
    # the one-element generator keeps the words a column: a filter on them
    # would be pushed below a plain projection and split the text once a use
    rows = docs.select("*", F.explode(F.array(words(text))).alias(tmp))
    return rows.filter(~cascade({k: r(m) for k, r in rules.items()}, order)).drop(tmp)


def verdicts(docs: DataFrame, rules=None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept) of each row: the base statistics of every text, and
    the cascade over the remaining rules for the texts that pass the base."""
    rules = RULES if rules is None else rules
    rest = {k: r for k, r in rules.items() if k not in BASE}
    order = ordered(docs, rest, sample_rows, tuple(MEASURED))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.explode(F.array(words(text))).alias("w"))
    m = measures(F.col("text"), F.col("w"))
    base = MEASURED
    rows = rows.select("doc_id", "text", "w", F.explode(F.array(F.struct(*[m[c].alias(c) for c in base]))).alias("b"))
    rows = rows.select("doc_id", "text", "w", "b.*")
    m |= {c: F.col(c) for c in base}
    failed = RULES["min_words"](m) | RULES["repeats"](m)
    rejected = cascade({k: r(m) for k, r in rest.items()}, order)
    return rows.select("doc_id", *base, failed.alias("base_failed"),
                       F.when(failed, F.lit(False)).otherwise(~rejected).alias("kept"))
