"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

The lexicon is learned: words, and word beginnings (stems), that are much
more frequent in documents labelled toxic.  Its entries form a trie; the
Levenshtein automata of all entries are intersected with it and determinised
lazily, state by state, so a token is read once, a dictionary step a
character, and most tokens die after a few.  Longer words tolerate more
edits (misspellings), stems none.

Each match gets a context score from the window of tokens around it: quoted
or reported speech lowers it, address in the second person raises it.  The
sums of exact, misspelt and stem matches, told apart by context, their
density and their variety are the features of a logistic model, which is
fitted to labelled documents with out-of-fold lexicon weights.

Both fits use at most ``train_rows`` labelled documents, chosen by a hash of
the id; documents with crc32(id) mod 5 = 0 are held out from both.  Labels,
language, source and id never enter a score.

Defined results: null or blank text has no matches and gets the model's
score for that; without a toxic and a clean training document every score is
0; a null id is not held out; repeated rows are scored alike; labels that
are null or not 0/1 are ignored, of several labels of an id the largest
counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.session import ship_package, stage

TRAIN_ROWS = 20000
LEXICON_SIZE = 1500
MIN_SUPPORT = 3
MIN_LOG_ODDS = 1.5
STEM_MIN = 4
WINDOW = 6
EDGE = "\"'“”„‟«»‹›‘’`.,;:!?()[]{}<>#*$%&|~_-+=/\\@^"
QUOTES = set("\"“”„‟«»‹›`")
# cue words of the default context scores
REPORTING = {"said", "says", "wrote", "writes", "quoted", "quote", "called", "word", "term", "quoth"}
ADDRESS = {"you", "your", "yours", "you're", "u", "ur"}
FEATURES = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def tolerance(term: str) -> int:
    """Edits a word of the lexicon may be away."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher(dict):
    """token -> (kind, weight, entry) or None; kind 0 exact, 1 misspelt, 2
    stem.  The dictionary is a memo over the automaton, bounded in entries
    and in the characters of each: longer tokens are matched every time."""

    LIMIT = 400_000
    LONGEST = 64

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        # trie: children by character, entry by node, most edits below a node
        self.kids: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most: list[int] = [0]
        self.words, self.stems = words, stems
        for entry, edits, mark in [(w, tolerance(w), self.word) for w in words] + [(s, 0, self.stem) for s in stems]:
            node = 0
            self.most[0] = max(self.most[0], edits)
            for ch in entry:
                nxt = self.kids[node].get(ch)
                if nxt is None:
                    nxt = self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], edits)
            mark[node] = entry
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: list[dict[str, int]] = []
        self.accepts: list[tuple] = []  # best (word hit, stem hit) of each state
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """Number of the state of (trie node: fewest edits), closed under
        characters missing from the token; -1 if it is empty."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found.get(node, 99) < e:
                continue
            for child in self.kids[node].values():
                if e + 1 <= self.most[child] and e + 1 < found.get(child, 99):
                    found[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted((n, e) for n, e in found.items() if e <= self.most[n]))
        if not key:
            return -1
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.accepts.append(self._accept(key))
        return at

    def _accept(self, key: tuple) -> tuple:
        word = stem = None
        for node, e in key:
            w, s = self.word[node], self.stem[node]
            if w is not None and e <= tolerance(w):
                hit = (0 if e == 0 else 1, self.words[w] / (1 + e), w)
                if word is None or hit[1] > word[1]:
                    word = hit
            if s is not None and e == 0:
                stem = (2, self.stems[s], s)
        return word, stem

    def _next(self, state: int, ch: str) -> int:
        found: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.most[node] and e < found.get(node, 99):
                found[node] = e

        for node, e in self.states[state]:
            add(node, e + 1)  # a character too many
            for c, child in self.kids[node].items():
                add(child, e if c == ch else e + 1)
        to = self.step[state][ch] = self._state(found)
        return to

    def find(self, token: str):
        state, stem, step, accepts = self.start, None, self.step, self.accepts
        for ch in token:
            to = step[state].get(ch)
            if to is None:
                to = self._next(state, ch)
            if to < 0:
                return stem
            state = to
            stem = accepts[state][1] or stem
        best = accepts[state][0]
        return best if best is not None and (best[0] == 0 or stem is None) else stem

    def __missing__(self, token: str):
        if len(self.states) > 50_000:
            self._reset()
        elif len(self) >= self.LIMIT:
            self.clear()
        core = token.strip(EDGE)
        hit = self.find(core) if core else None
        if len(token) <= self.LONGEST:
            self[token] = hit
        return hit


def context(tokens: list[str], i: int) -> float:
    """Context score of the match at ``i``: below 1 for quotation, above 1
    for abuse addressed to someone."""
    near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
    score = 1.0
    if sum(t[0] in QUOTES or t.rstrip(".,;:!?")[-1:] in QUOTES for t in near) >= 2 or tokens[i][0] in QUOTES:
        score *= 0.25
    cores = {t.strip(EDGE) for t in near}
    if cores & REPORTING:
        score *= 0.5
    if cores & ADDRESS:
        score *= 1.5
    return score


def features(text: str, matcher: Matcher) -> list[float]:
    tokens = text.lower().split()
    sums, quoted, top, seen = [0.0, 0.0, 0.0], 0.0, 0.0, set()
    for i, hit in enumerate(map(matcher.__getitem__, tokens)):
        if hit is None:
            continue
        c = context(tokens, i)
        sums[hit[0]] += hit[1] * c
        if c < 1:
            quoted += hit[1]
        else:
            seen.add(hit[2])
        top = max(top, hit[1] * c)
    total = sum(sums)
    return [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(quoted),
            math.log1p(100 * total / max(20, len(tokens))), math.log1p(len(seen)), top]


def _terms(train: DataFrame) -> DataFrame:
    """(term, stem, fold, toxic, n): documents holding each word and each
    beginning of a word."""
    token = F.explode(F.array_distinct(F.transform(
        F.split(F.lower("text"), r"\s+"), lambda t: F.btrim(t, F.lit(EDGE)))))
    rows = train.select("doc_id", "fold", "toxic", token.alias("term")).filter(F.length("term").between(STEM_MIN, 40))
    stems = rows.select("doc_id", "fold", "toxic", F.explode(F.transform(
        F.sequence(F.lit(STEM_MIN), F.least(F.length("term"), F.lit(12))), lambda n: F.substring("term", F.lit(1), n))).alias("term")).distinct()
    return rows.withColumn("stem", F.lit(False)).unionByName(stems.withColumn("stem", F.lit(True)))


def learn_lexicon(train: DataFrame, size: int = LEXICON_SIZE) -> list[tuple]:
    """The ``size`` strongest (term, stem, counts by fold and label) of the
    training documents; the list is bounded by ``size``."""
    n = {(r.fold, r.toxic): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    tox, clean = sum(v for (_, t), v in n.items() if t), sum(v for (_, t), v in n.items() if not t)
    if not tox or not clean:
        return []
    counts = [F.count_if((F.col("fold") == f) & (F.col("toxic") == t)).alias(f"c{f}{t}") for f in (0, 1) for t in (0, 1)]
    rows = _terms(train).groupBy("term", "stem").agg(*counts)
    pos, neg = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10")
    odds = F.log((pos + 0.5) / (tox + 1)) - F.log((neg + 0.5) / (clean + 1))
    rows = rows.filter((pos >= MIN_SUPPORT) & (odds >= MIN_LOG_ODDS)).withColumn("gain", odds * pos)
    rows = rows.orderBy(F.desc("gain"), "term", "stem").limit(size)
    return [(r.term, r.stem, (r.c00, r.c01, r.c10, r.c11), n) for r in rows.collect()]


def _matcher(lexicon: list[tuple], folds: tuple[int, ...]) -> Matcher:
    """The matcher whose weights use the counts of ``folds`` only."""
    words, stems = {}, {}
    for term, stem, c, n in lexicon:
        pos, neg = sum(c[2 * f + 1] for f in folds), sum(c[2 * f] for f in folds)
        tox, clean = sum(n.get((f, 1), 0) for f in folds), sum(n.get((f, 0), 0) for f in folds)
        odds = math.log((pos + 0.5) / (tox + 1)) - math.log((neg + 0.5) / (clean + 1))
        if odds >= MIN_LOG_ODDS and pos >= (MIN_SUPPORT if len(folds) == 2 else 2):
            (stems if stem else words)[term] = odds
    return Matcher(words, stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50):
    """(mean, scale, weights) of a ridge logistic regression (Newton)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penal = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penal * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penal)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return mean, scale, w


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most ``train_rows`` labelled
    documents that are not held out; of rows repeating a ``doc_id`` the one
    with the smallest text hash is taken."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    own = own.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id")  # at most train_rows ids
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    rows = rows.groupBy("doc_id", "toxic", "fold").agg(first)
    return rows.select("doc_id", F.col("first.text").alias("text"), "toxic", "fold")


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, size: int = LEXICON_SIZE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    train = stage(training_rows(docs, labels, train_rows), "toxicity-train")
    lexicon = learn_lexicon(train, size)
    names = [f"x{i}" for i in range(FEATURES)]

    def measured(batches, matchers):
        import pyarrow as pa

        built = [_matcher(lexicon, f) for f in matchers]
        for part in _text.slices(batches):
            fold = part.column("fold").to_pylist() if len(built) > 1 else [0] * part.num_rows
            rows = [features(t.decode(), built[f]) for t, f in zip(_text.as_bytes(part.column("text")), fold, strict=True)]
            cols = np.array(rows, dtype=np.float64).reshape(-1, FEATURES)
            yield part, [pa.array(cols[:, i]) for i in range(FEATURES)], pa

    def out_of_fold(batches):
        for part, cols, pa in measured(batches, [(1,), (0,)]):
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *cols], ["toxic", *names])

    model = None
    if lexicon:
        schema = "toxic int, " + ", ".join(f"{n} double" for n in names)
        got = np.array([tuple(r) for r in train.select("toxic", "fold", "text").mapInArrow(out_of_fold, schema).collect()], dtype=np.float64)
        model = fit_logistic(got[:, 1:], got[:, 0])

    def run(batches):
        for part, cols, pa in measured(batches, [(0, 1)]):
            if model is None:
                p = np.zeros(part.num_rows)
            else:
                mean, scale, w = model
                x = np.stack([c.to_numpy() for c in cols], axis=1)
                p = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
