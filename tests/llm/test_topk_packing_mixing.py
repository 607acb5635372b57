"""Top-k search, packing and mixing against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palletwise.llm import mixing, packing, queries, topk

VECTORS = "vec_id long, embedding array<float>, score string, rank string"
DOCS = "doc_id long, text string, lang string, source string, domain string, epoch string"


def brute_top(rows, k, is_query):
    live = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(64.0 * float(np.float32(x))) for x in v]))
    out = []
    for q in sorted({i for i, _ in live}):
        if not is_query(q):
            continue
        asked = min(v for i, v in live if i == q)
        scored = sorted((-sum(a * b for a, b in zip(asked, v, strict=False)), i) for i, v in live if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_outliers_and_repeated_ids(spark):
    rows = [(20, [1e9]), (1, [1.0]), (2, [0.5]), (40, [0.25]), (1, [5.0]), (1, [5.0]), (20, [2e9]), (3, [-1e6, 4.0]), (60, [1.0, 1e7]), (4, [0.0, 1e7])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20, shard_rows=3, query_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20, lambda i: i % 20 == 0)
    beyond = spark.createDataFrame([(20, [1e12]), (1, [1e12])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        topk.top_k(beyond, F.col("vec_id") % 20 == 0).collect()


@pytest.mark.parametrize(("n", "d", "k", "scale"), [(400, 8, 20, 1.0), (60, 64, 20, 100.0), (300, 3, 5, 1e6), (12, 4, 20, 1.0)])
def test_top_k(spark, n, d, k, scale):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in (rng.standard_normal(d) * scale).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(30)]  # ties
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")]), (1060, [float("inf")]), (1080, []), (None, [1.0] * d),
             (1100, [1.0]), (5, rows[7][1]), (20, rows[20][1]), (-20, [0.0] * d)]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k, shard_rows=100, query_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, k, lambda i: i % 20 == 0)


def test_maxscore_prunes_exactly():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((3000, 16)) * np.geomspace(1, 300, 16)).astype(np.int64)
    shard = topk.Shard(np.arange(3000), x, 128)
    for q in range(0, 200, 20):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(3000) if i != q)[:10]
        assert topk.maxscore(shard, q, x[q], 10, np.float64) == [(i, -s) for s, i in want]


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(OverflowError):
        topk._arithmetic(1e30)


def brute_pack(pieces, lengths, overhead):
    used, size, touched = [], [], []
    for n, p in enumerate(pieces):
        fit = [(size[b] - used[b], -touched[b], b) for b in range(len(used)) if size[b] - used[b] >= p]
        if fit:
            b = min(fit)[2]  # of equal rooms the one filled last
        else:
            free = sum(s - u for s, u in zip(size, used, strict=True))
            coming = pieces[n + 1 :]

            def price(c):
                small = min(sum(x for x in pieces if x <= c - p), sum(coming))
                return ((c + overhead) / (p + max(0, min(c - p, small - free))), c)

            b = len(used)
            size.append(min((c for c in lengths if c >= p), key=price))
            used.append(0)
            touched.append(0)
        used[b] += p
        touched[b] = n
    return sorted(used), sorted(min(c for c in lengths if c >= u) for u in used)


def test_best_fit_rule():
    rng = random.Random(2)
    for _ in range(40):
        lengths = tuple(sorted(rng.sample(range(4, 60), 3)))
        pieces = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(0, 60))), reverse=True)
        bins, offsets, sizes = packing.best_fit(pieces, lengths, 3)
        fill = [0] * len(sizes)
        for p, b, o in zip(pieces, bins, offsets, strict=True):
            assert o == fill[b]
            fill[b] += p
        assert sorted(fill) == brute_pack(pieces, lengths, 3)[0]
        assert [min(c for c in lengths if c >= f) for f in fill] == sizes


def test_pack_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 50, 700, 20000])), "", "", "", "") for i in range(80)]
    rows += [(90, None, "", "", "", ""), (91, " \n", "", "", "", ""), (5, "a b", "", "", "", ""), (5, "a b", "", "", "", ""),
             (None, "a", "", "", "", "")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), (16, 512, 4096), shard_pieces=40).collect()
    want = sorted((str(r[0]), len((r[1] or "").split())) for r in rows if (r[1] or "").split())
    assert sum(g.n_tokens for g in got) == sum(n for _, n in want)
    docs, bins = {}, {}
    for g in got:
        docs.setdefault(str(g.doc_id), []).append((g.start, g.n_tokens))
        bins.setdefault((g.bin_id, g.bin_length), []).append((g.bin_offset, g.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert length == min(c for c in (16, 512, 4096) if c >= at)
    long = next(str(r[0]) for r in rows if r[1] and len(r[1]) > 30000)
    at = 0
    for start, n in sorted(docs[long]):
        assert start == at
        at += n
    assert at == 20000
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def brute_mix(rows, budget, weights, max_epochs, seed):
    leaves = {}
    for d, t, lang, src in rows:
        dom = None if src is None else (int(src[3:]) // 5 if src[3:].isdigit() else -1)
        leaves.setdefault((dom, lang, src), []).append((d, len((t or "").split())))

    def fill(parent, depth, given):
        kids = {}
        for leaf, docs in leaves.items():
            if leaf[:depth] == parent:
                kids[leaf[depth]] = kids.get(leaf[depth], 0) + max_epochs * sum(n for _, n in docs)
        w = {k: weights.get(mixing.LEVELS[depth], {}).get(None if k is None else str(k), mixing.DEFAULT_WEIGHT) for k in kids}
        full, left = set(), given
        while True:
            rest = [k for k in kids if k not in full]
            more = {k for k in rest if kids[k] * sum(w[r] for r in rest) <= left * w[k]}
            if not more:
                break
            full |= more
            left -= sum(kids[k] for k in more)
        rest = [k for k in kids if k not in full]
        quota = {k: kids[k] if k in full else int(Fraction(left * w[k], sum(w[r] for r in rest))) for k in kids}
        if depth == 2:
            return {(*parent, k): q for k, q in quota.items()}
        return {x: q for k in kids for x, q in fill((*parent, k), depth + 1, quota[k]).items()}

    out = []
    quota = fill((), 0, budget) if leaves else {}
    for leaf, docs in leaves.items():
        total = sum(n for _, n in docs)
        epochs = quota[leaf] // total if total else 1
        out += [(d, e) for d, _ in docs for e in range(epochs)]
        if not total or epochs >= max_epochs:
            continue

        def place(d, e=epochs):
            return hashlib.md5(f"{seed}:{e}:{'null' if d is None else d}".encode()).hexdigest()

        left = quota[leaf] - epochs * total
        for d, n in sorted(docs, key=lambda x: (place(x[0]), x[1])):
            if n > left:
                break
            left -= n
            out.append((d, epochs))
    return sorted(out, key=str)


@pytest.mark.parametrize(("budget", "epochs", "slice_rows"), [(None, 2, 4096), (3000, 3, 1), (40000, 4, 2), (0, 1, 4096)])
def test_mix(spark, budget, epochs, slice_rows):
    rng = random.Random(9)
    srcs = ["src0", "src1", "src7", "src12", None, "books"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["en", "de", None]), rng.choice(srcs + ["src0"] * 6))
            for i in range(200)]
    rows += [(300, None, "en", "src0"), (301, "", "xx", "src99"), (302, "a b c", "zz", "src3"), (5, "a b c", "en", "src0"),
             (5, "a b c", "en", "src0"), (None, "q r", "en", "src1")]
    weights = {"lang": {"en": 300, None: 7}, "source": {"src0": 10, "src12": 1}, "domain": {"0": 500}}
    helpers = ("tokens", "place", "stop", "fit", "epochs", "row", "times", "rest", "capacity", "_domain")
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).withColumns({c: F.lit(c) for c in helpers})
    got = mixing.mix(df, budget, weights, epochs, 17, slice_rows=slice_rows)
    assert got.columns == ["doc_id", "text", "lang", "source", *helpers, "domain", "epoch", "n_tokens"]
    assert all(r[c] == c for r in got.select(*helpers).distinct().collect() for c in helpers)
    total = sum(len((r[1] or "").split()) for r in rows) if budget is None else budget
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == brute_mix(rows, total, weights, epochs, 17)


def test_mixing_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in docs]
    weights = {level: {str(k): w for k, w in of.items()} for level, of in queries.MIX_WEIGHTS.items()}
    total = sum(len((r[1] or "").split()) for r in rows)
    got = queries.op3_source_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.epoch) for r in got), key=str) == brute_mix(rows, total, weights, 2, 17)
    share = {d: sum(r.n_tokens for r in got if r.domain == d) / total for d in range(4)}
    assert share[0] > share[1] > share[2] > share[3] and abs(share[3] - 0.1) < 0.05


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
