"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palletwise.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fp(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    """rows: (doc_id, fp) -> list of component ids."""
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for c in comp:
        ids = [rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None]
        out.append(min(ids) if ids else None)
    return out


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 200])
def test_bit_sliced_distances(n):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 2**63, n, dtype=np.uint64)
    fp[n // 2 :] = fp[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n - n // 2, dtype=np.uint64))
    for radius in (0, 1, 2, 3, 4, 7):
        q, at = simhash.block_within(fp, simhash.bit_planes(fp), n, radius)
        want = {(i, j) for i in range(n) for j in range(n) if int(fp[i] ^ fp[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), at.tolist(), strict=True)) == want
        assert simhash.pairs_within(fp, fp[::-1].copy(), radius).tolist() == [
            int(a ^ b).bit_count() <= radius for a, b in zip(fp, fp[::-1], strict=True)]


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "É", "delta", "of", "the"]
    texts = [None, "", " \n\t", "one", "two words", "x" * 30000] + [
        " ".join(rng.choices(vocab, k=rng.randint(1, 200))) for _ in range(60)]
    texts += [t + " tail" for t in texts[20:50] if t] + texts[10:20]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[30], "a", "b"), (7, texts[7], "a", "b")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    want = sorted(((d, fp, c) for (d, fp), c in zip(fps, brute_components(fps), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == want
    assert any(c != d for d, _, c in want)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_links_lose_no_component(spark, block_rows):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:  # chains and one dense group
        x = b
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i, 20)}
    rows = sorted((f - 2**64 if f >= 2**63 else f) for f in fps)
    df = spark.createDataFrame([(f,) for f in rows], "fp long")
    edges = simhash.links(df, 2, block_rows).collect()
    assert all(((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 2 for e in edges)
    parent = {f: f for f in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(e.u), find(e.v)
        parent[max(a, b)] = min(a, b)
    want = brute_components([(f, f & (2**64 - 1)) for f in rows])
    assert [find(f) for f in rows] == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.near_duplicates(
        spark.createDataFrame([(1, None, "", "")], SCHEMA)).select(F.col("fp")).first()[0] == 0
