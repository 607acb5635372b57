"""Importance resampling, I-Match fingerprints and the filter audit against
plain Python versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from itertools import permutations

import pytest
import xxhash

import __spark_entry__ as E
from palletwise.llm import audit, imatch, resampling
from palletwise.llm.queries import REGISTRY
from tests.conftest import SF_SMALL

LONG = "lorem ipsum " * 40_000


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)] + ["Élan", "ÉLAN", "漢字", "x1", "a b"]
    out = [" ".join(rng.choices(vocab, k=rng.randint(0, 90))) for _ in range(120)]
    out += [out[3]] * 25 + [out[4].upper(), out[5] + "!", "  ", "", "\x00\x01", "a-b_c  D", "$ # * |", LONG, LONG + "x", "A" * 50, None, None]
    return out


def rows():
    out = [(i, t, random.Random(i).choice(["s1", "s2", None, ""]), f"r{i}") for i, t in enumerate(texts())]
    return out + [(7, out[7][1], "s1", "again"), (7, "another text under one id", "s2", "again"), (None, out[9][1], "s1", "null"), (None, "no id", "s1", "null")]


DOCS = "doc_id long, text string, source string, rank string"


# -- importance resampling


def brute_features(text, max_n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text) if w]
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute_scores(docs, target, max_n, buckets, percent):
    found = [brute_features(t, max_n) for _, t in docs]
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(bucket(x) for _, f in found for x in f)
    t = Counter(bucket(x) for text in target for x in brute_features(text, max_n)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(buckets)]
    out = []
    for (doc, _), (words, f) in zip(docs, found, strict=True):
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("max_n, buckets, percent", [(1, 10_000, 10), (3, 97, 50)])
def test_resampling_matches_brute_force(spark, max_n, buckets, percent):
    docs = spark.createDataFrame(rows(), DOCS).repartition(5)
    target = ["abc def x1", None, "", LONG, "Élan vital"]
    got = resampling.scores(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n, buckets, percent=percent)
    want = brute_scores([r[:2] for r in rows()], target, max_n, buckets, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_words_of_slices():
    import pyarrow as pa

    column = pa.array([t for _, t in random.Random(2).sample(list(enumerate(texts())), len(texts()))])
    for lo in range(len(column)):
        part = column.slice(lo, 1 + lo % 3)
        names, index, count = resampling.word_indices(part)
        want = [brute_features(t, 1)[0] for t in part.to_pylist()]
        assert [names[i] for i in index] == sum(want, []) and count.tolist() == [len(w) for w in want]


def test_draw_keeps_the_rows_and_replaces_clashing_columns(spark):
    docs, target = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([("abc",)], "text string")
    got = resampling.draw(docs, target, percent=30)
    assert got.columns == ["doc_id", "text", "source", "n_words", "n_features", "weight", "score", "rank"]
    got = got.collect()
    want = [r for r in brute_scores([r[:2] for r in rows()], ["abc"], 1, 10_000, 30) if r[5]]
    assert sorted(r["rank"] for r in got) == list(range(1, len(want) + 1))
    assert {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in rows()}
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in got) == sorted((r[5], r[0], r[4]) for r in want)


def test_resampling_of_a_hot_id_numbers_every_row(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 5L, id) AS doc_id", "repeat('word ', 25) AS text")
    got = resampling.scores(docs, docs.limit(1), percent=100)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.scores(none, none).count() == 0
    got = resampling.scores(spark.createDataFrame(rows(), DOCS), none)
    assert got.count() == len(rows()) and got.filter("weight is null").count() == 0
    with pytest.raises(ValueError):
        resampling.scores(none, none, max_n=0)


# -- I-Match


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def brute_terms(text):
    words = {w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w}
    return sorted(signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words)


def brute_signature(text, lexicon):
    every = brute_terms(text)
    found = [x for x in every if x in lexicon]
    out = [hash_longs(found or every) & 0xFFFFFFFF]
    for level in imatch.LEVELS:
        for c in range(min(imatch.SUBSETS, 1 << level)):
            held = [x for x in found if (x + (1 << 63)) >> (64 - level) == c]
            out.append(hash_longs(held) & 0xFFFFFFFF if held else 0)
    return out


def brute_lexicon(docs, band):
    n, df, weights = len(docs), Counter(), Counter(docs)
    for t in docs:
        w = imatch.UNIT if weights[t] == 1 or weights[t] * imatch.COPY_SHARE < n else imatch.UNIT // weights[t]
        df.update({x: w for x in brute_terms(t)})
        df["all"] += w
    total = df.pop("all", 0)
    lo, hi = (total / math.exp(x) for x in band)
    return {x for x, c in df.items() if hi <= c <= lo}


def brute_likeness(x, y):
    held = [(a, b) for a, b in zip(x, y, strict=True) if a or b]
    return sum(a == b for a, b in held) / len(held) if held else 1.0


def brute_compared(docs, band=imatch.IDF_BAND):
    docs = [(d, t or "") for d, t in docs]
    lexicon = brute_lexicon([t for _, t in docs], band)
    docs.sort(key=lambda r: (r[0] is None, -(r[0] or 0), (xxhash.xxh64_intdigest(r[1].encode(), 42)) >> 1))
    out = []
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        cut = t[: len(t) - half] + after[:half]
        x, y, z = (brute_signature(s, lexicon) for s in (t, cut, after))
        text = ["".join(f"{h:08x}" for h in s) for s in (x, y)]
        out.append((d, len(t), hashlib.sha256(cut.encode()).hexdigest(), *text, brute_likeness(x, y), brute_likeness(x, z)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_chars", [imatch.BUCKET_CHARS, 1000])
def test_imatch_matches_brute_force(spark, bucket_chars):
    docs = spark.createDataFrame(rows(), DOCS).repartition(4)
    got = imatch.compared(docs, bucket_chars=bucket_chars)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_compared([r[:2] for r in rows()])


def test_imatch_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = REGISTRY["op12_imatch_fingerprints"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_compared([tuple(r) for r in docs])


def test_imatch_fingerprints_alone(spark):
    docs = [r for r in rows() if r[0] not in (7, None)]
    lexicon = brute_lexicon([r[1] or "" for r in docs], imatch.IDF_BAND)
    got = imatch.fingerprints(spark.createDataFrame(docs, DOCS))
    assert sorted((r["doc_id"], r["signature"]) for r in got.collect()) == sorted((r[0], brute_signature(r[1] or "", lexicon)) for r in docs)


def test_imatch_of_one_row_no_row_and_a_hot_id(spark):
    assert imatch.compared(spark.createDataFrame([], DOCS)).count() == 0
    one = imatch.compared(spark.createDataFrame([(4, "abcd efgh", "s", "")], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() and one["near_next"] == 1.0
    hot = [(5 if i % 3 else i, f"text {i % 40} of the hot id") for i in range(300)]
    got = imatch.compared(spark.createDataFrame(hot, "doc_id long, text string"), bucket_chars=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_compared(hot)


def test_imatch_plan_is_native_with_one_shuffle_of_texts(spark):
    plan = REGISTRY["op12_imatch_fingerprints"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
    assert plan.count("Exchange hashpartitioning(bucket") == 1


# -- filter audit


def brute_audit(docs, labels):
    smallest, flags = {}, []
    for d, t, _, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    for d, t, part, _ in docs:
        t, part = t or "", part or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": d is not None and d > smallest[t]}
        mine = [x for x in labels if x[0] == d and d is not None]
        flags.append((part, {f for f in fails if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, taken = {}, Counter()
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in own if f in x[1]]
                taken[part, f] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing),
                                                    sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return sorted((*k, *v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items())


LABELS = "doc_id long, quality int, toxic int"


def labelled():
    return [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (7, 1, 0)]


@pytest.mark.parametrize("counters_per_text, most", [(16, 1 << 28), (1, 1 << 3)])
def test_audit_matches_brute_force(spark, monkeypatch, counters_per_text, most):
    if most < 100:  # a sketch so full that it clears little
        monkeypatch.setattr(audit, "BLOCK", 8)
    docs, labels = spark.createDataFrame(rows(), DOCS).repartition(4), spark.createDataFrame(labelled(), LABELS)
    got = audit.interactions(audit.mask_counts(docs, labels, counters_per_text, most))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows(), labelled())


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(none, labels).count() == 0
    assert sorted(map(tuple, audit.audit(spark.createDataFrame(rows(), DOCS), labels).collect())) == brute_audit(rows(), [])


def test_sketch_clears_unique_texts_and_no_repeat(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    found = audit.possible(audit.masks(docs), 1 << 15).filter("doc_id is not null").collect()
    seen = Counter(bytes(r["digest"]) for r in found)
    assert all(r["maybe"] for r in found if seen[bytes(r["digest"])] > 1)
    assert sum(not r["maybe"] for r in found) > 0.9 * sum(c == 1 for c in seen.values())


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_imatch_fingerprints", "op13_filter_audit"])
def test_registered(name):
    assert name in E.queries()
