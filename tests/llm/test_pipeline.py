"""The pipeline's stages against brute-force versions."""

import random

import corpus_pipeline as P
from tests.llm.test_lines import WS, brute as brute_lines
from tests.llm.test_quality_tokens_licenses_toxicity import brute_quality
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_topk_packing_mixing import brute_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for i in range(90):
        body = "\n".join(" ".join(rng.choices(vocab, k=rng.randint(8, 70))) for _ in range(rng.randint(1, 5)))
        rows.append([i, body, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src8", None]), len(body)])
    for i in range(20):  # near copies: one more word at the end of a long text
        src = rows[i]
        rows.append([200 + i, src[1].replace("\n", " ") + " tail", *src[2:]])
        rows.append([300 + i, src[1], *src[2:]])
    rows += [[400, None, "en", "src0", 0], [401, "", "en", "src0", 0], [402, "# " * 50, "en", "src0", 100], [403, "x y z", "en", "src1", 5]]
    return [tuple(r) for r in rows]


def test_stages(spark):
    rows = make()
    frame = spark.createDataFrame(rows, DOCS)

    kept = [r for r in rows if brute_quality(r[1])[-1]]
    got = P.quality_rules(spark, frame, "")
    assert got.columns == P.COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(kept) and len(kept) < len(rows)

    gone = brute_lines([r[:2] for r in kept])
    after = []
    for r in kept:
        parts = r[1].split("\n")
        left = [x for i, x in enumerate(parts) if (r[0], i) not in gone]
        if any(x.strip(WS) for x in left):
            after.append((r[0], "\n".join(left), r[2], r[3], len("\n".join(left)) if len(left) < len(parts) else r[4]))
    got = P.line_dedup(spark, spark.createDataFrame(kept, DOCS), "")
    assert got.columns == P.COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(after) and len(after) < len(kept)

    comps = brute_components([(r[0], brute_fp(r[1])) for r in after])
    single = [r for r, c in zip(after, comps, strict=True) if r[0] == c]
    got = P.near_dedup(spark, spark.createDataFrame(after, DOCS), "")
    assert sorted(tuple(r) for r in got.collect()) == sorted(single)
    near = [(i, t, "en", "src0", 1) for i, t in enumerate(["a b c d e f g " * 40, "a b c d e f g " * 40 + "h", "q " * 30])]
    assert {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(near, DOCS), "").collect()} == {
        i for (i, *_), c in zip(near, brute_components([(r[0], brute_fp(r[1])) for r in near]), strict=True) if i == c}

    total = sum(len(r[1].split()) for r in single)
    picked = brute_mix([r[:4] for r in single], total, {}, 2, 17)
    got = P.source_mixing(spark, spark.createDataFrame(single, DOCS), "").collect()
    by_id = {r[0]: r for r in single}
    assert sorted(tuple(r) for r in got) == sorted(by_id[d] for d, _ in picked)

    packed = P.best_fit_packing(spark, spark.createDataFrame([by_id[d] for d, _ in picked], DOCS), "").collect()
    assert sum(p.n_tokens for p in packed) == sum(len(by_id[d][1].split()) for d, _ in picked)


def test_unlike_texts_under_one_id_both_stay(spark):
    a, b, c = "a b c d e f g " * 40, "q r s t u v w " * 40, "h i j k l m n " * 40
    rows = [(5, a, "en", "src0", 1), (5, b, "en", "src0", 1), (5, b, "de", "src1", 1), (7, b, "en", "src0", 1),
            (3, c, "en", "src0", 1), (5, c, "en", "src0", 1), (None, a, "en", "src0", 1)]
    for order in (rows, rows[::-1]):
        got = [tuple(r) for r in P.near_dedup(spark, spark.createDataFrame(order, DOCS), "").collect()]
        assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"bin_id", "bin_length", "n_tokens"} <= set(out.columns)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]


def test_empty_and_null(spark):
    for rows in ([], [(None, None, None, None, None)] * 2):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, "")
        assert docs.count() == 0
