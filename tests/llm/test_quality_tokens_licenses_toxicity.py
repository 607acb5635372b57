"""Quality rules, token counts, license scans and toxicity."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palletwise.llm import licenses, quality, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, w string, kept string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", "x", "y") for i, t in texts], DOCS)


def brute_quality(t):
    import re

    b = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", b) if x]
    lines = [x for x in b.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
    n, chars = len(w), sum(map(len, w))
    sym, dup, rep = len(re.findall(r"[#*$%&|<>]", b)), len(lines) - len(set(lines)), len(cover)
    failed = n < 20 or 100 * rep > 30 * n
    bad = (10 * sym > n or chars < 2 * n or chars > 15 * n or 2 * dup > len(lines)
           or 10 * len(re.findall("[A-Z]", b)) > 3 * chars or 10 * b.count("!") > 3 * n
           or 10 * sum(x == y for x, y in zip(w, w[1:], strict=False)) > 3 * n)
    return n, chars, sym, dup, rep, failed, not failed and not bad


def quality_texts():
    rng = random.Random(6)
    vocab = ["alpha", "b", "É#", "THE", "a b", "x" * 40, "wow!", "the", "$$"]
    texts = [None, "", " \n\t\x0b", "one", "a " * 30000, "same line\n" * 40, "A B " * 20, "w x " * 25]
    for _ in range(80):
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\t", "\x0b", "\r\n"])
                             for _ in range(rng.choice([5, 19, 20, 40, 200]))))
    base = [f"word{i}" for i in range(60)]
    texts += [" ".join(base), " ".join(base + base[:8]), " ".join(base + base[:7]), " ".join(base * 2), " ".join(base[:8] * 2 + base)]
    return list(enumerate(texts)) + [(3, "one"), (None, " ".join(base))]


def test_quality_against_brute_force(spark):
    rows = quality_texts()
    df = frame(spark, rows)
    got = sorted((tuple(r) for r in quality.verdicts(df, sample_rows=20).collect()), key=str)
    want = sorted(((i, *brute_quality(t)) for i, t in rows), key=str)
    assert got == want
    assert {w[-1] for w in want} == {True, False}
    kept = quality.keep(df, sample_rows=50)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").collect()) == sorted(
        (i, t) for i, t in rows if i is not None and brute_quality(t)[-1])


def test_cascade_order_and_plan(spark):
    df = frame(spark, quality_texts())
    sample = quality.sampled(df, 1000)
    m = quality.measures(F.col("text"), F.col("w"))
    found = quality.estimate(sample, {k: r(m) for k, r in quality.RULES.items()}, 1)
    assert sorted(f[0] for f in found) == sorted(quality.RULES)
    rate = [share / cost for _, share, cost in found]
    assert rate == sorted(rate, reverse=True)
    plan = quality.verdicts(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = frame(spark, [])
    assert quality.verdicts(empty).count() == 0 and quality.keep(empty).count() == 0


def test_costly_rules_of_equal_rejection_sort_last(spark):
    text = " ".join(f"word{i % 97}" for i in range(400))
    df = frame(spark, [(i, text if i % 2 else "short one") for i in range(1000)])
    rules = {
        "a_windows": lambda m: (m["n_repeat_words"] >= 0) & (m["n_words"] < quality.MIN_WORDS),
        "b_words": lambda m: m["n_words"] < quality.MIN_WORDS,
        "c_never": lambda m: m["n_words"] < 0,
        "d_never_stutters": lambda m: m["n_stutter"] > m["n_words"],
    }
    for _ in range(3):
        assert quality.ordered(df, rules) == ["b_words", "a_windows", "c_never", "d_never_stutters"]
    # a measure that is a column already costs its rule nothing
    sample = quality.sampled(df, computed=("n_repeat_words",))
    assert sample.columns == ["text", "w", "n_repeat_words"]
    m = quality.measures(F.col("text"), F.col("w"))
    want = {(r.text, r.n) for r in sample.select("text", m["n_repeat_words"].alias("n")).collect()}
    assert {(r.text, r.n_repeat_words) for r in sample.collect()} == want


def brute_attribute(token_len, section_len, rule):
    out, owner = [0] * len(section_len), np.repeat(np.arange(len(section_len)), section_len)
    at = 0
    for n in token_len:
        own = owner[at : at + n]
        at += n
        most = Counter(own.tolist())
        out[own[0] if rule == "start" else own[-1] if rule == "end" else min(most, key=lambda s: (-most[s], s))] += 1
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_interval_join(rule):
    rng = random.Random(8)
    for _ in range(200):
        sections = [rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(rng.randint(1, 9))]
        left, parts = sum(sections), []
        while left:
            parts.append(rng.randint(1, min(left, 9)))
            left -= parts[-1]
        got = tokens.attribute(np.cumsum(parts, dtype=np.int64), np.cumsum(sections), rule)
        assert got.tolist() == brute_attribute(parts, sections, rule)


def test_token_counts(spark):
    import tiktoken

    rng = random.Random(3)
    texts = [None, "", "\n", "one line", "<|endoftext|> x", "a\n\nb\n", "ééé ñ\n漢字 テキスト", "word " * 30000] + [
        "".join(rng.choice(["ab ", "\n", "  ", "Ünï", "12", "!?", "'s"]) for _ in range(60)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(1, ""), (None, "q")]
    ranks = tokens.load_ranks(spark)
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokens.count_tokens(frame(spark, rows), ("lang", "text"), rule="most").collect()
    assert len(got) == len(rows)
    by_id = {(g.doc_id, g.n_tokens): g for g in got}
    for i, t in rows:
        whole = "en\n\n" + (t or "")
        lens = [len(enc.decode_single_token_bytes(x)) for x in enc.encode_ordinary(whole)]
        g = by_id[i, len(lens)]
        lines = (t or "").split("\n")
        sizes = [4] + [len(x.encode()) + 1 for x in lines]
        sizes[-1] -= 1
        assert [s.n_bytes for s in g.sections] == sizes
        assert [(s.field, s.line) for s in g.sections] == [(0, 0)] + [(1, k) for k in range(len(lines))]
        assert [s.n_tokens for s in g.sections] == brute_attribute(lens, sizes, "most")
    assert tokens.count_tokens(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(frame(spark, []), rule="half")


def test_licenses(spark):
    rng = random.Random(2)
    noise = [f"w{i}" for i in range(300)]

    def around(x):
        return " ".join(rng.choices(noise, k=rng.randint(0, 60))) + "\n" + x + "\n" + " ".join(rng.choices(noise, k=rng.randint(0, 60)))

    rows, want = [], {}
    for n, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((n, around(text)))
        want[n] = name
        words = text.split()
        if len(words) > 20:  # edits: one word lost, one added, one changed
            words[10:11], words[15:15] = [], ["inserted"]
            words[18] = "changed"
        rows.append((100 + n, around(" ".join(words).upper())))
        want[100 + n] = name
    rows += [(200, None), (201, ""), (202, " ".join(noise)), (203, "Licensed under the"), (0, rows[0][1]),
             (204, "É " * 5 + licenses.TEMPLATES["MIT"] + " x " * 30000 + licenses.TEMPLATES["MIT"])]
    got = licenses.scan(frame(spark, rows)).collect()
    found = {}
    for g in got:
        found.setdefault(g.doc_id, []).append(g)
    for i, name in want.items():
        hit = [g for g in found[i] if g.license == name]
        assert len(hit) == (2 if i == 0 else 1) and hit[0].coverage >= (1.0 if i < 100 else 0.9)
        assert i >= 100 or hit[0].matched == len(licenses.Index({name: licenses.TEMPLATES[name]}).words[0])
    assert set(found) == {*want, 204}
    texts = dict(rows)
    assert [texts[204][g.start_char : g.end_char] for g in sorted(found[204], key=lambda g: g.start_char)] == [
        "Released under the MIT License"] * 2
    assert licenses.scan(frame(spark, [])).count() == 0


def test_notices_on_adjacent_lines(spark):
    short = ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0"]
    rows = [(i, "\n".join([licenses.TEMPLATES[n]] * 40)) for i, n in enumerate(short)]
    rows.append((9, "\n".join([licenses.TEMPLATES["MIT"], "and " * 3] * 7)))
    found = {}
    for g in licenses.scan(frame(spark, rows)).collect():
        found.setdefault((g.doc_id, g.license), []).append((g.start_word, g.end_word, g.coverage))
    for i, name in enumerate(short):
        n = len(licenses.Index({name: licenses.TEMPLATES[name]}).words[0])
        assert sorted(found[i, name]) == [(n * j, n * j + n, 1.0) for j in range(40)]
    assert sorted(found[9, "MIT"]) == [(8 * j, 8 * j + 5, 1.0) for j in range(7)]


def test_winnowing_guarantee():
    """Any shared run of gram + window - 1 words meets in the index."""
    rng = random.Random(1)
    for _ in range(100):
        words = [str(rng.randint(0, 400)) for _ in range(rng.randint(5, 40))]
        index = licenses.Index({"t": " ".join(words)})
        a = rng.randint(0, len(words) - 5)
        text = " ".join([str(rng.randint(500, 900)) for _ in range(20)] + words[a : a + 5] + ["x", "y", "z"])
        _, _, _, g = licenses._fingerprints([text.encode()], 3, 3)
        assert len(index.hits(g)[0])


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    rng = random.Random(4)
    lexicon = {"".join(rng.choices("abc", k=rng.randint(3, 11))): 1.0 + rng.random() for _ in range(40)}
    stems = {"".join(rng.choices("abc", k=5)): 2.0 for _ in range(4)}
    m = toxicity.Matcher(lexicon, stems)
    hits = 0
    for _ in range(3000):
        token = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        if rng.random() < 0.5:
            word = list(rng.choice(list(lexicon)))
            for _ in range(rng.randint(0, 2)):
                word[rng.randrange(len(word))] = rng.choice(["", "a", "d", "bc"])
            token = "".join(word)
        near = {w: brute_distance(token, w) for w in lexicon}
        near = {w: d for w, d in near.items() if d <= toxicity.tolerance(w)}
        got = m.find(token)
        stem = any(token.startswith(s) for s in stems)
        if token in lexicon or (near and not stem):
            best = max(near, key=lambda w: lexicon[w] / (1 + near[w]))
            assert got is not None and got[1] == pytest.approx(lexicon[best] / (1 + near[best]))
            hits += 1
        else:
            assert (got is not None) == stem
    assert hits > 500


def test_memo_is_bounded_in_entries_and_characters():
    m = toxicity.Matcher({"scumbag": 2.0}, {"hatef": 1.5})
    m.LIMIT = 10
    for i in range(100):
        long = f"hateful{i}" + "x" * 100_000
        assert m[long][0] == 2 and long not in m
        assert m[f"scumbag{i}"] == m.find(f"scumbag{i}") and f"scumbag{i}" in m
        assert len(m) <= m.LIMIT
    assert m["." * 100 + "scumbag"] == (0, 2.0, "scumbag") and all(len(t) <= m.LONGEST for t in m)


def test_context():
    words = "he said that the idiot was there".split()
    assert toxicity.context(words, 4) < 1
    assert toxicity.context(["you", "idiot"], 1) > 1
    assert toxicity.context(['"idiot"', "x"], 0) < 1
    assert toxicity.context(["plain", "idiot", "x"], 1) == 1


def test_toxicity(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("aeioustrn", k=rng.randint(2, 9))) for _ in range(400)]
    bad = ["worthless", "scumbag", "pathetic"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices(vocab, k=rng.randint(20, 80))
        if toxic:
            words[3:3] = rng.choices(bad, k=4)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    clean = " ".join(vocab[:30])
    docs += [(500, None), (501, ""), (502, clean), (503, clean + " pathetik worthles scumbagg patetic"), (5, "x"), (None, "worthless " * 4)]
    docs += [(504, clean + " scumbag pathetic worthless pathetic " + "q " * 3000)]
    labels += [(3, 1, None), (None, 1, 1), (7, 0, 9)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, docs), lab).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400 and r.doc_id != 5]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert [by[i].predicted for i in (500, 501, 502, 503, None)] == [0, 0, 0, 1, 1]
    none = toxicity.score(frame(spark, docs[:5]), lab.filter("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.score(frame(spark, []), lab).count() == 0


def test_training_rows_hold_one_row_per_id(spark):
    docs = [(1, f"copy {i}") for i in range(50)] + [(i, f"text {i}") for i in range(2, 30)] + [(2, None)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.training_rows(frame(spark, docs), lab, 20).collect()
    again = toxicity.training_rows(frame(spark, docs[::-1]), lab, 20).collect()
    assert 1 in {r.doc_id for r in got} and len(got) == len({r.doc_id for r in got}) <= 20
    assert sorted(got) == sorted(again) and all((r.doc_id, r.text or None) in docs for r in got)


def test_long_runs_of_blanks_are_cut_as_the_pattern_cuts_them(spark):
    import base64

    import numpy as np

    with open(tokens.VOCABULARY, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in fh if x.strip())}
    enc, _ = tokens.encoder("blanks", ranks)
    runs = [" " * 7, "\n" * 9, " \t\u2003\u00a0 ", "\r\n" * 5, "  \n"]
    for run in runs:
        for text in (f"ab{run}cd", f"{run}x", f"x{run}", run, f"a{run}!{run}1", f"{run}\u2003\u00e9"):
            assert np.array_equal(tokens.encode(enc, text, 5), enc.encode(text, disallowed_special=())), (text,)
    docs = spark.createDataFrame([(1, "a" + " " * 3_000_000 + "b"), (2, "\n" * 1_200_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in tokens.count_tokens(docs, by_line=False).collect()}
    assert found[1]["n_tokens"] == 1 + len(enc._encode_single_piece(b" " * 2_999_999)) + 1
    assert found[2]["sections"][0]["n_bytes"] == 1_200_000
