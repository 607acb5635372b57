"""The license scan against alignments over all offsets in plain Python."""

import random
import re
from collections import Counter

from palletwise.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def folded(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def best_local(template, text):
    """(score, words matched, start, end) of the best local alignment: a match
    counts 1, a changed, missing or added word -1."""
    best, above = (0, 0, 0, 0), [(0, 0, j) for j in range(len(text) + 1)]
    for t in template:
        row = [(0, 0, 0)]
        for j, x in enumerate(text):
            s, m, a = above[j] if above[j][0] > 0 else (0, 0, j)
            cell = (s + 1, m + 1, a) if x == t else (s - 1, m, a)
            for s, m, a in (above[j + 1], row[j]):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, a)
            row.append(cell if cell[0] > 0 else (0, 0, j + 1))
            if cell[:2] > best[:2]:
                best = (*cell, j + 1)
        above = row
    return best


def brute_scan(rows, templates, least=licenses.MIN_COVERAGE):
    out = []
    for doc_id, text in rows:
        whole = folded(text)
        for name, template in templates.items():
            own, words = folded(template), list(whole)
            # a match needs that many of the template's words in the text
            while sum((Counter(own) & Counter(words)).values()) >= least * len(own):
                score, n, a, b = best_local(own, words)
                if not score:
                    break
                if n / len(own) >= least:
                    out.append((doc_id, name, n, a, b))
                words[a:b] = [None] * (b - a)
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.license, r.matched, r.start_word, r.end_word) for r in df.collect())


def test_planted_notices(spark):
    rng = random.Random(12)
    noise = [f"w{i}" for i in range(200)]
    rows = [(-1, None), (-2, ""), (-3, " ".join(noise))]
    for i, (_, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 4):
        words = text.split()
        for _ in range(len(words) // 25 if i >= len(licenses.TEMPLATES) else 0):
            at = rng.randrange(1, len(words) - 1)
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]])
        copy = " ".join(words)
        parts = [" ".join(rng.choices(noise, k=rng.randint(0, 40))) for _ in range(3)]
        rows.append((i, "\n".join([parts[0], copy, parts[1]] + ([copy.upper(), parts[2]] if i % 3 == 0 else []))))
    got = found(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute_scan(rows, licenses.TEMPLATES)
    texts = dict(rows)

    def guaranteed(hit):
        """A run of words that winnowing never misses is in both."""
        run = licenses.GRAM + licenses.WINDOW - 1
        own, words = folded(licenses.TEMPLATES[hit[1]]), folded(texts[hit[0]])[hit[3] : hit[4]]
        return bool({tuple(own[i : i + run]) for i in range(len(own) - run + 1)}
                    & {tuple(words[i : i + run]) for i in range(len(words) - run + 1)})

    assert set(got) <= set(want) and len(got) == len(set(got)) and len(want) == len(set(want))
    missed = [hit for hit in want if hit not in got]
    assert not any(map(guaranteed, missed))
    assert sum(map(guaranteed, want)) >= len(rows) - 3


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op1_license_scan(spark, SF)) == brute_scan([tuple(r) for r in docs], licenses.TEMPLATES)
