"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from corpus_rows import awkward, empty, prose
from staywise.llm import collocations


def plain_phrases(rows: list[tuple], least: int, longest: int = 5) -> dict:
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if 1 < len(p) and a >= least}
        gone = set()
        for p, a in held.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if a >= counts[p[i : i + m]]:
                        gone.add(p[i : i + m])
        rows = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], n[lang]))
        out[lang] = [(w.decode(), -a, l, r, t, -s) for s, a, w, l, r, t in sorted(rows)]
    return out


def texts() -> list[tuple]:
    rng = random.Random(2)
    vocabulary = [prose(k, 1).strip(".") for k in range(30)] + ["é", "日本", "a\x0bb", "x-y", " ", "(", "Ab"]
    fixed = [[rng.choice(vocabulary) for _ in range(n)] for n in (2, 3, 4, 5, 7, 12, 40)]
    rows = []
    for _ in range(400):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(fixed) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
            words.append(rng.choice([".", ",", "!\n", "", "\t", ";"]))
        rows.append((rng.choice(("en", "fr", None, "")), " ".join(words)))
    return rows


@pytest.mark.parametrize("n_bits", [1 << 20, 64])  # a roomy bitmap, and one that is full
def test_phrases_equal_counting(spark, n_bits):
    extra = [(100 + k, text, lang, "a", 1) for k, (lang, text) in enumerate(texts())]
    docs = awkward(spark, *extra)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    expected = plain_phrases(rows, 12)
    mined = collocations.mine(docs, least=12, n_bits=n_bits)
    got = defaultdict(list)
    for r in sorted(collocations.top(mined, first=40).collect(), key=lambda r: r.rank):
        assert r.rank == len(got[r.lang]) + 1
        got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert sum(map(len, expected.values())) > 60
    for lang in expected:
        assert got[lang] == expected[lang][:40]


def test_unary_paths_are_compacted(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [("en", " ".join(words))] * 9 + [("en", "w3 w4 w5 w6 w7 end")] * 2
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    levels = collocations.flows(collocations.weighted_grams(docs, least=2, n_bits=1 << 16))
    paths = {r.phrase: (r.path_words, r.path_at) for r in collocations.compact(levels[0], levels[1]).collect()}
    # The shorter text enters at w3 and leaves after w7; nodes in between carry both, so the long path is cut there.
    assert paths["w0 w1 w2 w3 w4"] == (7, 0) or paths["w0 w1 w2 w3 w4"][1] == 0
    tail = [paths[" ".join(words[k : k + 5])] for k in range(10, 26)]
    assert len({t[0] for t in tail}) == 1 and [t[1] - tail[0][1] for t in tail] == list(range(16))
    counted = {r.phrase: r.f for level in levels for r in level.collect()}
    assert counted["w3"] == 11 and counted["w7 w8"] == 9 and counted["w5 w6 w7"] == 11 and counted["end"] == 2


def test_scores_beyond_64_bits(spark):
    df = spark.sql("SELECT 9000000000000000L AS a, 90000000000000000L AS n, 9000000000000001L AS l, 9100000000000000L AS r")
    from pyspark.sql import functions as F

    score = df.select(collocations._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert score == 1000 * 9000000000000000 * 90000000000000000 // (9000000000000001 * 9100000000000000)


def test_empty_corpus(spark):
    assert collocations.top(collocations.mine(empty(spark))).count() == 0
