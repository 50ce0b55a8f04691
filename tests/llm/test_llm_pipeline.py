"""The pipeline's stages, each on what the one before kept, against plain loops."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from corpus_rows import awkward, empty, grams, linked_groups, prose
from staywise.llm.queries import vocabulary
from staywise.session import written

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _normal(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_against_loops(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    quality, near, clean, mix, tokens = stages.values()

    kept = written(quality(spark, docs, SMALL), "test-quality")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = {r.doc_id: r for r in kept.collect()}
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 for r in rows.values())

    one = written(near(spark, kept, SMALL), "test-near")
    least = linked_groups({k: grams(r.text, 5) for k, r in rows.items()}, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(least.values()))

    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = _normal(r.text)
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))} if words else set()
    expected = []
    for r in one.collect():
        words, hit = _normal(r.text), set()
        for w in {len(w) for w in windows}:
            for i in range(len(words) - w + 1):
                if tuple(words[i : i + w]) in windows:
                    hit |= set(range(i, i + w))
        if not (hit and 20 * len(hit) >= len(words)):
            expected.append(r.doc_id)
    fresh = written(clean(spark, one, SMALL), "test-clean")
    assert sorted(r.doc_id for r in fresh.collect()) == sorted(expected)

    mixed = written(mix(spark, fresh, SMALL), "test-mix")
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(expected) and max(times.values()) <= 2

    got = sorted(map(tuple, tokens(spark, mixed, SMALL).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    start = 0
    for (doc, at, n, _), wanted in zip(got, sorted(times.elements()), strict=True):
        assert (doc, at, n) == (wanted, start, len(tokenizer.encode(texts[doc], add_special_tokens=False).ids) + 1)
        start += n


def test_stages_take_awkward_and_empty_tables(spark):
    plain = (30, prose(9, 80) + " the of and to in is", "en", "a", 1)
    awkward_rows = awkward(spark, plain, plain).select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, awkward_rows, SMALL)
        assert got.count() > 0, name
        assert stage(spark, empty(spark), SMALL).count() == 0, name


def test_run_equals_its_stages(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) and first
