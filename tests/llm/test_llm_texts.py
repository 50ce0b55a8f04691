"""Quality rules, decontamination, n-gram join and suffix dedup against plain loops."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_rows import awkward, cut_bytes, empty, grams, linked_groups, prose
from staywise.llm import components, decontaminate, ngram_join, quality_rules, suffix_dedup
from staywise.llm.common import light_batches
from staywise.session import written


def test_quality_measures_of_awkward_rows(spark):
    got = quality_rules.judge(awkward(spark))
    assert "node" in got.columns and "kept" in got.columns
    rows = got.collect()
    assert len(rows) == 13
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_rules_are_one_projection_without_functions(spark):
    plan = quality_rules.judge(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_each_rule_names_itself(spark):
    text = "the of and " * 30
    rows = [(1, prose(5, 40) + " the of and to in " * 3), (2, " ".join(f"{w}***" for w in prose(6, 60).split())), (3, "\n".join([prose(7, 5)] * 30)), (4, text)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].broken_rules == []
    assert "symbols" in got[2].broken_rules and "stop_words" in got[2].broken_rules
    assert "lines" in got[3].broken_rules and got[3].n_dup_lines == 29
    assert got[4].base_failed and not got[4].kept


def test_contamination_spans_and_blocks(spark):
    passage = prose(11, 20)
    words = passage.split()
    items = [(1, passage), (2, "Short Item!"), (3, None), (None, "  "), (2, passage), (4, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    text = f"Befôre,\n({' '.join(words[:15]).upper()}) after. é SHORT   item end"
    docs = awkward(spark, (20, text, "en", "a", 1), (21, "short items", "en", "a", 1))
    for bound in (32 << 20, 40):  # one block, and several
        got = decontaminate.find_contamination(docs, benchmark, max_block_bytes=bound)
        rows = {r.doc_id: r for r in got.filter("doc_id >= 20").collect()}
        c = rows[20].contamination
        assert (c["n_words"], c["n_hit"], c["items"]) == (21, 17, ["1", "2"])
        assert [text[s["start"] : s["end"]].lower().split()[0] for s in c["spans"]] == [words[0].strip("."), "short"]
        assert rows[21].contamination["n_hit"] == 0
        assert rows[20].node == "own node" and got.count() == 15
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).filter("contamination.n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty(spark), benchmark).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_all_pairs(spark, width, percent):
    rng = random.Random(width)
    texts = []
    for family in range(12):
        words = prose(100 + family, rng.choice((2, 12, 40, 160, 400))).split()
        for _ in range(rng.choice((1, 4, 12))):
            copy = list(words)
            for _ in range(int(len(copy) * rng.choice((0, 0.01, 0.02, 0.04, 0.08)))):
                copy[rng.randrange(len(copy))] = rng.choice("x y z".split())
            texts.append(" ".join(copy))
    docs = awkward(spark, *[(100 + k, t, "en", "a", 1) for k, t in enumerate(texts)])
    got = ngram_join.join_components(docs, width=width, percent=percent).collect()
    assert len(got) == docs.count()
    sets = {r.doc_id: grams(r.text, width) for r in docs.collect() if r.doc_id is not None}
    least = linked_groups(sets, percent)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), least[r.doc_id] if sets[r.doc_id] else r.doc_id)
    stay = ngram_join.keep_one(docs, width=width, percent=percent)
    kept = sorted(r.doc_id for r in stay.collect() if r.doc_id is not None)
    assert kept == sorted({least[k] for k in sets}) and stay.columns == docs.columns
    assert ngram_join.join_components(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(3)
    plan = ngram_join._Plan(percent)
    most = 2 if percent == 80 else 1
    tried = 0
    for size in (4, 5, 6, 9, 10, 11, 12, 30, 75, 200, 1000):
        for _ in range(60):
            one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            gone = rng.integers(0, max(1, most * size // 18) + 1)
            two = np.unique(np.concatenate([one[gone:], rng.integers(0, 2**63, rng.integers(0, max(1, most * size // 18) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(one, two))
            if both < max(len(one), len(two)) and 100 * both >= percent * (len(one) + len(two) - both):
                tried += 1
                assert set(ngram_join.signatures(one, plan).tolist()) & set(ngram_join.signatures(two, plan).tolist())
    assert tried > 200


def test_unrelated_sets_share_next_to_no_signature():
    rng = np.random.default_rng(4)
    plan = ngram_join._Plan(80)
    for size in (1000, 4000):
        owners: dict[int, int] = {}
        shared = 0
        for _ in range(300):
            for sig in set(ngram_join.signatures(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)), plan).tolist()):
                shared += sig in owners
                owners[sig] = 1
        assert shared <= 3


def test_link_that_no_tree_edge_shows_is_found(spark):
    """Chains of texts, each linked with the next only: trees alone join too few of them."""
    words = prose(31, 200).split()
    texts = []
    for step in range(40):
        copy = list(words)
        copy[: 3 * step] = [f"s{k}" for k in range(3 * step)]
        texts.append(" ".join(copy))
    rng = random.Random(1)
    order = list(range(40))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[k], t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = {order[k]: grams(t, 3) for k, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(docs).collect()}
    assert got == linked_groups(sets, 90)


def test_texts_of_one_id_are_judged_apart(spark):
    """Rows of an id stay unless their own text repeats; equal rows stay once."""
    a, b, c = (prose(k, 80) for k in (61, 62, 63))
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, c), (1, c + " tail"), (4, None), (4, ""), (None, b), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("own"))
    stay = ngram_join.keep_one(docs, width=5, percent=80)
    assert stay.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text or "") for r in stay.collect())
    # c's text is told from its copy by the least id, 1; the text without an id is called by its hash.
    least = min((1, b), (hash_of(spark, b), b))
    assert got == sorted([(1, a), (1 if least[0] == 1 else 0, b), (1, c + " tail"), (4, ""), (4, ""), (0, "")])
    joined = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join_components(docs, width=5, percent=80).collect() if r.doc_id}
    assert joined[2, 77] == 1 and joined[3, 76] == 1


def hash_of(spark, text: str) -> int:
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


def test_small_tables_are_few_files(spark, monkeypatch):
    """Every file that is written starts processes, so a table of links is not a file per part of a shuffle."""
    tables = []

    def kept(df, label):
        tables.append(written(df, label))
        return tables[-1]

    monkeypatch.setattr(components, "written", kept)
    with_parts = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in with_parts}
    try:
        for name, value in with_parts.items():
            spark.conf.set(name, value)
        edges = spark.createDataFrame([(k, k + 1) for k in range(0, 2000, 2)], "u long, v long")
        assert components.components(edges).count() == 1000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert max(len(t.inputFiles()) for t in tables) <= 2 * spark.sparkContext.defaultParallelism


def test_joined_texts_reach_workers_in_light_batches(spark, monkeypatch):
    """A batch of 10,000 whole texts would stand in the worker and in the executor at once."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    name, held = "spark.sql.execution.arrow.maxBytesPerBatch", {}

    def kept(df, label):
        held.setdefault(label, spark.conf.get(name, None))
        return written(df, label)

    monkeypatch.setattr(ngram_join, "written", kept)
    docs = awkward(spark, *[(100 + k, prose(k, 60), "en", "a", 1) for k in range(20)])
    assert ngram_join.join_components(docs).count() == docs.count()
    assert held["gram-sets"] == held["gram-trees"] == str(4 << 20) and held["gram-nodes"] is None
    with light_batches(spark, 1 << 16):
        wide = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
        seen = wide.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in seen) == 2000 and max(r.bytes for r in seen) <= 2 << 16
    assert spark.conf.get(name, None) is None


def test_a_task_leaves_nothing_in_its_worker():
    """Workers are reused: words and automata that stay would stand beside what the next step needs."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "doc": [1, 2], "print": [1, 2], "text": [prose(1, 40), None]})
    decontaminate._BUILT[-1] = (None, [])
    assert [b.num_rows for b in ngram_join._fingerprints(iter([batch]), 3)] == [2]
    assert not ngram_join._HASHES and not decontaminate._BUILT
    assert list(ngram_join._signed(iter([batch]), 3, 90)) and not ngram_join._HASHES


def test_signatures_are_sent_in_pieces(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": [prose(k, 40) for k in range(10)]})
    whole = pa.Table.from_batches(ngram_join._signed(iter([batch]), 3, 80))
    monkeypatch.setattr(ngram_join, "_SENT", 7)
    pieces = list(ngram_join._signed(iter([batch]), 3, 80))
    assert max(p.num_rows for p in pieces) == 7 and pa.Table.from_batches(pieces).equals(whole)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 10 for k in range(11, 41)) and all(got[k] == 100 for k in range(101, 130)) and got[201] == 200 and 7 not in got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_suffix_dedup_equals_counting(spark):
    rng = random.Random(5)
    shared = [prose(50 + k, n) for k, n in enumerate((45, 60, 34, 33))]
    texts = []
    for k in range(60):
        parts = [prose(200 + k, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            at = rng.randrange(40)
            parts += [piece[at : at + rng.randint(150, len(piece))], prose(rng.randrange(10**6), rng.randint(0, 9))]
        texts.append(" ".join(parts))
    texts += ["a" * 450, "ab" * 150, "a" * 199, "abc" * 67 + "x" + "abc" * 67, shared[0] + "é" + shared[0]]
    docs = awkward(spark, *[(100 + k, t, "en", "a", 1) for k, t in enumerate(texts)])
    rows = docs.collect()
    expected = {}
    for r, (kept, runs) in zip(rows, cut_bytes([(r.text or "").encode() for r in rows], 200)):
        expected.setdefault(r.doc_id, []).append((len((r.text or "").encode()), runs, hashlib.sha256(kept).hexdigest()))
    for hot in (20_000, 3):  # the sort alone, and counted strings for crowded grams
        got: dict = {}
        for r in suffix_dedup.cut_repeats(docs, hot=hot, keep=True).collect():
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
            got.setdefault(r.doc_id, []).append((r.n_bytes, len(r.spans), r.kept_sha256))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert suffix_dedup.cut_repeats(empty(spark)).count() == 0


def test_suffix_order_and_common_extensions():
    rng = random.Random(8)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(9) for _ in rows]))
    size = np.array([len(r) for r in rows])
    table = np.zeros((len(rows), 30), np.uint8)
    for k, r in enumerate(rows):
        table[k, : len(r)] = np.frombuffer(r, np.uint8)
    s = suffix_dedup._Sorted(table, size, group)
    for g in range(9):
        own = [k for k in s.order if group[k] == g]
        assert [rows[k] for k in own] == sorted(rows[k] for k in own)
    for at in range(1, len(rows)):
        a, b = rows[s.order[at - 1]], rows[s.order[at]]
        if group[s.order[at - 1]] == group[s.order[at]]:
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert s.common[at] == n
