"""Pages, conversations, mixing, token files, shards and licences against plain loops."""

from __future__ import annotations

import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_rows import awkward, empty, prose
from staywise.llm import block_labeller, chat_log, license_scan, mixing, ring_shards, token_files
from staywise.llm.html_blocks import blocks
from staywise.llm.queries import vocabulary
from staywise.session import new_folder, written

SMALL = "/root/testdata/sf0.001"


def test_blocks_of_broken_markup():
    page = "<html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- x <p>no</p> --><div class='ad top'>Ad<br>two</div><article><p><b>One &amp; two<br><p>Th<i>re</i>e&nbsp; &#233;</p><a href=\"x>y\">four</a> five &am"
    found = blocks(page)
    assert [b.text for b in found] == ["Ad two", "One & two", "Three é", "four five &am"]
    assert found[0].path == ("<html", "<body", "<div", "c=ad", "c=top")
    assert found[2].path[-1] == "<p" and found[3].linked == 4
    assert blocks("") == [] and blocks("<p") == [] and [b.text for b in blocks("plain <text")] == ["plain"]


@pytest.fixture(scope="module")
def net(spark):
    return block_labeller.train(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_labeller_on_held_out_layouts(spark, net):
    pages, labels = block_labeller.training_pages([prose(k, 40) for k in range(50)], 150, seed=4321)
    right = total = 0
    for p, y in zip(block_labeller.chances(net, pages), labels):
        right += int(((p > 0.5) == np.array(y)).sum())
        total += len(y)
    assert right / total > 0.96


def test_extraction_of_the_supplied_pages(spark, net):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in block_labeller.extract(pages, ["page_id"], net=net).collect()}
    for r in pages.collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        expected = " ".join(b.text for b in blocks(f"<article>{inner}</article>"))
        assert got[r.page_id] == expected


def test_extraction_of_awkward_pages(spark, net):
    long = "<article>" + "".join(f"<p>{prose(k, 12)}</p>" for k in range(3000)) + "</article>"
    rows = [(1, None, "a"), (2, "", "b"), (3, "<nav><ul><li><a href=x>Home</a></li></ul></nav>", None), (4, long, "c"), (4, long, "c"), (None, "<article><p>Text of a page", "d")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = block_labeller.extract(df.drop("text"), ["page_id"], net=net).collect()
    texts = sorted((r.page_id or 0, r.text) for r in got)
    assert texts[0] == (0, "Text of a page") and texts[1:4] == [(1, ""), (2, ""), (3, "")]
    assert texts[4] == texts[5] and len(texts[4][1].split()) == 36_000
    assert block_labeller.extract(df.limit(0), ["page_id"]).count() == 0


EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"


def test_fold_follows_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "delta", "user", "Hel"),
        (1, 0, 2, None, "user", "lo"),
        (1, 1, 3, "delta", "assistant", "bad"),
        (1, 2, 4, "delta", "user", "gone with the fork"),
        (1, 1, 5, "regenerate", "assistant", ""),
        (1, 1, 6, "delta", "assistant", "go"),
        (1, 1, 7, "delta", "assistant", "od"),
        (1, 2, 8, "delta", "user", "more"),
        (2, 0, 1, "delta", "user", "old"),
        (2, 1, 2, "delta", "assistant", "reply to old"),
        (2, 0, 3, "edit", "user", "new"),
        (2, 1, 4, "delta", "assistant", None),
        (None, 0, 1, "delta", None, "x"),
    ]
    random.Random(2).shuffle(log)
    turns = chat_log.fold(spark.createDataFrame(log, EVENT).withColumn("said", F.lit("own")))
    got = sorted(((r.conv_id or 0), r.turn, r.role, r.text) for r in turns.collect())
    assert got == [(0, 0, "", "x"), (1, 0, "user", "Hello"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (2, 0, "user", "new"), (2, 1, "assistant", "")]


def test_rendering_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<s>", "[\\INST]", "", None, "a\nb", "[ROLE] x [/ROLE]y", "é🙂</s", "<", "[INST", "\\n </s></s>", prose(1, 5000)]
    roles = ["user", "assistant", "system", "", "tool [/ROLE]", None]
    log = [(c, t, t, "delta", roles[(c + t) % 6], texts[(3 * c + t) % len(texts)]) for c in range(14) for t in range(9)]
    turns = chat_log.fold(spark.createDataFrame(log, EVENT))
    shown = chat_log.render(turns)
    read = shown.select("conv_id", "n_turns", "formatted", "mask", chat_log.read_turns(F.col("formatted")).alias("turns"), chat_log.read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    for r in read.collect():
        said = [(role or "", text or "") for c, _, _, _, role, text in log if c == r.conv_id]
        assert [(t["role"], t["text"]) for t in r.turns] == said and r.n_turns == 9
        assert r.loss == "".join(t for role, t in said if role == "assistant")
        for s in r["mask"]:
            body = r.formatted[s["start"] : s["start"] + s["chars"]]
            assert r.formatted[s["start"] - 3 : s["start"]] == "<s>" and r.formatted[s["start"] + s["chars"] :].startswith("</s>") and "</s>" not in body
    assert chat_log.render(chat_log.fold(spark.createDataFrame([], EVENT))).count() == 0


def test_targets_are_reshared():
    assert mixing.share_out([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, 250 / 3, 500 / 3]
    assert mixing.share_out([0, 10], [3, 1], 15, 2) == [0.0, 15.0]
    assert mixing.share_out([], [], 0, 2) == []


def test_meeting_keeps_mass_and_expectation():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.randint(1, 50), rng.random()), (rng.randint(1, 50), rng.random())
        u, v = min(a[0] * (1 - a[1]), b[0] * b[1]), min(a[0] * a[1], b[0] * (1 - b[1]))
        one, two = mixing.meet(a, b, 0.0), mixing.meet(a, b, 0.999999999)
        for p, q in (one, two):
            assert abs(a[0] * p + b[0] * q - a[0] * a[1] - b[0] * b[1]) < 1e-9
            assert p in (0.0, 1.0) or q in (0.0, 1.0)
        assert abs((one[0] * v + two[0] * u) / (u + v) - a[1]) < 1e-9


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    more = [(100 + k, prose(k, rng.randint(1, 80)), "en", "hot" if k % 3 else rng.choice("abc"), 1) for k in range(500)]
    docs = awkward(spark, *more)
    how = dict(buckets=32, fan_in=8)
    chosen = mixing.copies(mixing.with_size(docs), **how).collect()
    again = mixing.copies(mixing.with_size(docs.repartition(7)), **how).collect()
    key = lambda r: (r.doc_id or 0, r.source or "", r.print or 0)
    assert sorted(map(tuple, chosen), key=str) == sorted(map(tuple, again), key=str)
    assert sum(r.rows for r in chosen) == docs.count() and len({key(r) for r in chosen}) == len(chosen)
    taken: Counter = Counter()
    largest: Counter = Counter()
    targets = {}
    for r in chosen:
        taken[r.source] += r.copies * r["size"] * r.rows
        largest[r.source] = max(largest[r.source], r["size"] * r.rows)
        targets[r.source] = r.target
        assert 0 <= r.copies <= 2
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source]
    total = sum(r["size"] * r.rows for r in chosen)
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    rows = mixing.mixed(docs, **how)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies * r.rows for r in chosen)
    assert mixing.copies(mixing.with_size(empty(spark))).count() == 0


def test_levels_of_few_rows_are_few_files(spark, monkeypatch):
    """Every file that is written starts processes, so a level is not dealt into a file per part."""
    tables = {}

    def kept(df, label):
        held = tables.setdefault(label, [])
        held.append(written(df, label))
        return held[-1]

    monkeypatch.setattr(mixing, "written", kept)
    docs = awkward(spark, *[(100 + k, prose(k, 5 + k % 70), "en", "abc"[k % 3], 1) for k in range(300)])
    assert mixing.copies(mixing.with_size(docs)).count() > 300
    assert [len(t.inputFiles()) for t in tables["mix-level"]] == [1, 1, 1]


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 1023, 1024, 1025, 4000):
        for top in (1, 2, 70, 50_000, 1 << 40):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            assert (token_files.unpack(*_starts(token_files.pack(ids)), n) == ids).all()
        mixed = np.where(rng.random(n) < 0.1, rng.integers(1 << 60, 1 << 63, n, dtype=np.uint64), rng.integers(0, 9, n, dtype=np.uint64))
        assert (token_files.unpack(*_starts(token_files.pack(mixed)), n) == mixed).all()


def _starts(packed):
    return packed[0].astype(np.int64), *packed[1:]


def test_words_encode_as_whole_texts():
    path = vocabulary("word_bpe_49k.json")
    odd = "naïve ÀÉ. straße, STRASSE ẞ İstanbul x.y don't it's 3rd a1b ª º µ ß. ÿ, é é ñ, 日本 🙂. '' s 's . , ,. a., Ab, ﬁn ΟΔΟΣ <|endoftext|>x \x1c \x85 　z"
    texts = [odd.encode(), b"", b" \t\n", prose(3, 400).encode()]
    assert list(token_files.encode_texts(texts, path, True)) == list(token_files.encode_texts(texts, path, False))


def test_words_kept_by_a_worker_are_bounded(monkeypatch):
    """Whoever writes frames never asks for more than the last text of a batch."""
    limits = {"_CACHED_WORDS": 40, "_CACHED_STEMS": 60, "_CACHED_MARKS": 20}
    for name, value in (limits | {"_TOKENIZERS": {}}).items():
        monkeypatch.setattr(token_files, name, value, raising=False)
    path, rng = vocabulary("word_bpe_49k.json"), random.Random(8)
    word = lambda: "".join(rng.choices("abcéß", k=4)) + "".join(rng.choices(".,*", k=rng.randint(0, 3)))
    texts = [" ".join(word() for _ in range(10)) for _ in range(400)] + ["long" * 50 + "! 12 (a)"]
    rows = [pa.RecordBatch.from_pydict({"range": [0] * 50, "doc_id": list(range(50)), "text": texts[k : k + 50]}) for k in range(0, 400, 50)]
    rows.append(pa.RecordBatch.from_pydict({"range": [0], "doc_id": [400], "text": texts[400:]}))
    written = list(token_files._write_frames(iter(rows), path, True, 1, 1 << 18))
    known = token_files._TOKENIZERS[path][1]
    for kept, name in ((known, "_CACHED_WORDS"), (known.stems, "_CACHED_STEMS"), (known.marks, "_CACHED_MARKS")):
        assert len(kept) <= limits[name] + 10  # and the words of a text
    assert max(map(len, known)) <= 64
    ids = np.concatenate([f[4] for b in written for f in token_files.frames(b.column(0)[0].as_py() + b"\n")])
    expected = b"".join(x + b"\1\0\0\0" for x in token_files.encode_texts([t.encode() for t in texts], path, False))
    assert ids.astype("<u4").tobytes() == expected


def test_token_files_hold_every_text(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    docs = awkward(spark, *[(100 + k, prose(k, 50), "en", "a", 1) for k in range(80)])
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(docs, folder, path, range_bytes=20_000, frame_ids=500, frames_per_file=3)
    got = token_files.token_index(spark, folder).collect()
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    expected, start = [], 0
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    void = new_folder(spark, "tokens")
    token_files.write_token_files(empty(spark), void, path)
    assert token_files.token_index(spark, void).count() == 0


def _ring_by_hand(keys, shards: int, virtual: int):
    """Keys in cell and ring order, one by one: the next node clockwise whose shard has room."""
    nodes = ring_shards.ring(shards, virtual)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    where, late = {}, []
    for key, arc in keys:
        shard = nodes[arc][1]
        if room[shard]:
            room[shard] -= 1
            where[key] = shard
        else:
            late.append((key, arc))
    return where, late, room, nodes


def test_ring_shards_are_full_and_gapless(spark):
    docs = awkward(spark, *[(100 + k, prose(k, 1 + k % 7), "en", "a", 1) for k in range(400)])
    got = ring_shards.assign(docs, shards=7, virtual=8, parts=2).collect()
    assert len(got) == docs.count()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    for r, d in zip(sorted(got, key=lambda r: r.doc_id or -1)[-400:], range(100, 500)):
        assert r.doc_id == d
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id in (4, 9)} == {
        (d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs.collect() if d.doc_id in (4, 9)
    }
    again = ring_shards.assign(docs.repartition(5), shards=7, virtual=8, parts=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert ring_shards.assign(empty(spark), shards=7).count() == 0


def test_walk_against_one_key_at_a_time():
    rng = random.Random(9)
    owners = [shard for _, shard in ring_shards.ring(5, 6)]
    counts = {cell: rng.choice((0, 1, 2, 40)) for cell in range(len(owners))}
    counts = {c: n for c, n in counts.items() if n}
    keys = [(f"{c}/{k}", c) for c in sorted(counts) for k in range(counts[c])]
    where, late, room, nodes = _ring_by_hand(keys, 5, 6)
    total = len(keys)
    capacity = [total // 5 + (s < total % 5) for s in range(5)]
    waiting: list = []
    for lap in range(2):  # clockwise, first come first served
        for arc, (_, shard) in enumerate(nodes):
            if lap == 0:
                waiting += [k for k, a in late if a == arc]
            while waiting and room[shard]:
                where[waiting.pop(0)] = shard
                room[shard] -= 1
    got = {}
    for cell, first, n, shard, _ in ring_shards.walk(counts, owners, capacity, parts=1):
        got |= {f"{cell}/{first + k}": shard for k in range(n)}
    assert got == where and not waiting


def test_slack_bounds_what_a_new_shard_moves(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    place = lambda n, slack: {r.doc_id: r.shard for r in ring_shards.assign(docs, shards=n, slack=slack).collect()}
    before, after = place(8, 0.25), place(9, 0.25)
    assert max(Counter(after.values()).values()) <= 1.25 * 4000 / 9 + 1
    assert sum(before[k] != after[k] for k in before) < 0.35 * 4000


def test_licences_by_header_file_and_ancestor(spark):
    mit, gpl, apache = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit + "\nmore words"),
        (2, "a/b/c/x.py", "no statement here"),
        (3, "a/b/LICENSE.txt", gpl),
        (4, "a/y.py", apache + "\ncode"),
        (5, "z/y.py", "text about a driving licence and nothing else at all, really nothing"),
        (6, "ab/x", "x"),
        (7, "a/q/x.py", None),
        (7, "a/q/x.py", None),
        (8, None, gpl),
        (9, "a/b/COPYING", gpl + "\n" + mit),
        (None, "a/b/d", ""),
        (10, "", "plain"),
        (11, "x/" * 40 + "deep", "plain " * 20_000),
    ]
    files = spark.createDataFrame(rows, "file long, path string, text string").selectExpr("*", "'own' as licence", "'own' as line", "1 as score")
    got = sorted((r.file or 0, r.path, r.licence, r.how, r.from_path) for r in license_scan.scan(files, key="file").collect())
    assert got == [
        (0, "a/b/d", "GPL-3.0", "inherited", "a/b/COPYING"),
        (1, "a/LICENSE", "MIT", "file", "a/LICENSE"),
        (2, "a/b/c/x.py", "GPL-3.0", "inherited", "a/b/COPYING"),
        (3, "a/b/LICENSE.txt", "GPL-3.0", "file", "a/b/LICENSE.txt"),
        (4, "a/y.py", "Apache-2.0", "header", "a/y.py"),
        (5, "z/y.py", None, None, None),
        (6, "ab/x", None, None, None),
        (7, "a/q/x.py", "MIT", "inherited", "a/LICENSE"),
        (7, "a/q/x.py", "MIT", "inherited", "a/LICENSE"),
        (8, "", "GPL-3.0", "header", ""),
        (9, "a/b/COPYING", "GPL-3.0", "file", "a/b/COPYING"),
        (10, "", None, None, None),
        (11, "x/" * 40 + "deep", None, None, None),
    ]
    assert license_scan.scan(files.limit(0), key="file").count() == 0


def _wrapped(text, mark, width=60):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licences_of_wrapped_headers_and_whole_files(spark):
    notices = {}
    for name, text in license_scan.licence_notices.NOTICES:
        notices[name] = text  # the longest of each licence comes last
    full = dict(license_scan.licence_notices.full_texts())
    mit_file = "The MIT License (MIT)\n\nCopyright (c) 2031 Some One\n\n" + "\n\n".join(_wrapped(p, "") for p in notices["MIT"].replace(": The", ":\n\nThe").split("\n\n"))
    code = "import os\n" + _wrapped(notices["ISC"], "# ") + "\n" + "x = 1\n" * 50
    rows = [
        ("Apache-2.0", "a.py", "#!/usr/bin/env python\n# Copyright 2031 The Tool Authors.\n#\n" + _wrapped(notices["Apache-2.0"], "# ") + "\n\nimport os"),
        ("BSD-3-Clause", "b.c", "/*\n * Copyright (c) 2031, Some One\n *\n" + _wrapped(notices["BSD-3-Clause"].replace("copyright holder nor", "Some Institute nor"), " * ") + "\n */\nint x;"),
        ("BSD-2-Clause", "c.go", _wrapped(notices["BSD-2-Clause"], "// ") + "\n\npackage c"),
        ("MIT", "d.html", "<!DOCTYPE html>\n<!--\nA page about trees and how they grow in gardens.\n\n" + _wrapped(notices["MIT"], "  ") + "\n-->\n<p>"),
        ("ISC", "e.js", "/**\n" + _wrapped(notices["ISC"], " * ") + " */ run();"),
        ("MPL-2.0", "f.sql", _wrapped(notices["MPL-2.0"], "-- ") + "\nselect 1"),
        ("GPL-2.0", "g.lisp", ";; A tool.\n;;\n" + _wrapped(notices["GPL-2.0"], ";; ")),
        ("LGPL-3.0", "h.rs", _wrapped(notices["LGPL-3.0"], "// ") + "\nfn x() {}"),
        ("Apache-2.0", "i.ts", "// Copyright 2031 Some One\n// SPDX-License-Identifier: Apache-2.0\n// Helps with sorting of very many things.\nlet x"),
        ("GPL-2.0", "j.h", "/* SPDX-License-Identifier: GPL-2.0-only */\nint y;"),
        ("MIT", "k.sh", "# Released under\n# the MIT License.\necho"),
        (None, "l.sh", "# SPDX-License-Identifier: Zlib\necho"),
        (None, "m.py", code),
        (None, "n.py", "# A module that sorts things and grants a driving permission to people.\nx = 1"),
        ("MIT", "p/LICENSE", mit_file),
        ("MIT", "p/q.py", "x = 1"),
        ("ISC", "r/LICENCE.md", "Copyright 2031 Some One\n\n" + _wrapped(notices["ISC"], "")),
        ("Unlicense", "s/UNLICENSE", _wrapped(notices["Unlicense"], "")),
        *[(name, f"t{i}/COPYING", "Some project\n" + text.replace("\n", " \n").replace("Program", "Program ")) for i, (name, text) in enumerate(sorted(full.items()))],
        ("GPL-3.0", "u/COPYING", "\n".join(full["GPL-3.0"].splitlines()[:500])),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (_, p, t) in enumerate(rows)], "file long, path string, text string")
    got = {r.path: r.licence for r in license_scan.scan(files, key="file").collect()}
    want = {p: name for name, p, _ in rows}
    assert {p: (got[p], want[p]) for p in want if got[p] != want[p]} == {}


@pytest.mark.parametrize("name", ["op4_chat_log", "op9_ring_shards", "op10_license_scan"])
def test_native_plans_have_no_python(spark, name):
    from staywise.llm.common import QUERIES

    plan = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
