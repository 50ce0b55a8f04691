"""The prefix trie against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_rows import prose
from staywise.llm import prefix_trie

TURN = "conv_id long, turn long, role string, text string"


def plain_trie(rows: list[tuple]) -> list[tuple]:
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in said.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:]) if c % 100 else tuple(turns[c])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (own[0], len(node), members[node[:-1]][0] if node else -1, len(own), children[node], leaves[node], saved[node], sha(ends[node])) for node, own in members.items()
    )


def conversations() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(150, 190), 200, 100_001]:
        first = rng.choice(("a", "b"))
        for t in range(rng.choice((0, 1, 2, 4, 5, 8, 9))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"{first}{rng.choice('xy') if t > 2 else t}"))
    rows += [(c, t, "user", "same text é🙂") for c in range(300, 340) for t in range(7)]
    rows += [(c, t, "user", f"deep {t}") for c in (400, 401, 402) for t in range(70)]
    rows += [(401, 70, "assistant", prose(1, 4000)), (7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (None, 0, "user", "none")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "hot"), [(4, 4096), (3, 2), (1, 1)])
def test_trie_equals_loops(spark, block, hot):
    rows = conversations()
    df = spark.createDataFrame(rows, TURN).withColumns({"node": F.lit("own"), "n": F.lit(1), "depth": F.lit(9)})
    got = prefix_trie.trie(df, block=block, hot=hot).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == plain_trie(rows)


def test_turnless_and_empty(spark):
    lone = [(101, 0, "user", "x")]  # its first turn comes from a conversation that is not there
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(lone, TURN)).fillna(-1).collect())) == plain_trie(lone)
    assert prefix_trie.trie(spark.createDataFrame([], TURN)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], TURN)).count() == 0


def test_equal_blocks_meet_once(spark):
    """A thousand copies are one edge a block, and turns of a block with one successor are not grouped again."""
    df = spark.createDataFrame([(c * 100, t, "user", f"t{t}") for c in range(50) for t in range(12)], TURN)
    assert prefix_trie.rebuilt_blocks(df).filter("length(body) > 0").groupBy("parent", "body").count().count() == 3
