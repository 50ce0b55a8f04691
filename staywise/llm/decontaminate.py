"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.
A window is ``width`` consecutive words of a benchmark item; an item with fewer words is one
window. The automaton reads each normalised text once; a match marks its words, and word
positions map back to character offsets of the original text.

The benchmark is the broadcast side. Its size is checked: up to ``max_block_bytes`` of text
it is one automaton, beyond that items are dealt into blocks of at most about that size and the
documents are scanned once per block, so a worker never holds more than one block.

Cases: null or empty texts have no words and no hits; items without words are no window;
several items may share an id (they count once) or a window (each is reported); a null item
id is reported as ``null``; an empty benchmark hits nothing; repeated rows are scanned one by
one; all input columns are kept, ``result`` is the only one added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from staywise.llm.common import KEPT, utf8
from staywise.session import ship_code, written

WIDTH = 13
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>,runs:array<struct<start:int,end:int>>>"

#: A-Z become a-z; every other ASCII character but digits and a-z becomes a space.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

_BUILT: dict[int, tuple] = {}
KEPT.append(_BUILT)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


def windows_of(words: list[bytes], width: int) -> Iterator[bytes]:
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield b" ".join(words[i : i + width])


def build(items: list[tuple[str, str]], width: int):
    """The automaton over all windows, and for each window its word count and the items that have it."""
    import ahocorasick

    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows_of(words_of((text or "").encode()), width):
            found.setdefault(window, set()).add(item)
    automaton, windows = ahocorasick.Automaton(), []
    for window, ids in found.items():
        automaton.add_word(f" {window.decode('latin-1')} ", len(windows))
        windows.append((window.count(b" ") + 1, sorted(ids)))
    if windows:
        automaton.make_automaton()
    return automaton if windows else None, windows


def scan(data: bytes, automaton, windows: list) -> tuple[int, int, list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """Word count, hit words, items, character spans of the hits, and their runs of word positions."""
    import re

    import numpy as np

    normal = data.translate(TABLE)
    words = normal.split()
    if automaton is None or not words:
        return len(words), 0, [], [], []
    joined = b" ".join(words).decode("latin-1")
    matches = list(automaton.iter(f" {joined} "))
    if not matches:
        return len(words), 0, [], [], []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    closing = np.cumsum(lengths + 1)  # where the space after each word stands in the padded text
    last = np.searchsorted(closing, [end for end, _ in matches])
    items = sorted({item for _, k in matches for item in windows[k][1]})
    runs: list[list[int]] = []
    for first, stop in sorted((int(e) - windows[k][0] + 1, int(e) + 1) for e, (_, k) in zip(last, matches)):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([first, stop])
    places = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
    chars = lambda at: len(data[:at].decode("utf-8", "replace"))
    spans = [(chars(places[a][0]), chars(places[b - 1][1])) for a, b in runs]
    return len(words), sum(b - a for a, b in runs), items, spans, [(a, b) for a, b in runs]


def _scanner(shared, width: int):
    """The scan of one block as a column function; each worker builds the automaton once."""

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = shared.id
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build(shared.value, width)
        automaton, windows = _BUILT[key]
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for texts in batches:
            rows = [scan(data, automaton, windows) for start in range(0, len(texts), 256) for data in utf8(texts.slice(start, 256))]
            named = lambda k: pa.array([[{"start": a, "end": b} for a, b in r[k]] for r in rows], pa.list_(pair))
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    named(3),
                    named(4),
                ],
                ["n_words", "n_hit", "items", "spans", "runs"],
            )

    return run


class _Shared:
    """A broadcast list with an id that workers can key their automaton by."""

    def __init__(self, spark, items):
        self._broadcast = spark.sparkContext.broadcast(items)
        self.id = self._broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}

    @property
    def value(self):
        return self._broadcast.value


def _merged():
    """Two blocks' results as one: hits are counted over the union of their word runs."""
    positions = lambda runs: F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["end"] - 1)))
    a, b = F.col("__a"), F.col("__b")
    runs = F.array_distinct(F.concat(a["runs"], b["runs"]))
    return F.struct(
        a["n_words"].alias("n_words"),
        F.size(F.array_distinct(positions(runs))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.concat(a["items"], b["items"]))).alias("items"),
        F.array_sort(F.array_distinct(F.concat(a["spans"], b["spans"]))).alias("spans"),
        F.array_sort(runs).alias("runs"),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    max_block_bytes: int = 32 << 20,
    result: str = "contamination",
) -> DataFrame:
    """Add a struct ``result``: n_words, n_hit, items (ids with occurring windows), spans (characters), runs (words)."""
    spark = docs.sparkSession
    ship_code(spark)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(item_text).cast("string").alias("t"))
    held = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-held // max_block_bytes))
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        shared = _Shared(spark, [(r.i, r.t) for r in part.collect()])
        column = _scanner(shared, width)(F.col(text).cast("string"))
        if k == 0:
            out = out.withColumn(result, column)
        else:
            out = out.withColumnRenamed(result, "__a").withColumn("__b", column)
            out = out.withColumn(result, _merged()).drop("__a", "__b")
        if blocks > 1:  # one block's automaton at a time
            out = written(out, "contamination")
    return out


def contaminated(result: str = "contamination", share: int = 20):
    """At least one word in ``share`` is hit."""
    r = F.col(result)
    return (r["n_hit"] > 0) & (share * r["n_hit"] >= r["n_words"])
