"""Phrase collocations from a weighted de Bruijn graph of word sequences.

The longest grams (``longest`` words) are edges between overlapping nodes of one word less. Each
position of a text gives one gram: the longest that starts there, cut short only at the end of
its piece. An edge's weight is the number of its positions.

1. Pruning. A first pass counts pairs of neighbouring words by 64-bit hash. A phrase that occurs
   ``least`` times holds only pairs that do, so a gram is also cut before a rarer pair, as if its
   piece ended there; the counts of phrases without rare pairs do not change. The frequent pairs
   are known to the second pass by a bitmap of fixed size: a false hit, or a bitmap that is full,
   costs rows, not results.
2. Weights. Grams are counted in each task, then by Spark.
3. Flow. The count of a shorter phrase is the weight that flows out of its node, over all edges
   to one word more, plus the pieces that end at it; one grouping a length, from long to short.
4. Compaction. A node with one way in and one way out of equal weight is passed by all its flow:
   the edges on both sides become one. Edges know the next edge on their path, and double the
   distance each round, until every edge knows the end of its path. A path is as long a phrase
   as its text is repeated; cut at ``longest`` words, it is the candidates of that length.
5. Candidates are cut in two at each place and scored in decimal arithmetic; those whose flow passes whole into a longer
   candidate are dropped.

Cases: null and empty texts have no words; a null language is ``und``; repeated rows count each
time; words of any length and texts of any length are taken whole; equal scores are ordered by
count and then by the phrase's bytes; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise.llm.common import slices, utf8
from staywise.session import ship_code, written

_PIECE = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KEPT_WORDS = 1_000_000
#: Positions that a task holds before it counts them.
_FLUSH = 1 << 20
#: Bits of the bitmap of frequent pairs.
BITMAP_BITS = 1 << 27
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class _Positions:
    """Words of a task as numbers, with 0 after each piece, by language."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.held: dict[str, list] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        out = self.held.setdefault(lang, [0])
        number, words = self.number, self.words
        # White space is blank and tab here; the rest of it ends pieces.
        for piece in _PIECE.split(text.lower()):
            for word in piece.replace(b"\t", b" ").split(b" "):
                if word:
                    n = number.get(word)
                    if n is None:
                        n = number[word] = len(words)
                        words.append(word)
                    out.append(n)
            if out[-1]:
                out.append(0)
        self.size += len(text) >> 2

    def full(self) -> bool:
        return self.size >= 4 * _FLUSH or len(self.words) > _KEPT_WORDS

    def hashes(self, lang: str):
        """A hash of each word within its language."""
        import numpy as np
        import xxhash

        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Positions]:
    held = _Positions()
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
            held.add(lang, text)
        if held.full():
            yield held
            held = _Positions()
    if held.size:
        yield held


def _pair_hashes(at, hashes):
    """The hash of each position's word and the next, and where both are words."""
    import numpy as np

    both = (at[:-1] > 0) & (at[1:] > 0)
    h = hashes[at]
    return _mix(h[:-1] * np.uint64(_MIX[2]) + h[1:]), both


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c: counts of neighbouring words by hash."""
    import numpy as np

    for held in _blocks(batches):
        for lang, numbers in held.held.items():
            pairs, both = _pair_hashes(np.array(numbers, np.int64), held.hashes(lang))
            found, count = np.unique(pairs[both], return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "c"])


def _grams(batches: Iterator[pa.RecordBatch], shared, longest: int) -> Iterator[pa.RecordBatch]:
    """lang, gram, k, c: each position's longest gram, counted."""
    import numpy as np

    bits = np.frombuffer(shared.value, np.uint8)
    for held in _blocks(batches):
        table = np.array(held.words, object)
        for lang, numbers in held.held.items():
            at = np.array(numbers, np.int64)
            pairs, go = _pair_hashes(at, held.hashes(lang))
            place = pairs % np.uint64(8 * len(bits))
            go &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            go = np.append(go, False)
            run = at > 0
            size = run.astype(np.int64)
            for step in range(1, longest):
                run = run[: len(at) - step + 1] & go[step - 1 :]
                size[: len(run)] += run
            for k in range(1, longest + 1):
                start = np.flatnonzero(size == k)
                if not len(start):
                    continue
                rows = np.stack([at[start + j] for j in range(k)], axis=1)
                order = np.lexsort(rows.T[::-1])
                rows = rows[order]
                fresh = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
                count = np.diff(np.append(fresh, len(rows)))
                for s in range(0, len(fresh), 1 << 16):
                    own = rows[fresh[s : s + (1 << 16)]]
                    grams = [b" ".join(r) for r in table[own].tolist()]
                    n = len(grams)
                    columns = [pa.array([lang] * n, pa.string()), pa.array(grams, pa.binary()).cast(pa.string()), pa.array(np.full(n, k, np.int32)), pa.array(count[s : s + n].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "k", "c"])


def _bitmap(batches: Iterator[pa.RecordBatch], n_bits: int, block: int) -> Iterator[pa.RecordBatch]:
    """Hashes of one task to blocks of the bitmap: at, bits."""
    import numpy as np

    bits = np.zeros(n_bits // 8, np.uint8)
    for batch in batches:
        place = batch.column("h").to_numpy().view(np.uint64) % np.uint64(n_bits)
        np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7))).astype(np.uint8))
    cut = bits.reshape(-1, block)
    held = np.flatnonzero(cut.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array([cut[k].tobytes() for k in held], pa.binary())], ["at", "bits"])


def frequent_pairs(rows: DataFrame, least: int, n_bits: int = BITMAP_BITS) -> bytes:
    """A bitmap of ``n_bits`` that holds the hash of every pair of words with ``least`` occurrences or more."""
    import numpy as np

    block = min(1 << 12, n_bits // 8)
    counted = rows.mapInArrow(_pairs, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    frequent = written(counted.filter(F.col("c") >= least).select("h"), "frequent-pairs")
    bits = np.zeros(n_bits // 8, np.uint8).reshape(-1, block)
    # A bitmap has a fixed number of blocks, and few tasks make it.
    made = frequent.coalesce(8).mapInArrow(partial(_bitmap, n_bits=n_bits, block=block), "at long, bits binary")
    for r in made.toLocalIterator():
        bits[r["at"]] |= np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes()


def _first(phrase: str, k: Column | int) -> Column:
    return F.substring_index(phrase, " ", k) if isinstance(k, int) else F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def weighted_grams(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, n_bits: int = BITMAP_BITS) -> DataFrame:
    """lang, gram, k, c: the graph's edges (``k = longest``) and the ends of pieces (shorter)."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(frequent_pairs(rows, least, n_bits))  # n_bits / 8 bytes, whatever the corpus
    grams = rows.mapInArrow(partial(_grams, shared=shared, longest=longest), "lang string, gram string, k int, c long")
    return grams.groupBy("lang", "gram", "k").agg(F.sum("c").alias("c"))


def flows(grams: DataFrame, longest: int = 5) -> list[DataFrame]:
    """lang, phrase, f for phrases of ``longest``, ..., 2, 1 words: outflow of each node plus the pieces that end there."""
    level = grams.filter(F.col("k") == longest).select("lang", F.col("gram").alias("phrase"), F.col("c").alias("f"))
    out = [level]
    for k in range(longest - 1, 0, -1):
        ends = grams.filter(F.col("k") == k).select("lang", F.col("gram").alias("phrase"), F.col("c").alias("f"))
        level = level.select("lang", _first("phrase", k).alias("phrase"), "f").unionByName(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        out.append(level)
    return out


def compact(edges: DataFrame, nodes: DataFrame, longest: int = 5) -> DataFrame:
    """lang, phrase, f, path_words, path_at: each edge, the words of its unary path, and its place on it.

    ``edges`` are phrases of ``longest`` words, ``nodes`` those of one less, with their flows. Only
    edges between nodes in the tables are seen, so rare ways in or out count through the flows: a
    node is unary where its only edges weigh as much as itself.
    """
    e = edges.select("lang", "phrase", "f", _first("phrase", longest - 1).alias("from"), _first("phrase", 1 - longest).alias("to"))
    into = e.select("lang", F.col("to").alias("node"), F.col("phrase").alias("before"), F.col("f").alias("f_in"))
    out = e.select("lang", F.col("from").alias("node"), F.col("phrase").alias("after"), F.col("f").alias("f_out"))
    unary = nodes.select("lang", F.col("phrase").alias("node"), F.col("f").alias("through"))
    # A node's whole flow on one edge leaves none for another, so these joins keep keys unique.
    unary = unary.join(into, ["lang", "node"]).filter("f_in = through").join(out, ["lang", "node"]).filter("f_out = through")
    steps = unary.filter("before != after").select("lang", F.col("before").alias("phrase"), F.col("after").alias("next"))
    started = e.select("lang", "phrase", "f").join(steps, ["lang", "phrase"], "left")
    ahead = F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")
    table = written(started.select("lang", "phrase", "f", "next", ahead.alias("ahead"), F.col("next").isNotNull().alias("moved")), "gram-paths")
    # Every piece has an end, where flow leaves a path; so paths end, and these rounds too.
    while table.filter("moved").limit(1).count():
        far = table.filter(F.col("next").isNotNull()).select("lang", F.col("phrase").alias("next"), F.col("next").alias("then"), F.col("ahead").alias("more"))
        gone = table.join(far, ["lang", "next"], "left")
        further = (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")
        table = written(gone.select("lang", "phrase", "f", F.coalesce("then", "next").alias("next"), further, F.col("then").isNotNull().alias("moved")), "gram-paths")
    ends = table.select("lang", "phrase", "f", "ahead", F.coalesce("next", "phrase").alias("last"))
    whole = ends.groupBy("lang", "last").agg((F.max("ahead") + longest).alias("path_words"))
    return ends.join(whole, ["lang", "last"]).select("lang", "phrase", "f", "path_words", (F.col("path_words") - longest - F.col("ahead")).alias("path_at"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, n_bits: int = BITMAP_BITS) -> DataFrame:
    """All phrases left: lang, phrase, words, a, l, r, n, score, path_words (of the longest unary path it lies on, else null)."""
    grams = written(weighted_grams(docs, text, lang, longest, least, n_bits), "phrase-grams")
    totals = grams.groupBy("lang").agg(F.sum("c").alias("n"))  # a row a language: every position starts one gram
    held = None
    for k, level in zip(range(longest, 0, -1), flows(grams, longest)):
        rows = level.filter(F.col("f") >= least).withColumn("words", F.lit(k))
        held = rows if held is None else held.unionByName(rows)
    held = written(held, "phrase-counts")
    paths = compact(held.filter(F.col("words") == longest), held.filter(F.col("words") == longest - 1), longest)

    long = held.filter("words > 1")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", _first("phrase", F.col("k")).alias("head"), _first("phrase", F.col("k") - F.col("words")).alias("rest"))
    part = lambda name, f: held.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Phrases within longer ones that carry their whole flow.
    spans = [(i, m) for m in range(2, longest) for i in range(longest - m + 1)]
    inner = F.array(*[F.when(F.col("words") >= i + m, F.when(F.col("words") > m, F.array_join(F.slice("w", i + 1, m), " "))) for i, m in spans])
    inside = long.filter("words > 2").withColumn("w", F.split("phrase", " ")).select("lang", "f", F.explode(F.array_distinct(F.array_compact(inner))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("whole"))
    left = lowest.join(inside, ["lang", "phrase"], "left").filter(F.col("whole").isNull() | (F.col("whole") < F.col("a")))
    return left.join(paths.select("lang", "phrase", "path_words"), ["lang", "phrase"], "left").select(
        "lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), "path_words"
    )


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in whole decimals of 38 digits, enough for 10^17 words a language."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))


def top(phrases: DataFrame, first: int = 2000) -> DataFrame:
    """The first phrases of each language: lang, rank, and the columns of ``phrases``."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()
    # Ranked in parts first, so that no task holds a whole language.
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = phrases.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= first)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
