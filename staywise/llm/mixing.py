"""Mixing sources to target weights: pivotal dependent rounding of fractional copies.

Every source gets a target in words: its weight's share of the mix, at most ``max_copies``
times its own words, with the excess reshared by weight among the others. A document of the
source is to be taken ``target / source words`` times; the whole part is certain and the
fraction is rounded so that the source's words stay put: two open documents meet, mass moves
from one to the other at random until one of them is settled, and the other stays open. The
chance of either direction keeps each document's expectation, and the sum of words changes
only when the last open document of a source is settled, by less than that document.

Distribution. Documents are dealt into ``buckets`` by a hash of their identity, so a hot
source is spread over all buckets. Each bucket is sorted and settled in one pass with one
open document per source; the open ones, at most one per source and bucket, climb a tree of
fan-in ``fan_in`` in the same way. Draws come from hashes of the seed and the two documents,
so a rerun, a retry or another number of tasks gives the same mix.

Cases: a null text has no words; documents without words are taken 0 words (their copies
follow the whole part); a null source is a source of its own, last in order; rows of equal
identity (doc id, source, text) are one item of their joint size and get equal copies; a
source without words has target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import WORD
from staywise.session import ship_code, written

WEIGHTS = (3, 1, 2)
ITEM = "node int, source string, doc_id long, print long, size long, rows long, base int, open double"


def share_out(sizes: list[int], weights: list[float], total: float, max_copies: float) -> list[float]:
    """Targets by weight, none above ``max_copies`` times its size; what is cut off is shared again."""
    targets = [0.0] * len(sizes)
    live, left = [k for k, s in enumerate(sizes) if s > 0], total
    while live:
        weight = sum(weights[k] for k in live)
        over = [k for k in live if left * weights[k] / weight > max_copies * sizes[k]]
        if not over:
            for k in live:
                targets[k] = left * weights[k] / weight
            break
        for k in over:
            targets[k] = float(max_copies * sizes[k])
        left -= sum(targets[k] for k in over)
        live = [k for k in live if k not in set(over)]
    return targets


def _draw(seed: int, *parts) -> float:
    import xxhash

    return xxhash.xxh64(repr(parts).encode(), seed=seed).intdigest() / 2.0**64


def meet(a: tuple[float, float], b: tuple[float, float], draw: float) -> tuple[float, float]:
    """New fractions of two open items (mass, fraction); one of them becomes 0 or 1.

    Up to ``u`` mass can move to the first and up to ``v`` to the second. Choosing the first
    with chance ``v / (u + v)`` leaves both expectations as they were.
    """
    (ma, pa_), (mb, pb) = a, b
    u, v = min(ma * (1 - pa_), mb * pb), min(ma * pa_, mb * (1 - pb))
    if draw * (u + v) < v:
        first_full = ma * (1 - pa_) <= mb * pb
        return (1.0, min(1.0, max(0.0, pb - u / mb))) if first_full else (min(1.0, pa_ + u / ma), 0.0)
    second_full = mb * (1 - pb) <= ma * pa_
    return (min(1.0, max(0.0, pa_ - v / ma)), 1.0) if second_full else (0.0, min(1.0, pb + v / mb))


def _settle(batches: Iterator[pa.RecordBatch], seed: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Sorted items in, the same items out: fractions settled but for one open item per node and source."""
    names = ["node", "source", "doc_id", "print", "size", "rows", "base", "open"]
    schema = pa.schema(
        [("node", pa.int32()), ("source", pa.string()), ("doc_id", pa.int64()), ("print", pa.int64()), ("size", pa.int64()), ("rows", pa.int64()), ("base", pa.int32()), ("open", pa.float64())]
    )
    out: list[tuple] = []
    held, group = None, None

    def closed(item):
        if last and 0 < item[7] < 1:
            return (*item[:7], float(_draw(seed, "last", item[1:4]) < item[7]))
        return item

    for batch in batches:
        for item in zip(*(batch.column(n).to_pylist() for n in names)):
            if item[:2] != group:
                if held is not None:
                    out.append(closed(held))
                held, group = None, item[:2]
            if item[4] * item[5] <= 0 or not 0 < item[7] < 1:
                out.append((*item[:7], 0.0 if item[4] * item[5] <= 0 else item[7]))
            elif held is None:
                held = item
            else:
                one, two = meet((held[4] * held[5], held[7]), (item[4] * item[5], item[7]), _draw(seed, held[1:4], item[1:4]))
                held, item = (*held[:7], one), (*item[:7], two)
                if 0 < two < 1:
                    held, item = item, held
                out.append(item)
                if not 0 < held[7] < 1:
                    out.append(held)
                    held = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if held is not None:
        out.append(closed(held))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size`` (words) and ``print`` (a hash of the text that tells rows of one id apart)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.regexp_count(body, F.lit(WORD)).cast("long"), "print": F.xxhash64(F.col(text))})


def copies(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    max_copies: float = 2.0,
    key: str = "doc_id",
    source: str = "source",
    seed: int = 20,
    buckets: int = 256,
    fan_in: int = 16,
) -> DataFrame:
    """One row per identity of ``sized`` (see ``with_size``): doc_id, source, print, size, rows, source_size, target, copies.

    The sources are collected (one row each); targets and copy rates come from their sizes alone.
    """
    spark = sized.sparkSession
    ship_code(spark)
    rows = sized.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), "print", "size")
    # Pre-aggregated in each task, so equal rows meet as a few partial counts.
    items = rows.groupBy("doc_id", "source", "print").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    # A file starts processes while it is written: items are small, so two files a core are enough.
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    items = written(items.coalesce(tasks), "mix-items")
    sums = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("n")).collect()
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n) for r in sums]
    targets = share_out(sizes, [float(weights[k % len(weights)]) for k in range(len(sums))], share * sum(sizes), max_copies)
    rated = [(r.source, n, t, int(t // n) if n else 0, (t / n) % 1.0 if n else 0.0) for r, n, t in zip(sums, sizes, targets)]
    sources = spark.createDataFrame(rated, "source string, source_size long, target double, base int, open double")
    if len(rated) <= 100_000:
        sources = F.broadcast(sources)
    else:
        sources = written(sources, "mix-sources")

    dealt = items.alias("i").join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source")))
    node = F.pmod(F.xxhash64("i.doc_id", "i.print"), F.lit(buckets)).cast("int")
    level = dealt.select(node.alias("node"), "i.source", "i.doc_id", "i.print", "i.size", "i.rows", "s.base", "s.open")
    settled, nodes = None, buckets
    while True:
        # Large documents meet first, so that what stays open to the end is small.
        mass = (F.col("size") * F.col("rows")).desc()
        # Nodes of few rows share a task, and a level is written as few files, into however many parts it is dealt.
        ordered = level.repartition("node").sortWithinPartitions("node", "source", mass, "doc_id", "print")
        done = written(ordered.mapInArrow(partial(_settle, seed=seed, last=nodes == 1), ITEM).coalesce(tasks), "mix-level")
        whole = done.filter(~((F.col("open") > 0) & (F.col("open") < 1)))
        settled = whole if settled is None else settled.unionByName(whole)
        if nodes == 1:
            break
        nodes = -(-nodes // fan_in)
        level = done.filter((F.col("open") > 0) & (F.col("open") < 1)).withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
    named = settled.alias("i").join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source")))
    return named.select(
        "i.doc_id", "i.source", "i.print", "i.size", "i.rows", "s.source_size", "s.target", (F.col("i.base") + F.col("i.open").cast("int")).alias("copies")
    )


def mixed(docs: DataFrame, columns: list[str] | None = None, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    columns = columns or docs.columns
    chosen = copies(with_size(docs, text), **how).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("print").alias("__print"), F.col("copies").alias("__copies")
    )
    key, source = how.get("key", "doc_id"), how.get("source", "source")
    same = F.col(key).cast("long").eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__source"))
    joined = docs.withColumn("__own", F.xxhash64(F.col(text))).join(
        chosen.filter("__copies > 0"), same & F.col("__own").eqNullSafe(F.col("__print"))
    )
    repeated = joined.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*columns)
