"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard stands on the ring at ``virtual`` places. A row hashes to a place and belongs to the
next virtual node clockwise (beyond its own place), unless that node's shard is full; rows beyond a shard's capacity go
on clockwise to the next shard that has room. With ``slack`` 0 the capacities add up to the
number of rows, so any two shards differ by at most one row; a larger slack moves fewer rows
when a shard is added.

How it is done in one shuffle. Rows are counted by cell (arc of the ring, cut in ``parts`` by a
hash of the text so that no arc or repeated id makes a large cell); there are shards x virtual x
parts cells, whatever the number of rows. The walk around the ring moves counts, not rows: it
yields fragments (cell, first rank, count, shard, first slot). Rows are then ranked within their
cell and the rank picks the fragment. Rows travel with their ids and sizes only, not their texts.

Cases: a null text has no bytes; null ids hash their text instead; equal rows differ only in rank
and share the cell's order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staywise.llm.common import bind, not_above
from staywise.session import written


def ring(shards: int, virtual: int, seed: int = 0) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; places are signed 64-bit."""
    places = []
    for shard in range(shards):
        for k in range(virtual):
            digest = hashlib.md5(f"{seed}/{shard}/{k}".encode()).digest()
            places.append((int.from_bytes(digest[:8], "big", signed=True), shard))
    return sorted(places)


def walk(counts: dict[int, int], owners: list[int], capacity: list[int], parts: int) -> list[tuple[int, int, int, int, int]]:
    """Fragments (cell, first rank, count, shard, first slot) of the bounded-load ring.

    ``counts`` are rows by cell, cell = arc * parts + part. First every arc fills its own shard in
    ring order, then what did not fit is carried clockwise until each piece finds room.
    """
    filled = [0] * len(capacity)
    fragments, waiting = [], [[] for _ in owners]

    def place(cell: int, first: int, n: int, shard: int) -> int:
        take = min(n, capacity[shard] - filled[shard])
        if take:
            fragments.append((cell, first, take, shard, filled[shard]))
            filled[shard] += take
        return take

    for cell in sorted(counts):
        arc, n = cell // parts, counts[cell]
        took = place(cell, 0, n, owners[arc])
        if took < n:
            waiting[arc].append((cell, took, n - took))
    carried: list[tuple[int, int, int]] = []
    for arc in [*range(len(owners)), *range(len(owners))]:
        carried += waiting[arc]
        waiting[arc] = []
        while carried and filled[owners[arc]] < capacity[owners[arc]]:
            cell, first, n = carried.pop(0)
            took = place(cell, first, n, owners[arc])
            if took < n:
                carried.insert(0, (cell, first + took, n - took))
    return fragments


def assign(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", virtual: int = 64, parts: int = 4, slack: float = 0.0, seed: int = 0
) -> DataFrame:
    """A row per input row: key, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    nodes = ring(shards, virtual, seed)
    bounds = [place for place, _ in nodes]
    placed = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(key).cast("string"), body, F.lit(""))).alias("place"),
    )
    part = F.pmod(F.xxhash64("text_crc32", "size"), F.lit(parts)).cast("int")
    arc = F.pmod(bind(F.col("place"), lambda p: not_above(p, bounds)), F.lit(len(nodes)))  # past the last node the ring starts again
    placed = written(placed.withColumn("cell", (arc * parts + part).cast("int")), "ring-places")

    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    room = int(total * (1 + slack))
    capacity = [room // shards + (s < room % shards) for s in range(shards)]
    plan = [list(f) for f in walk(counts, [shard for _, shard in nodes], capacity, parts)]
    kind = "array<struct<cell:int,first:bigint,n:bigint,shard:int,slot0:bigint>>"
    named = json.dumps([dict(zip(("cell", "first", "n", "shard", "slot0"), f)) for f in plan])
    fragments = written(spark.range(1).select(F.inline(F.from_json(F.lit(named), kind))), "ring-plan")

    order = Window.partitionBy("cell").orderBy("place", key, "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1).alias("r")
    on = (F.col("r.cell") == F.col("f.cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    # shards x virtual x parts fragments and at most one more per shard that fills up: a fixed size.
    joined = ranked.join(F.broadcast(fragments.alias("f")), on)
    return joined.select(f"r.{key}", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
