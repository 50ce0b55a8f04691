"""Minority oversampling between nearest neighbours.

Points are joined by sort and merge: their vectors take many times the room of the Parquet
files by whose size Spark would broadcast them through the driver.

Oversampling looks for the exact neighbours among all points of the class, whatever its
size: from a broadcast while the points are few, beyond by ``nearest_neighbours``. Only a
caller who names ``max_points`` gets the neighbours within a sample.

``nearest_neighbours`` is exact among all points. Splits at medians deal distinct points to
cells, whose boxes are known. Requests of neighbouring cells form a group of bounded size, and a
crowded cell's requests several. A group first meets the points of its own cells, which bounds
every k-th distance; other cells are sent to it only where the distance between the boxes does not
rule them out, and a request meets their points only where its own distance to the box, against
the neighbours found so far, does not. Points stream by a group in pieces of bounded size, and
distances are computed with numpy. In many dimensions of even spread boxes rule out little, so ask
there for a stated set of requests rather than for all points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.vectors import dense_array
from staywise.operators.splits import class_sizes
from staywise.session import ship_code, written

_CELL_ROWS = 125
_CHUNK_ROWS = 20000
_SLICE_ROWS = 20000
_BLOCK_DRAWS = 10000
_CELLS_AT_ONCE = 4_000_000
_SAMPLE_ROWS = 100_000
_BROADCAST_BYTES = 256 << 20


def _unit(parts: list[Column], seed: int) -> Column:
    """A reproducible number in [0, 1) from the parts of a key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


@dataclass(frozen=True)
class Splits:
    """Cells as a tree: a node's feature (-1: a cell), its cut, and its children or the cell's number."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cells: int

    @staticmethod
    def of(sample: np.ndarray, most: int) -> Splits:
        """Halves of the feature that varies most, until a cell holds at most ``most`` of the sample; neighbours in number are neighbours in the tree."""
        nodes: list[list] = []
        cells = 0
        going: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
        while going:
            x, parent, side = going.pop()
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            spread = x.var(axis=0) if len(x) > most else np.zeros(0)
            f = int(spread.argmax()) if len(spread) and spread.max() > 0 else -1
            if f < 0:
                nodes.append([-1, 0.0, cells, cells])
                cells += 1
                continue
            cut, top = np.quantile(x[:, f], 0.5, method="lower"), x[:, f].max()
            if cut >= top:
                cut = x[x[:, f] < top, f].max()
            below = x[:, f] <= cut
            nodes.append([f, float(cut), -1, -1])
            going += [(x[~below], len(nodes) - 1, 3), (x[below], len(nodes) - 1, 2)]
        return Splits(*(np.array(c) for c in zip(*nodes)), cells)

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            inner = inner[self.feature[at[inner]] >= 0]
        return self.left[at].astype(np.int32)


def choose_splits(points: DataFrame, seed: int) -> Splits:
    """Cells of about ``_CELL_ROWS`` points, from a sample picked by hash; it decides what is ruled out, not what is found."""
    n = points.count()
    cells = max(1, n // _CELL_ROWS)
    many = min(n, 8 * cells, _SAMPLE_ROWS)
    rows = points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("pid").cast("string")))).limit(many).select("x").toArrow()
    sample = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return Splits.of(sample.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0)), max(1, many // cells))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _slices(batch: pd.DataFrame, columns: int) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose distance matrix to ``columns`` points stays small."""
    step = max(1, _CELLS_AT_ONCE // columns)
    for start in range(0, len(batch), step):
        yield batch.iloc[start : start + step]


def _assign(points: DataFrame, splits: Splits) -> DataFrame:
    """Add each point's cell."""
    ship_code(points.sparkSession)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=splits.cell(np.stack(batch["x"].to_numpy())))

    return points.mapInPandas(dealt, "pid string, x array<double>, copies long, cell int")


def _between(low: np.ndarray, high: np.ndarray, others_low: np.ndarray, others_high: np.ndarray) -> np.ndarray:
    """The least distance of points in a box from points in each of the others."""
    off = np.maximum(np.maximum(others_low - high, low - others_high), 0.0)
    return np.sqrt((off * off).sum(axis=1))


class _Group:
    """Requests of a group with the ``k`` nearest points met so far."""

    def __init__(self, number: int, k: int, low: np.ndarray, high: np.ndarray):
        self.number, self.k, self.low, self.high = number, k, low, high
        self.parts: list[tuple] = []
        self.cell = np.zeros(0, np.int32)

    def add(self, cell: int, *columns) -> None:
        """pid, x, distance, near, copies of requests of one cell."""
        self.parts.append((np.full(len(columns[0]), cell, np.int32), *columns))

    def close(self) -> None:
        """No more requests come."""
        if not self.parts:
            return
        self.cell, self.pid, self.x, self.distance, self.near, self.copies = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        self.homes = set(self.cell.tolist())
        self.columns = np.ascontiguousarray(self.x.T)
        self.least, self.most = self.x.min(axis=0), self.x.max(axis=0)
        # Rounding of distances, as they are computed, stays below this.
        self.slack = 1e-7 * (1.0 + np.sqrt((self.x * self.x).sum(axis=1)))
        self.reach = (self.distance[:, -1] + self.slack) ** 2

    def _open(self, cell: int) -> np.ndarray:
        """Requests as far from the cell's box as their neighbours, or less; only features in which the box leaves some out are looked at."""
        low, high = self.low[cell], self.high[cell]
        off = np.zeros(len(self.cell))
        for j in np.flatnonzero((self.least < low) | (self.most > high)).tolist():
            part = self.columns[j] - np.minimum(np.maximum(self.columns[j], low[j]), high[j])
            off += part * part
        return np.flatnonzero(off <= self.reach)

    def meet(self, cell: int, pid: np.ndarray, x: np.ndarray, copies: np.ndarray) -> None:
        self.close()
        if not len(self.cell):
            return
        rows = self._open(cell)
        own = pd.Index(pid) if cell in self.homes else None
        step = max(1, _CELLS_AT_ONCE // len(x))
        for part in (rows[a : a + step] for a in range(0, len(rows), step)):
            d = _distances(self.x[part], x)
            if own is not None:
                self_at = own.get_indexer(self.pid[part])
                present = np.flatnonzero(self_at >= 0)
                d[present, self_at[present]] = np.inf
            closer = np.flatnonzero(d.min(axis=1) < self.distance[part, -1])
            if not len(closer):
                continue
            d, part = d[closer], part[closer]
            keep = min(self.k, d.shape[1])
            best = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            distance = np.concatenate([self.distance[part], np.take_along_axis(d, best, axis=1)], axis=1)
            order = np.argsort(distance, axis=1, kind="stable")[:, : self.k]
            for name, found in (("distance", None), ("near", pid[best]), ("copies", copies[best])):
                both = distance if found is None else np.concatenate([getattr(self, name)[part], found], axis=1)
                getattr(self, name)[part] = np.take_along_axis(both, order, axis=1)
            self.reach[part] = (self.distance[part, -1] + self.slack[part]) ** 2

    def found(self) -> Iterator[pa.RecordBatch]:
        self.close()
        for a in range(0, len(self.cell), 10_000):
            own = slice(a, a + 10_000)
            lists = [pa.array(list(c[own]), pa.list_(t)) for c, t in ((self.x, pa.float64()), (self.distance, pa.float64()), (self.near, pa.string()), (self.copies, pa.int64()))]
            plain = [pa.array(np.full(len(self.cell[own]), self.number, np.int32)), pa.array(self.cell[own]), pa.array(self.pid[own], pa.string())]
            yield pa.RecordBatch.from_arrays([*plain, *lists], _FOUND.names)


_FOUND = pa.schema([("group", pa.int32()), ("cell", pa.int32()), ("pid", pa.string()), ("x", pa.list_(pa.float64())), ("distance", pa.list_(pa.float64())), ("near", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))])
_STATE = {"distance": "array<double>", "near": "array<string>", "copies": "array<bigint>"}


def _nothing() -> list[Column]:
    """No neighbours as empty lists: for every row that follows a run of NULL lists, Spark's Arrow writer walks through the run again."""
    return [F.array().cast(kind).alias(name) for name, kind in _STATE.items()]


def _meeting(batches: Iterator[pa.RecordBatch], k: int, boxes) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, kind (requests before points) and cell to the nearest points of each request."""
    low, high = boxes.value
    group: _Group | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        numbers, kinds, cells, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "kind", "cell", "point_copies"))
        pid = batch.column("pid").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        turns = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0) | (np.diff(cells) != 0)) + 1
        for start, stop in zip((0, *turns.tolist()), (*turns.tolist(), n)):
            if group is None or group.number != numbers[start]:
                if group is not None:
                    yield from group.found()
                group = _Group(int(numbers[start]), k, low, high)
            for a in range(start, stop, _CHUNK_ROWS):
                own = slice(a, min(stop, a + _CHUNK_ROWS))
                many = own.stop - a
                if kinds[a]:
                    group.meet(int(cells[a]), pid[own], x[own], copies[own].astype(np.int64))
                elif not len(batch.column("distance").slice(a, many).flatten()):
                    group.add(int(cells[a]), pid[own], x[own], np.full((many, k), np.inf), np.full((many, k), None, object), np.zeros((many, k), np.int64))
                else:
                    held = (batch.column(c).slice(a, many).flatten().to_numpy(zero_copy_only=False).reshape(many, k) for c in _STATE)
                    group.add(int(cells[a]), pid[own], x[own], *held)
    if group is not None:
        yield from group.found()


def _met(requests: DataFrame, points: DataFrame, visits: DataFrame, groups: int, k: int, boxes) -> DataFrame:
    """``requests`` (group, cell, pid, x and what was found so far) after meeting the points of the cells that ``visits`` names for their group."""
    sent = points.join(F.broadcast(visits), "cell").select(
        "group", F.lit(1).alias("kind"), "cell", "pid", "x", F.col("copies").alias("point_copies"), *_nothing()
    )
    asked = requests.select("group", F.lit(0).alias("kind"), "cell", "pid", "x", F.lit(0).cast("long").alias("point_copies"), *_STATE)
    dealt = asked.unionByName(sent).repartition(groups, "group").sortWithinPartitions("group", "kind", "cell")
    schema = "group int, cell int, pid string, x array<double>, distance array<double>, near array<string>, copies array<bigint>"
    return dealt.mapInArrow(partial(_meeting, k=k, boxes=boxes), schema)


def _near_cells(batches: Iterator[pa.RecordBatch], boxes) -> Iterator[pa.RecordBatch]:
    """(group, cell): the cells that the reach of a group's requests in one cell does not rule out."""
    low, high = boxes.value
    for batch in batches:
        for group, cell, reach in zip(*(batch.column(c).to_pylist() for c in ("group", "cell", "reach"))):
            a, b = low[cell], high[cell]
            slack = 1e-7 * (1.0 + math.sqrt(float((np.maximum(np.abs(a), np.abs(b)) ** 2).sum())))
            cells = np.flatnonzero(_between(a, b, low, high) <= reach + slack).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), group, np.int32)), pa.array(cells)], ["group", "cell"])


def _grouped(asked: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first group, number of groups): neighbouring cells share a group of about ``most`` requests, more of one cell are dealt to several."""
    out, group, held = [], 0, 0
    for cell, n in sorted(asked.items()):
        if held and held + n > most:
            group, held = group + 1, 0
        parts = max(1, math.ceil(n / most))
        out.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


def nearest_neighbours(points: DataFrame, requests: DataFrame, k: int, seed: int = fv.SEED) -> DataFrame:
    """(pid, near array<struct<distance, near, copies>>): the exact ``k`` nearest other points.

    ``points``: pid, x (array<double>), copies; x is unique. ``requests``: a subset of pid.
    """
    spark = points.sparkSession
    placed = written(_assign(points, choose_splits(points, seed)), "cells")
    asked = placed.join(requests.select("pid").hint("merge"), "pid", "left_semi")
    width = placed.agg(F.max(F.size("x"))).first()[0] or 0
    sides = [f(F.col("x")[j]) for f in (F.min, F.max) for j in range(width)]
    held = placed.groupBy("cell").agg(F.array(*sides[:width]).alias("low"), F.array(*sides[width:]).alias("high")).collect()
    low, high = np.full((2, max((r["cell"] for r in held), default=0) + 1, width), np.nan)
    for r in held:
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    boxes = spark.sparkContext.broadcast((low, high))  # two rows for the points of a cell

    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = math.ceil(sum(counts.values()) / (4 * spark.sparkContext.defaultParallelism))
    dealt = _grouped(counts, max(1, min(_SLICE_ROWS, max(spread, _CELL_ROWS))))
    groups = max((first + parts for _, first, parts in dealt), default=1)
    grid = F.broadcast(spark.createDataFrame(dealt, "grid_cell int, first int, parts int"))
    own = asked.join(grid, F.col("cell") == F.col("grid_cell")).select(
        (F.col("first") + F.pmod(F.xxhash64("pid"), "parts")).cast("int").alias("group"), "cell", "pid", "x", *_nothing()
    )
    homes = [(first + i, cell) for cell, first, parts in dealt for i in range(parts)]
    kinds = "group int, cell int"
    found = written(_met(own, placed, spark.createDataFrame(homes, kinds), groups, k, boxes), "home")

    reached = found.groupBy("group", "cell").agg(F.max(F.col("distance")[k - 1]).alias("reach"))
    own_cells = spark.createDataFrame(homes, kinds).hint("merge")
    visits = reached.repartition(4 * spark.sparkContext.defaultParallelism, "group", "cell").mapInArrow(partial(_near_cells, boxes=boxes), kinds)
    visits = written(visits.distinct().join(own_cells, ["group", "cell"], "left_anti"), "visits")
    found = _met(found, placed, visits, groups, k, boxes)
    listed = F.transform(F.arrays_zip("distance", "near", "copies"), lambda e: F.struct(e["distance"].alias("distance"), e["near"].alias("near"), e["copies"].alias("copies")))
    met = F.sort_array(F.filter(listed, lambda e: e["distance"] < float("inf")))
    return found.select("pid", met.alias("near")).where(F.size("near") > 0)


def neighbours_among(points: DataFrame, requests: DataFrame, k: int, max_points: int, seed: int = fv.SEED) -> DataFrame:
    """As ``nearest_neighbours``, but among at most ``max_points`` points, the first in a seeded order.

    Up to that many points the result is exact. Beyond, neighbours are the nearest of a
    sample, so the work grows with the requests alone. The sample is broadcast; its size is
    checked against ``_BROADCAST_BYTES``.
    """
    spark = points.sparkSession
    ship_code(spark)
    order = F.md5(F.concat(F.lit(f"near-{seed}:"), F.col("pid").cast("string")))
    taken = points.orderBy(order, "pid").limit(max_points).select("pid", "x", "copies").toArrow()
    have = taken.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    have = have.reshape(len(taken), -1) if len(taken) else have.reshape(0, 0)
    if have.nbytes > _BROADCAST_BYTES:
        raise ValueError(f"{len(taken)} neighbour points take {have.nbytes} bytes; lower max_points")
    ids, copies = (taken.column(c).to_numpy() for c in ("pid", "copies"))
    shared = spark.sparkContext.broadcast((have, ids.astype(object), copies))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, ids, copies = shared.value
        place_of = pd.Index(ids)
        for batch in batches:
            for part in _slices(batch, max(1, len(ids))):
                d = _distances(np.stack(part["x"].to_numpy()), have)
                own = place_of.get_indexer(part["pid"].to_numpy())
                present = np.nonzero(own >= 0)[0]
                d[present, own[present]] = np.inf
                keep = min(k, d.shape[1])
                near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
                dist = np.take_along_axis(d, near, axis=1)
                found = [
                    [(float(e), ids[j], int(copies[j])) for e, j in zip(row, places) if np.isfinite(e)] for row, places in zip(dist, near)
                ]
                yield pd.DataFrame({"pid": part["pid"].to_numpy(), "near": found})

    asked = points.join(requests.select("pid").hint("merge"), "pid", "left_semi").select("pid", "x")
    return asked.mapInPandas(nearest, "pid string, near array<struct<distance: double, near: string, copies: bigint>>")


def _neighbours(points: DataFrame, requests: DataFrame, k: int, max_points: int | None, seed: int) -> DataFrame:
    """Exact neighbours at every size, or those within a sample where the caller names its size."""
    if max_points is None:
        size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
        # Both ways are exact; only how the points reach the tasks differs.
        if size["n"] > fv.MAX_NEIGHBOUR_POINTS or size["n"] * (size["width"] or 0) * 8 > _BROADCAST_BYTES:
            return nearest_neighbours(points, requests, k, seed)
    return neighbours_among(points, requests, k, fv.MAX_NEIGHBOUR_POINTS if max_points is None else max_points, seed)


def smote(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    id_column: str = fv.ID,
    neighbours: int = fv.SMOTE_NEIGHBOURS,
    seed: int = fv.SEED,
    max_points: int | None = None,
) -> DataFrame:
    """Originals plus synthetic minority rows until all classes are equal.

    ``features`` is an array or a vector. Neighbours are exact among all minority
    points; ``max_points`` looks for them in a sample of that size instead (see ``neighbours_among``). Each synthetic row is ``x + u * (near - x)`` with
    ``u`` in [0, 1) and ``near`` one of the ``neighbours`` nearest points of the same class.
    Adds ``synthetic boolean``; a synthetic row has a NULL id.
    """
    df = df.withColumn(features, dense_array(df, features))
    sizes = class_sizes(df, label)
    top = max(sizes.values(), default=0)
    result = df.select(F.col(id_column), F.col(features), F.col(label)).withColumn("synthetic", F.lit(False))
    for value, n in sizes.items():
        if n == top:
            continue
        if n <= neighbours:
            raise ValueError(f"class {value!r} has {n} rows; {neighbours} neighbours need more")
        new = _synthesise(df.where(F.col(label) == F.lit(value)).select(id_column, features), n, top - n, neighbours, seed, max_points)
        rows = new.select(
            F.lit(None).cast(df.schema[id_column].dataType).alias(id_column),
            F.col("x").alias(features),
            F.lit(value).cast(df.schema[label].dataType).alias(label),
            F.lit(True).alias("synthetic"),
        )
        result = result.unionByName(rows)
    return result


def _synthesise(minority: DataFrame, n: int, wanted: int, k: int, seed: int, max_points: int | None) -> DataFrame:
    """``wanted`` synthetic points from ``n`` minority rows."""
    id_column, features = minority.columns
    # Identical rows are one point with a multiplicity: copies are each other's neighbours at
    # distance zero, and a point that fills a third of the class stays one row.
    distinct = minority.groupBy(F.col(features).alias("x")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.col(id_column).cast("string")).alias("key")
    )
    points = written(distinct.select(F.col("key").alias("pid"), "x", "copies"), "points")
    plan = _draws(points, n, wanted, seed)
    # Points with more than k copies have only copies as neighbours and need no search.
    search = plan.where(F.col("copies") <= k).select("pid")
    near = written(_neighbours(points, search, k, max_points, seed), "near")  # read for copies and for partners
    # A neighbour counts as often as it has copies; more than k of them make no difference.
    listed = F.flatten(F.transform("near", lambda e: F.array_repeat(e["near"], F.least(e["copies"], F.lit(k)).cast("int"))))
    choices = near.select("pid", listed.alias("others"))
    # A point with very many draws is cut into blocks that are spread out before they unfold.
    last_block = F.floor((F.col("draws") - 1) / _BLOCK_DRAWS)
    spots = (
        plan.join(choices.hint("merge"), "pid", "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .repartition("pid", "block")
        .withColumn("start", F.col("block") * _BLOCK_DRAWS)
        .withColumn("stop", F.least(F.col("draws"), F.col("start") + _BLOCK_DRAWS) - 1)
        .withColumn("draw", F.explode(F.sequence(F.col("start"), F.col("stop"))))
        .withColumn("pick", F.floor(_unit([F.col("pid"), F.col("draw"), F.lit("pick")], seed) * k).cast("int"))
        .withColumn("u", _unit([F.col("pid"), F.col("draw"), F.lit("step")], seed))
    )
    # The first copies - 1 neighbours are the point itself.
    rank = F.col("pick") - (F.col("copies") - 1)
    target = F.when(rank < 0, F.col("pid")).otherwise(F.get("others", rank.cast("int")))
    aimed = spots.select("pid", "x", "u", target.alias("target"))
    ends = points.select(F.col("pid").alias("target"), F.col("x").alias("y"))
    # A copy of itself needs no partner row.
    own = aimed.where(F.col("target") == F.col("pid")).select("x")
    between = aimed.where(F.col("target") != F.col("pid")).join(ends.hint("merge"), "target")
    stepped = between.select(F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)).alias("x"))
    return own.unionByName(stepped)


def _draws(points: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """How many synthetic rows start from each point; the total is exactly ``wanted``.

    Every row gets wanted // n; the remaining ones go to the rows first in a seeded
    order. Bucket totals tell in which bucket that order is cut, and only its points
    are ranked, without their features.
    """
    base, extra = divmod(wanted, n)
    order = F.md5(F.concat(F.lit(f"draw-{seed}:"), "pid"))
    keyed = points.withColumn("bucket", F.substring(order, 1, 3))
    # At most 4096 buckets.
    totals = sorted(keyed.groupBy("bucket").agg(F.sum("copies").alias("rows")).collect())
    cut, left = "", extra
    for bucket, rows in totals:
        if rows > left:
            cut = bucket
            break
        left -= rows
    inside = keyed.where(F.col("bucket") == cut).select("pid", "copies", order.alias("order"))
    upto = F.sum("copies").over(Window.partitionBy(F.lit(0)).orderBy("order", "pid"))
    part = inside.select(F.col("pid").alias("cut_pid"), F.least("copies", F.greatest(F.lit(0), F.lit(left) - upto + F.col("copies"))).alias("part"))
    placed = keyed.join(part, F.col("pid") == F.col("cut_pid"), "left")
    bonus = F.when(F.col("bucket") < cut, F.col("copies")).otherwise(F.coalesce("part", F.lit(0)))
    return placed.select("pid", "x", "copies", (F.col("copies") * base + bonus).alias("draws")).where("draws > 0")
