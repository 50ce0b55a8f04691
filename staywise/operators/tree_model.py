"""A fitted tree model as a table: nodes with thresholds, leaf boxes, scores.

A saved model is a Parquet table of nodes. ``boxes`` turns it into leaf boxes: a row is in a
leaf where each feature on the path lies in ``(low, high]``. A score is the sum of the leaves'
values, so it can be had outside this library by an interval join; ``margins_by_boxes`` is that
join on Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from staywise.operators.boosting import Boosted, sigmoid
from staywise.session import ship_code

_NODES = "tree int, node int, feature int, threshold double, value double, gain double, cover double"


@dataclass(frozen=True)
class Leaf:
    """A leaf: its value, and per feature on its path the bounds and the share of rows kept."""

    tree: int
    node: int
    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kept: np.ndarray


@dataclass(frozen=True)
class TreeModel:
    """Trees as heaps in one array each; a leaf has feature -1. ``width`` features."""

    width: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def of(fitted: Boosted, trees: int | None = None) -> TreeModel:
        """The first ``trees`` of a fitted model, with thresholds in place of bins."""
        held = fitted.trees[:trees]
        size = max((len(t.feature) for t in held), default=1)
        table = {name: np.zeros((len(held), size)) for name in ("threshold", "value", "gain", "cover")}
        feature = np.full((len(held), size), -1, np.int32)
        for k, t in enumerate(held):
            n = len(t.feature)
            feature[k, :n] = t.feature
            for name in ("value", "gain", "cover"):
                table[name][k, :n] = getattr(t, name)
            for i in np.flatnonzero(t.feature >= 0):
                table["threshold"][k, i] = fitted.cuts[t.feature[i]][t.cut[i]]
        return TreeModel(len(fitted.cuts), feature, **table)

    def margins(self, x: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Log odds of each row; NaN goes left."""
        out = np.zeros(len(x))
        trees = np.arange(len(self.feature))[None, :]
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            at = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.feature.shape[1].bit_length() - 1):
                f = self.feature[trees, at]
                right = part[np.arange(len(part))[:, None], np.maximum(f, 0)] > self.threshold[trees, at]
                at = np.where(f >= 0, 2 * at + 1 + right, at)
            out[a : a + rows] = self.value[trees, at].sum(axis=1)
        return out

    def rows(self) -> list[tuple]:
        """The nodes that are in use, for ``_NODES``."""
        out = []
        for t in range(len(self.feature)):
            live = [0]
            while live:
                i = live.pop()
                out.append((t, i, int(self.feature[t, i]), *(float(getattr(self, c)[t, i]) for c in ("threshold", "value", "gain", "cover"))))
                if self.feature[t, i] >= 0:
                    live += [2 * i + 1, 2 * i + 2]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        empty = [(-1, self.width, -1, 0.0, 0.0, 0.0, 0.0)]  # the number of features
        spark.createDataFrame(empty + self.rows(), _NODES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        table = spark.read.schema(_NODES).parquet(path).toPandas()
        width = int(table.node[table.tree < 0].iloc[0])
        table = table[table.tree >= 0]
        trees = int(table.tree.max()) + 1 if len(table) else 0
        size = 1 << int(table.node.max() + 1).bit_length() if len(table) else 1
        feature = np.full((trees, size - 1 or 1), -1, np.int32)
        feature[table.tree, table.node] = table.feature
        held = {}
        for name in ("threshold", "value", "gain", "cover"):
            held[name] = np.zeros(feature.shape)
            held[name][table.tree, table.node] = table[name]
        return TreeModel(width, feature, **held)

    def leaves(self) -> list[Leaf]:
        """All leaves; a feature met twice on a path keeps the tighter bounds and the product of its shares."""
        out = []
        for t in range(len(self.feature)):
            open_nodes: list[tuple[int, dict]] = [(0, {})]
            while open_nodes:
                i, path = open_nodes.pop()
                f = int(self.feature[t, i])
                if f < 0:
                    names = sorted(path)
                    columns = [np.array([path[n][k] for n in names], float) for k in range(3)]
                    out.append(Leaf(t, i, float(self.value[t, i]), np.array(names, int), *columns))
                    continue
                low, high, kept = path.get(f, (-math.inf, math.inf, 1.0))
                cut, total = float(self.threshold[t, i]), float(self.cover[t, i])
                for child, bounds in ((2 * i + 2, (max(low, cut), high)), (2 * i + 1, (low, min(high, cut)))):
                    share = float(self.cover[t, child]) / total if total > 0 else 0.5
                    open_nodes.append((child, {**path, f: (*bounds, kept * share)}))
        return out

    def boxes(self, spark: SparkSession) -> DataFrame:
        """tree, leaf, value, sides, and a row per feature on the path: feature, low, high, kept. A bare root has one row without feature."""
        rows = []
        for leaf in self.leaves():
            sides = list(zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist(), leaf.kept.tolist())) or [(None, None, None, 1.0)]
            rows += [(leaf.tree, leaf.node, leaf.value, len(leaf.features), *side) for side in sides]
        return spark.createDataFrame(rows, "tree int, leaf int, value double, sides int, feature int, low double, high double, kept double")

    def importances(self) -> np.ndarray:
        """Each feature's share of all gain."""
        used = self.feature >= 0
        total = np.bincount(self.feature[used], self.gain[used], self.width)
        return total / total.sum() if total.sum() > 0 else total


def margins_by_boxes(rows: DataFrame, key: str, x: str, boxes: DataFrame) -> DataFrame:
    """key, margin: the leaves whose sides all hold a row's values, by an interval join on the feature."""
    values = rows.select(key, F.posexplode(x).alias("feature", "v"))
    nan = F.isnan("v")  # below every threshold, as in the trees
    inside = (nan & (F.col("low") == float("-inf"))) | (~nan & (F.col("v") > F.col("low")) & (F.col("v") <= F.col("high")))
    hits = values.join(boxes, "feature").filter(inside).groupBy(key, "tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.first("sides").alias("sides"), F.first("value").alias("value"))
    bare = boxes.filter("sides = 0").agg(F.sum("value")).first()[0] or 0.0  # trees that are a root alone
    sums = hits.filter("n = sides").groupBy(key).agg(F.sum("value").alias("margin"))
    return rows.select(key).join(sums, key, "left").select(key, (F.coalesce("margin", F.lit(0.0)) + F.lit(bare)).alias("margin"))


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Cells of a list column as rows of one matrix; a missing cell is all NaN."""
    out = np.full((len(x), width), np.nan)
    held = x.is_valid().to_numpy(zero_copy_only=False)
    out[held] = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(held.sum()), width)
    return out


def probability(spark: SparkSession, models: list[TreeModel], x: str, which: Column | None = None) -> Column:
    """The positive class's probability by the model that ``which`` numbers (the first one by default)."""
    ship_code(spark)
    shared = spark.sparkContext.broadcast(models)  # the models themselves, independent of the data

    @arrow_udf("double")
    def score(x: pa.Array, which: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        for k in which.unique().drop_null().to_pylist():
            own = pc.fill_null(pc.equal(which, k), False)
            model = shared.value[int(k)]
            out[own.to_numpy(zero_copy_only=False)] = sigmoid(model.margins(matrix(x.filter(own), model.width)))
        return pa.array(out, from_pandas=True)  # NaN as null

    return score(F.col(x), F.lit(0) if which is None else which)
