"""What a boosted-tree model attends to: importances and per-row contributions.

Contributions are path-dependent Shapley values (Lundberg et al. 2018). For one
leaf the game only involves the features on its path: with z the share of the training
weight that follow a split and o = 1 where the row itself follows it, the weight of a
feature is a sum over subset sizes of the other features. That sum is carried as a
polynomial in the subset size, once for all rows of an Arrow batch that follow the same splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators.tree_model import Leaf, TreeModel
from staywise.session import ship_code


def _subset_weights(size: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(size - s - 1) / math.factorial(size) for s in range(size)])


def contributions(x: np.ndarray, leaves: list[Leaf]) -> tuple[np.ndarray, float]:
    """Per row and feature its share of the margin, and the base value."""
    rows, width = x.shape
    phi, base = np.zeros((rows, width)), 0.0
    for leaf in leaves:
        base += leaf.value * float(np.prod(leaf.kept))
        if not len(leaf.features):
            continue
        cells = x[:, leaf.features]
        # NaN lies below every threshold, as in the trees.
        follows = np.where(np.isnan(cells), np.isneginf(leaf.low), (cells > leaf.low) & (cells <= leaf.high))
        # Rows that follow the same splits share their values.
        codes = follows @ (1 << np.arange(len(leaf.features)))
        present, place = np.unique(codes, return_inverse=True)
        patterns = (present[:, None] >> np.arange(len(leaf.features))) & 1
        phi[:, leaf.features] += leaf.value * _pattern_weights(patterns.astype(float), leaf.kept)[place]
    return phi, base


def _pattern_weights(follows: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Shapley values of each feature of a unit leaf, for rows of 0/1 that say which splits are followed.

    The product of ``kept_j + follows_j * z`` over all features is built once, and a feature's own
    factor is divided out again: a square number of steps for all features of the leaf together.
    """
    n, size = follows.shape
    whole = np.zeros((n, size + 1))
    whole[:, 0] = 1.0
    for j in range(size):
        shifted = np.zeros_like(whole)
        shifted[:, 1:] = whole[:, :-1] * follows[:, j : j + 1]
        whole = whole * kept[j] + shifted
    weights = _subset_weights(size)
    out = np.zeros((n, size))
    for i in range(size):
        rest = np.zeros((n, size))
        rest[:, -1] = whole[:, -1]
        for k in range(size - 1, 0, -1):
            rest[:, k - 1] = whole[:, k] - kept[i] * rest[:, k]
        # Without the split, the factor is a number; where that is 0 the feature changes nothing.
        plain = whole[:, :-1] / kept[i] if kept[i] > 0 else np.zeros((n, size))
        rest = np.where(follows[:, i : i + 1] > 0, rest, plain)
        out[:, i] = (follows[:, i] - kept[i]) * (rest @ weights)
    return out


def attribute(df: DataFrame, model: TreeModel, names: list[str], features: str, keep: list[str]) -> DataFrame:
    """Add ``base``, ``margin`` and ``contributions array<struct<feature, value>>``.

    ``features`` is ``array<double>``; contributions plus base equal the raw margin.
    """
    ship_code(df.sparkSession)
    leaves = model.leaves()
    context = df.sparkSession.sparkContext
    # The model itself: trees x leaves, independent of the data.
    shared = context.broadcast(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            phi, base = contributions(np.stack(batch["_x"].to_numpy()).astype(float), shared.value)
            yield batch[keep].assign(base=base, margin=phi.sum(axis=1) + base, _phi=list(phi))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    schema = ", ".join([*fields, "base double", "margin double", "_phi array<double>"])
    labels = F.array(*[F.lit(n) for n in names])
    explained = df.select(*keep, F.col(features).alias("_x")).mapInPandas(explain, schema)
    paired = F.zip_with(labels, "_phi", lambda n, v: F.struct(n.alias("feature"), v.alias("value")))
    return explained.withColumn("contributions", paired).drop("_phi")


def top_contributions(c: Column, k: int) -> Column:
    """The ``k`` contributions largest in size, strongest first."""
    keyed = F.transform(c, lambda e: F.struct((-F.abs(e["value"])).alias("order"), e["feature"].alias("feature"), e["value"].alias("value")))
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"))
    )


def linear_contributions(model: LogisticRegressionModel, means: list[float], columns: list[str]) -> list[Column]:
    """Closed form for the stacking model: coefficient times distance from the mean."""
    return [
        (F.lit(float(w)) * (F.col(c) - F.lit(float(m)))).alias(f"contribution_{c}")
        for w, m, c in zip(model.coefficients, means, columns)
    ]


def top_importances(model: TreeModel, df: DataFrame, names: list[str] | None, k: int = fv.TOP_IMPORTANCES) -> DataFrame:
    """The ``k`` most important features; nameless ones are called feature_i."""
    values = model.importances()
    rows = [(names[i] if names else f"feature_{i}", float(v)) for i, v in enumerate(values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), F.asc("feature")).limit(k)
