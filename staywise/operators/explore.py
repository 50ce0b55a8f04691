"""Exploratory statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators.clean import coerce_numbers, collapse_redundant, drop_missing, map_binaries
from staywise.functions.numbers import cell, nan_to_null
from staywise.operators.ranking import exact_quantiles
from staywise.session import ship_code


def class_counts(df: DataFrame, label: str = fv.TARGET) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def imbalance_ratio(df: DataFrame, label: str = fv.TARGET) -> DataFrame:
    """Majority, minority and their ratio, one row."""
    return class_counts(df, label).agg(
        F.max("n").alias("majority"),
        F.min("n").alias("minority"),
        (F.max("n").cast("double") / F.min("n")).alias("ratio"),
    )


def feature_class_counts(df: DataFrame, features: list[str], label: str = fv.TARGET) -> DataFrame:
    """(feature, value, class, n) for every feature from one scan."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]
    return df.select(label, F.inline(F.array(*cells))).groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing), one row per column from one aggregate; NaN is missing."""
    names = columns or df.columns
    counted = df.agg(*[F.count_if(cell(df, c).isNull()).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in names]
    return counted.select(F.inline(F.array(*cells)))


def boxplot_stats(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier counts per class and column."""
    fitted = exact_quantiles(df, columns, [0.25, 0.5, 0.75], [label])
    fitted = [f for f in fitted if f["count"]]
    aggregates = []
    for i, f in enumerate(fitted):
        q1, _, q3 = f["quantiles"]
        reach = 1.5 * (q3 - q1)
        v = F.col(f"`{f['feature']}`").cast("double")
        mine = F.when(F.col(label).eqNullSafe(F.lit(f[label])) & ~F.isnan(v), v)
        near = F.when((mine >= q1 - reach) & (mine <= q3 + reach), mine)
        aggregates += [
            F.min(near).alias(f"lo_{i}"),
            F.max(near).alias(f"hi_{i}"),
            (F.count(mine) - F.count(near)).alias(f"out_{i}"),
        ]
    spread = df.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(f["feature"]).alias("feature"),
            F.lit(f[label]).alias(label),
            F.lit(f["count"]).cast("long").alias("n"),
            *[F.lit(float(q)).alias(name) for q, name in zip(f["quantiles"], ("q1", "median", "q3"))],
            F.col(f"lo_{i}").alias("whisker_low"),
            F.col(f"hi_{i}").alias("whisker_high"),
            F.col(f"out_{i}").alias("outliers"),
        )
        for i, f in enumerate(fitted)
    ]
    return spread.select(F.inline(F.array(*rows)))


def cleaned_for_exploration(df: DataFrame) -> DataFrame:
    """Numbers coerced, incomplete rows dropped, categories collapsed and mapped."""
    complete = drop_missing(coerce_numbers(df, ["TotalCharges"]))
    return map_binaries(collapse_redundant(complete))


def drop_first_dummies(df: DataFrame, skip: list[str], keep: list[str] | None = None) -> DataFrame:
    """Text columns to 0/1 doubles without the first category; number columns to double."""
    kinds = dict(df.dtypes)
    kept = [c for c in df.columns if c not in skip]
    texts = [c for c in kept if kinds[c] == "string"]
    vocabulary = category_values(df, texts)
    numbers = [F.col(f"`{c}`").cast("double").alias(c) for c in kept if c not in texts]
    dummies = [
        F.when(F.col(f"`{c}`") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c in texts for v in vocabulary[c][1:]
    ]
    return df.select(*(keep or []), *numbers, *dummies)


def category_values(df: DataFrame, columns: list[str], limit: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values per column. More than ``limit`` in all cannot become columns and is refused.

    The default limit is ``fixed_values.MAX_CATEGORIES``.
    """
    limit = fv.MAX_CATEGORIES if limit is None else limit
    if not columns:
        return {}
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    distinct = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()
    rows = distinct.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories in {columns}")
    values: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        values[row["column"]].append(row["value"])
    return {c: sorted(found) for c, found in values.items()}


# --- pair moments ---------------------------------------------------------------


#: Columns of a block; a tile is a pair of blocks.
BLOCK = 256
#: Cells that a task sums up in one scan; wider tables take several scans.
TILE_CELLS = 1 << 20
#: What a tile holds, by rows a and columns b: pairs, sums and squares of a where b is present and the other way round, products.
_PARTS = ("n", "s_a", "s_b", "ss_a", "ss_b", "sp")


def _added(total: np.ndarray, rest: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``total + part``, with what rounding cuts off gathered in ``rest``."""
    both = total + part
    rest += np.where(np.abs(total) >= np.abs(part), (total - both) + part, (part - both) + total)
    return both


def _matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    cells = batch.column("x").flatten()
    return cells.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, p)


def _means(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    n, s = np.zeros(p), np.zeros(p)
    for batch in batches:
        x = _matrix(batch, p)
        n += (~np.isnan(x)).sum(axis=0)
        s += np.nansum(x, axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array(n), pa.array(s)], ["i", "n", "s"])


def _tiles(batches: Iterator[pa.RecordBatch], shift: np.ndarray, tiles: list[tuple[int, int]], block: int) -> Iterator[pa.RecordBatch]:
    """a, b, sums: this task's share of each tile."""
    held: dict[tuple, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch, len(shift))
        present = ~np.isnan(x)
        mask = present.astype(float)
        x = np.where(present, x - shift, 0.0)
        for a, b in tiles:
            i, j = slice(a * block, (a + 1) * block), slice(b * block, (b + 1) * block)
            xa, xb, ma, mb = x[:, i], x[:, j], mask[:, i], mask[:, j]
            part = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])
            if (a, b) not in held:
                held[a, b] = [np.zeros_like(part), np.zeros_like(part)]
            held[a, b][0] = _added(*held[a, b], part)
    for (a, b), (total, rest) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([(total + rest).tobytes()], pa.binary())], ["a", "b", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of one tile after the other to its sums."""
    last, total, rest = None, None, None
    for batch in batches:
        for a, b, payload in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sums"))):
            part = np.frombuffer(payload, float)
            if (a, b) == last:
                total = _added(total, rest, part)
                continue
            if last is not None:
                yield _tile(last, total + rest)
            last, total, rest = (a, b), part.copy(), np.zeros_like(part)
    if last is not None:
        yield _tile(last, total + rest)


def _tile(at: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["a", "b", "sums"])


def moment_tiles(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, DataFrame]:
    """The columns' means, and the pairwise-complete sums about them as tiles (a, b, sums; a <= b).

    A task holds at most ``TILE_CELLS`` cells at a time, tiles meet by their key, and rounding is
    carried along, so many rows do not blur the sums.
    """
    ship_code(df.sparkSession)
    p = len(columns)
    table = df.select(F.array(*[nan_to_null(F.col(f"`{c}`").cast("double")) for c in columns]).alias("x"))
    found = table.mapInArrow(partial(_means, p=p), "i int, n double, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    shift = np.zeros(p)
    for r in found.collect():
        if r["n"] and np.isfinite(r["s"]):
            shift[r["i"]] = r["s"] / r["n"]
    blocks = -(-p // BLOCK)
    pairs = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    at_once = max(1, TILE_CELLS // (BLOCK * BLOCK))
    out = None
    for k in range(0, len(pairs), at_once):
        shares = table.mapInArrow(partial(_tiles, shift=shift, tiles=pairs[k : k + at_once], block=BLOCK), "a int, b int, sums binary")
        sums = shares.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_merged, "a int, b int, sums binary")
        out = sums if out is None else out.unionByName(sums)
    return shift, out


def _sums(a: int, b: int, payload: bytes, p: int, block: int) -> dict[str, np.ndarray]:
    shape = (len(_PARTS), min(block, p - a * block), min(block, p - b * block))
    return dict(zip(_PARTS, np.frombuffer(payload, float).reshape(shape)))


def pair_moments(df: DataFrame, columns: list[str]) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """Pairwise-complete sums over all rows, shifted by column means, as p x p matrices on the driver."""
    p = len(columns)
    shift, tiles = moment_tiles(df, columns)
    out = {c: np.zeros((p, p)) for c in ("n", "s", "ss", "sp")}
    for r in tiles.collect():
        i, j = slice(r["a"] * BLOCK, (r["a"] + 1) * BLOCK), slice(r["b"] * BLOCK, (r["b"] + 1) * BLOCK)
        m = _sums(r["a"], r["b"], r["sums"], p, BLOCK)
        for name, own, other in (("n", "n", "n"), ("s", "s_a", "s_b"), ("ss", "ss_a", "ss_b"), ("sp", "sp", "sp")):
            out[name][i, j] = m[own]
            out[name][j, i] = m[other].T
    return columns, shift, out


def _correlations(batches: Iterator[pa.RecordBatch], p: int, block: int) -> Iterator[pa.RecordBatch]:
    """i, j, corr of both orders of every pair of a tile."""
    for batch in batches:
        for a, b, payload in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sums"))):
            m = _sums(a, b, payload, p, block)
            with np.errstate(divide="ignore", invalid="ignore"):
                covariance = m["sp"] - m["s_a"] * m["s_b"] / m["n"]
                one, two = m["ss_a"] - m["s_a"] ** 2 / m["n"], m["ss_b"] - m["s_b"] ** 2 / m["n"]
                corr = covariance / np.sqrt(one * two)
            # A constant column leaves only rounding noise in its spread.
            flat = (one <= 1e-12 * np.maximum(m["ss_a"], 1e-300)) | (two <= 1e-12 * np.maximum(m["ss_b"], 1e-300))
            corr = np.where(flat | ~np.isfinite(corr), np.nan, np.clip(corr, -1.0, 1.0))
            i, j = (v.ravel().astype(np.int32) for v in np.indices(corr.shape))
            i, j, corr = i + a * block, j + b * block, corr.ravel()
            for x, y in ((i, j),) if a == b else ((i, j), (j, i)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(corr, mask=np.isnan(corr))], ["i", "j", "corr"])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, column, corr) for every ordered pair; NULL where a column is constant."""
    _, tiles = moment_tiles(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    found = tiles.mapInArrow(partial(_correlations, p=len(columns), block=BLOCK), "i int, j int, corr double")
    return found.select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), "corr")


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """VIF of each column regressed on the others without intercept, from one Gram matrix.

    A column that the others determine has an infinite VIF; one that is zero throughout has none (NULL).
    """
    names, shift, m = pair_moments(df, columns)
    gram = m["sp"] + shift[:, None] * m["s"].T + m["s"] * shift[None, :] + m["n"] * np.outer(shift, shift)
    scale = np.sqrt(np.diag(gram))
    scale = np.where(scale > 0, scale, 1.0)
    present = np.diag(gram) > 0
    values = np.full(len(names), np.nan)
    if present.any():
        # Sums over many rows carry rounding noise, so an eigenvalue this small is a dependency.
        levels, vectors = np.linalg.eigh((gram / np.outer(scale, scale))[np.ix_(present, present)])
        real = levels > 1e-10 * levels.max()
        inverse = (vectors[:, real] ** 2 / levels[real]).sum(axis=1)
        determined = (vectors[:, ~real] ** 2).sum(axis=1) > 1e-8
        values[present] = np.where(determined, np.inf, inverse)
    rows = [(name, None if np.isnan(v) else float(v)) for name, v in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "Feature string, VIF double").orderBy(F.desc("VIF"))
