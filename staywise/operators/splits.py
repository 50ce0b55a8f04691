"""Exact stratified splits and folds.

Rows are ordered inside each class by ``md5(seed:id)``. A split is a range of that
order, so it is described by one cut key per class and boundary. Finding the cuts
takes two small aggregates; assigning rows is then a narrow expression without a
shuffle, and no class is ever gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise import fixed_values as fv

_BUCKET_DIGITS = 4


def order_key(id_column: str, seed: int) -> Column:
    """Position of a row in the seeded order; the id breaks hash ties."""
    text = F.col(id_column).cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), F.lit(":"), text)


@dataclass(frozen=True)
class Cuts:
    """Per class, the last key of every range but the open last one (None: empty range)."""

    label: str
    id_column: str
    seed: int
    names: tuple
    last_keys: dict

    def assign(self) -> Column:
        """The range a row falls in, as a column."""
        key = order_key(self.id_column, self.seed)
        whole: Column | None = None
        for value, keys in self.last_keys.items():
            chain: Column | None = None
            for name, last in zip(self.names, keys):
                if last is not None:
                    chain = F.when(key <= last, F.lit(name)) if chain is None else chain.when(key <= last, F.lit(name))
            in_class = F.lit(self.names[-1]) if chain is None else chain.otherwise(F.lit(self.names[-1]))
            matches = F.col(self.label).eqNullSafe(F.lit(value))
            whole = F.when(matches, in_class) if whole is None else whole.when(matches, in_class)
        return F.lit(None) if whole is None else whole


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class. A label is a small enumeration; more than ``MAX_CLASSES`` values are refused."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(fv.MAX_CLASSES + 1).collect()
    if len(rows) > fv.MAX_CLASSES:
        raise ValueError(f"{label} has more than {fv.MAX_CLASSES} values and cannot stratify")
    return {r[0]: r["n"] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0]))}


def proportional_quotas(sizes: dict, draw: int) -> dict:
    """Share ``draw`` over classes by size; leftovers go to the largest remainders, then by label."""
    total = sum(sizes.values())
    quotas = {c: n * draw // total for c, n in sizes.items()}
    order = sorted(sizes, key=lambda c: -((sizes[c] * draw) % total))
    for c in order[: draw - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def find_cuts(df: DataFrame, label: str, id_column: str, seed: int, names: list, ends: Callable[[dict], dict]) -> Cuts:
    """Locate the key at every range end.

    ``ends`` maps class sizes to the cumulative row counts at which each range but
    the last stops.
    """
    sizes = class_sizes(df, label)
    wanted = ends(sizes)
    keyed = df.select(F.col(label).alias("label"), order_key(id_column, seed).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, _BUCKET_DIGITS))
    spark = df.sparkSession
    targets = [(c, i, int(end)) for c, stops in wanted.items() for i, end in enumerate(stops) if end > 0]
    found: dict = {}
    if targets:
        kind = df.schema[label].dataType.simpleString()
        # One row per class and boundary: bounded by the check in class_sizes.
        target = F.broadcast(spark.createDataFrame(targets, f"label {kind}, part int, end bigint"))
        running = Window.partitionBy("label").orderBy("bucket")
        counts = (
            keyed.groupBy("label", "bucket")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.sum("n").over(running) - F.col("n"))
        )
        # At most 16**4 buckets per class enter this window and exactly one per target leaves it.
        cut = counts.join(target, counts["label"].eqNullSafe(target["label"])).where(
            (F.col("before") < F.col("end")) & (F.col("end") <= F.col("before") + F.col("n"))
        ).select(target["label"].alias("cut_label"), F.col("bucket").alias("cut_bucket"), "part", "end", "before")
        inside = keyed.join(
            F.broadcast(cut), F.col("label").eqNullSafe(F.col("cut_label")) & (F.col("bucket") == F.col("cut_bucket"))
        )
        # Equal keys are counted first, so an id that repeats is one row here and stays in one range.
        per_key = inside.groupBy("cut_label", "part", "end", "before", "key").agg(F.count(F.lit(1)).alias("n"))
        ordered = Window.partitionBy("cut_label", "part").orderBy("key")
        ranked = per_key.withColumn("upto", F.sum("n").over(ordered) + F.col("before"))
        hit = (F.col("upto") - F.col("n") < F.col("end")) & (F.col("end") <= F.col("upto"))
        rows = ranked.where(hit).select("cut_label", "part", "key").collect()
        found = {(r["cut_label"], r["part"]): r["key"] for r in rows}
    last_keys = {c: tuple(found.get((c, i)) for i in range(len(names) - 1)) for c in sizes}
    return Cuts(label, id_column, seed, tuple(names), last_keys)


def three_way_cuts(
    df: DataFrame,
    label: str = fv.TARGET,
    id_column: str = fv.ID,
    test_share: float = fv.TEST_SHARE,
    val_share: float = fv.VALIDATION_SHARE,
    seed: int = fv.SEED,
) -> Cuts:
    """Test first, then validation from what is left, with exact class quotas."""

    def ends(sizes: dict) -> dict:
        test = proportional_quotas(sizes, math.ceil(sum(sizes.values()) * test_share))
        left = {c: sizes[c] - test[c] for c in sizes}
        val = proportional_quotas(left, math.ceil(sum(left.values()) * (val_share / (1.0 - test_share))))
        return {c: (test[c], test[c] + val[c]) for c in sizes}

    return find_cuts(df, label, id_column, seed, ["test", "val", "train"], ends)


def fold_cuts(
    df: DataFrame, label: str = fv.TARGET, id_column: str = fv.ID, folds: int = fv.FOLDS, seed: int = fv.SEED
) -> Cuts:
    """``folds`` ranges per class whose sizes differ by at most one row."""

    def ends(sizes: dict) -> dict:
        return {c: tuple(n * (i + 1) // folds for i in range(folds - 1)) for c, n in sizes.items()}

    return find_cuts(df, label, id_column, seed, list(range(folds)), ends)


def stratified_split(df: DataFrame, **options) -> DataFrame:
    """Add ``split``: train, val or test."""
    return df.withColumn("split", three_way_cuts(df, **options).assign())


def stratified_folds(df: DataFrame, **options) -> DataFrame:
    """Add ``fold``: 0 .. folds-1."""
    return df.withColumn("fold", fold_cuts(df, **options).assign().cast("long"))
