"""Fitted transforms for the structured branch.

Fitting reads the training split only and yields a handful of numbers and names.
Applying is a plain select of JVM expressions, the same for training and scoring.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import nan_to_null, to_number
from staywise.functions.text import category_or_unknown
from staywise.operators.clean import coerce_numbers
from staywise.operators.explore import category_values
from staywise.operators.ranking import exact_quantiles


@dataclass(frozen=True)
class NumberScale:
    median: float
    mean: float
    spread: float


@dataclass(frozen=True)
class StructuredTransform:
    """Medians, means, spreads and vocabularies of a training split."""

    numbers: dict[str, NumberScale] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def names(self) -> list[str]:
        indicators = [f"cat__{c}_{v}" for c, values in self.categories.items() for v in values]
        return [f"num__{c}" for c in self.numbers] + indicators

    def columns(self, df: DataFrame) -> list[Column]:
        """The feature columns over ``df`` in fixed order."""
        kinds = dict(df.dtypes)
        out = []
        for c, s in self.numbers.items():
            out.append(((filled(c, s.median, kinds) - s.mean) / (s.spread or 1.0)).alias(f"num__{c}"))
        for c, values in self.categories.items():
            text = category_or_unknown(F.col(f"`{c}`"))
            out += [F.when(text == v, 1.0).otherwise(0.0).alias(f"cat__{c}_{v}") for v in values]
        return out

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *self.columns(df))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("number", c, json.dumps(asdict(s))) for c, s in self.numbers.items()]
        rows += [("category", c, json.dumps(values)) for c, values in self.categories.items()]
        numbered = [(i, *row) for i, row in enumerate(rows)]
        table = spark.createDataFrame(numbered, "position int, kind string, name string, fitted string")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> StructuredTransform:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["position"])
        numbers = {r["name"]: NumberScale(**json.loads(r["fitted"])) for r in rows if r["kind"] == "number"}
        categories = {r["name"]: json.loads(r["fitted"]) for r in rows if r["kind"] == "category"}
        return StructuredTransform(numbers, categories)


def filled(column: str, median: float, kinds: dict[str, str]) -> Column:
    c = F.col(f"`{column}`")
    number = to_number(c) if kinds[column] == "string" else nan_to_null(c.cast("double"))
    return F.coalesce(number, F.lit(float(median)))


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; a column without any number is left out."""
    fitted = exact_quantiles(df, columns, [0.5])
    return {f["feature"]: float(f["quantiles"][0]) for f in fitted if f["count"]}


def fit_structured(
    train: DataFrame,
    numbers: list[str] | None = None,
    categories: list[str] | None = None,
) -> StructuredTransform:
    """Median, mean and population spread per number; sorted vocabulary per category."""
    numbers = fv.NUMERIC_FEATURES if numbers is None else numbers
    categories = fv.CATEGORICAL_FEATURES if categories is None else categories
    medians = fit_medians(coerce_numbers(train, numbers), numbers) if numbers else {}
    scales = {}
    if medians:
        kinds = dict(train.dtypes)
        aggregates = []
        for i, (c, m) in enumerate(medians.items()):
            value = filled(c, m, kinds)
            aggregates += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
        fitted = train.agg(*aggregates).first()
        scales = {
            c: NumberScale(m, float(fitted[f"m{i}"]), float(fitted[f"s{i}"])) for i, (c, m) in enumerate(medians.items())
        }
    known = train.select(*[category_or_unknown(F.col(f"`{c}`")).alias(c) for c in categories])
    return StructuredTransform(scales, category_values(known, categories))
