"""Feature build: split, fit on the training rows, transform every row once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators.clean import model_inputs
from staywise.operators.notes import EncoderFactory, TextTransform, fit_notes
from staywise.operators.preprocess import StructuredTransform, fit_structured
from staywise.operators.splits import stratified_split


@dataclass(frozen=True)
class FeatureBuild:
    """Feature rows (id, target, split, structured, text) and the two fitted transforms."""

    rows: DataFrame
    structured: StructuredTransform
    text: TextTransform


def transform_rows(
    df: DataFrame, structured: StructuredTransform, text: TextTransform, keep: list[str]
) -> DataFrame:
    """``keep`` plus ``structured array<double>``, ``text array<double>`` and ``nlp_available``."""
    gathered = df.select(*keep, F.col(fv.NOTE).alias("_note"), F.array(*structured.columns(df)).alias("structured"))
    return text.apply(gathered, "_note", "text").drop("_note")


def build_features(
    enriched: DataFrame,
    components: int = fv.TEXT_COMPONENTS,
    width: int = fv.EMBEDDING_WIDTH,
    factory: EncoderFactory | None = None,
    seed: int = fv.SEED,
) -> FeatureBuild:
    """The diagnostic tag never reaches a feature; every statistic comes from the training split."""
    split = stratified_split(enriched.drop(*fv.DIAGNOSTIC_COLUMNS), seed=seed)
    train = split.where(F.col("split") == "train")
    structured = fit_structured(model_inputs(train))
    text = fit_notes(train, components=components, width=width, factory=factory)
    rows = transform_rows(split, structured, text, [fv.ID, fv.TARGET, "split"])
    return FeatureBuild(rows, structured, text)


def wide_features(build: FeatureBuild) -> DataFrame:
    """One column per feature under the num__, cat__ and nlp__ names."""
    parts = [(build.structured.names(), "structured"), (build.text.names(), "text")]
    columns = [F.col(array)[i].alias(name) for names, array in parts for i, name in enumerate(names)]
    return build.rows.select(fv.ID, *columns, fv.TARGET, "split")
