"""Evaluation of the three runs on the test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators.measures import confusion_matrix, metric_suite, with_lift
from staywise.plans.training import StackedModel, positive_probability, score_branch, stack_vector, training_rows
from staywise.session import written


def run_scores(features: DataFrame, model: StackedModel, split: str = "test") -> DataFrame:
    """(run, id, label, prediction, probability): the split is scored once and unpivoted."""
    rows = training_rows(features, split)
    rows = score_branch(rows, model.structured, "structured", "p_struct")
    rows = score_branch(rows, model.text, "text", "p_nlp")
    rows = model.meta.transform(stack_vector(rows)).withColumn("p_meta", positive_probability("meta_probability"))
    runs = [
        F.struct(F.lit(run).alias("run"), F.col(p).alias("probability"))
        for run, p in zip(fv.RUN_ORDER, ("p_struct", "p_nlp", "p_meta"))
    ]
    long = rows.select(fv.ID, "label", F.inline(F.array(*runs)))
    return long.withColumn("prediction", F.when(F.col("probability") >= fv.DECISION_THRESHOLD, 1).otherwise(0))


def evaluate(features: DataFrame, model: StackedModel, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """(metrics per run with lifts, confusion per run)."""
    # Both results read the scores, and ranking them for the area reads them again.
    scores = written(run_scores(features, model, split), "run-scores")
    return with_lift(metric_suite(scores, ["run"])), confusion_matrix(scores, ["run"])
