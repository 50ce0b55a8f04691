"""Checks on generated notes and their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import ratio


def tag_label_crosstab(df: DataFrame) -> DataFrame:
    """Tag by label, one column per label."""
    label = F.col(fv.TARGET)
    return df.groupBy(fv.TAG).agg(F.count_if(label == "No").alias("no"), F.count_if(label == "Yes").alias("yes"))


def tag_rates(df: DataFrame) -> DataFrame:
    """Per tag: rows, share of all rows and label rate."""
    tallied = df.groupBy(fv.TAG).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(fv.TARGET) == "Yes").alias("churned")
    )
    # One row per tag enters this window.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return tallied.select(
        fv.TAG, "n", ratio(F.col("n"), total).alias("share"), ratio(F.col("churned"), F.col("n")).alias("label_rate")
    )


def leaking_tags(df: DataFrame, limit: float = fv.LEAKAGE_RATE) -> DataFrame:
    """Tags with a flag: does the tag nearly determine the label, either way?"""
    rate = F.col("label_rate")
    return tag_rates(df).withColumn("leaks", (rate >= limit) | (rate <= 1.0 - limit))


def leaking_words(df: DataFrame, words: list[str]) -> DataFrame:
    """Notes of each class that contain a label word, for every word from one scan."""
    text = F.lower(F.col(fv.NOTE))
    yes = F.col(fv.TARGET) == "Yes"
    tallies = []
    for i, w in enumerate(words):
        has = F.contains(text, F.lit(w.lower()))
        tallies += [F.count_if(has & yes).alias(f"y{i}"), F.count_if(has & ~yes).alias(f"n{i}")]
    rows = [
        F.struct(F.lit(w).alias("word"), F.col(f"y{i}").alias("in_churned"), F.col(f"n{i}").alias("in_kept"))
        for i, w in enumerate(words)
    ]
    return df.agg(*tallies).select(F.inline(F.array(*rows)))


def note_diversity(df: DataFrame, exact: bool = False) -> DataFrame:
    """Share of distinct notes and whether it is high enough.

    The exact form compares digests, so long texts are not shuffled.
    """
    digest = F.md5(fv.NOTE)
    if exact:
        per_text = df.where(F.col(fv.NOTE).isNotNull()).groupBy(digest.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        counted = per_text.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("notes"), F.count(F.lit(1)).alias("unique_notes"))
    else:
        counted = df.agg(
            F.count(fv.NOTE).alias("notes"), F.approx_count_distinct(digest, 0.01).alias("unique_notes")
        )
    share = ratio(F.col("unique_notes"), F.col("notes"))
    return counted.withColumn("share", share).withColumn("diverse", share > fv.NOTE_DIVERSITY_FLOOR)


def review_sample(df: DataFrame, share: float = fv.REVIEW_SHARE, seed: int = fv.SEED) -> DataFrame:
    """A reproducible sample: rows whose seeded hash falls below ``share``."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"review-{seed}:"), F.col(fv.ID).cast("string"))), 1, 8), 16, 10)
    return df.where(head.cast("long") < int(share * 2**32))
