"""Resuming an enrichment: what is done, what is pending, how results come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators.clean import add_note_columns


class DuplicateIds(ValueError):
    """The finished side holds an id more than once, so a lookup would be ambiguous."""


def repeated_ids(df: DataFrame, key: str = fv.ID) -> DataFrame:
    """(id, n) of the ids that occur more than once, as text; a missing id matches nothing and is left out."""
    ids = df.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull())
    return ids.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str = fv.ID) -> None:
    repeated = repeated_ids(df, key).limit(1).collect()
    if repeated:
        raise DuplicateIds(f"{key} {repeated[0][0]!r} occurs {repeated[0]['n']} times")


def is_pending() -> Column:
    return F.col(fv.NOTE).isNull() | F.col(fv.TAG).isNull()


def with_finished(raw: DataFrame, finished: DataFrame, pending: str | None = None) -> DataFrame:
    """Left join by id as text; a match brings its note and tag even where they are NULL.

    Finished ids must be unique, or rows would multiply: ``DuplicateIds`` otherwise.
    ``pending`` names a flag column to add. It is worked out on either side before
    the join, so a plan that only needs the flag does not move the notes.
    """
    require_unique(finished)
    done = finished.select(
        F.col(fv.ID).cast("string").alias("_done_id"),
        F.col(fv.NOTE).alias("_done_note"),
        F.col(fv.TAG).alias("_done_tag"),
        is_pending().alias("_done_open"),
    )
    table = add_note_columns(raw).withColumn("_raw_open", is_pending())
    joined = table.join(done, F.col(fv.ID).cast("string") == F.col("_done_id"), "left")
    matched = F.col("_done_id").isNotNull()
    picked = {
        fv.NOTE: F.when(matched, F.col("_done_note")).otherwise(F.col(fv.NOTE)),
        fv.TAG: F.when(matched, F.col("_done_tag")).otherwise(F.col(fv.TAG)),
    }
    if pending:
        picked[pending] = F.when(matched, F.col("_done_open")).otherwise(F.col("_raw_open"))
    return joined.withColumns(picked).drop("_done_id", "_done_note", "_done_tag", "_done_open", "_raw_open")


def pending_rows(raw: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows of ``raw`` without a complete result: an anti join on the completed ids only."""
    complete = finished.where(~is_pending()).select(F.col(fv.ID).cast("string").alias("_done_id"))
    return raw.join(complete, F.col(fv.ID).cast("string") == F.col("_done_id"), "left_anti")


def write_back(table: DataFrame, results: DataFrame) -> DataFrame:
    """Put new notes into pending rows; rows without a result stay pending. Result ids must be unique."""
    require_unique(results)
    new = results.select(
        F.col(fv.ID).cast("string").alias("_new_id"), F.col(fv.NOTE).alias("_new_note"), F.col(fv.TAG).alias("_new_tag")
    )
    joined = table.join(new, F.col(fv.ID).cast("string") == F.col("_new_id"), "left")
    replace = is_pending() & F.col("_new_id").isNotNull()
    # Both are computed from the row as joined, before either is replaced.
    return joined.withColumns(
        {
            fv.NOTE: F.when(replace, F.col("_new_note")).otherwise(F.col(fv.NOTE)),
            fv.TAG: F.when(replace, F.col("_new_tag")).otherwise(F.col(fv.TAG)),
        }
    ).drop("_new_id", "_new_note", "_new_tag")


def progress(table: DataFrame) -> DataFrame:
    """One row: total, processed and pending."""
    return table.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~is_pending()).alias("processed"),
        F.count_if(is_pending()).alias("pending"),
    )
