"""Monitors over scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from staywise import fixed_values as fv
from staywise.functions.numbers import ratio
from staywise.sources.landing import path_exists


_SUMS = ("scored", "score_sum", "fallbacks", "positives", "hits")


def daily_tallies(scores: DataFrame, time: str = "ts") -> DataFrame:
    """Per day: scores, sum of scores, fallbacks and outcome counts.

    Expects ``label``, ``prediction``, ``probability`` and ``nlp_branch_available``.
    """
    hit = (F.col("label") == 1) & (F.col("prediction") == 1)
    return scores.groupBy(F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("scored"),
        F.sum("probability").alias("score_sum"),
        F.count_if(~F.col("nlp_branch_available")).alias("fallbacks"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(hit).alias("hits"),
    )


def _mark(spark: SparkSession, path: str, batch_id: int):
    """The latest day of the batches before this one, from what the last of them left."""
    before = f"{path}/batch={batch_id - 1}"
    row = spark.read.parquet(before).agg(F.max("mark").alias("mark")).first() if batch_id > 0 and path_exists(spark, before) else None
    return None if row is None else row["mark"]


def tallies_stream(scores: DataFrame, path: str, checkpoint: str, delay_days: int = 1) -> StreamingQuery:
    """Add every micro-batch's part of the daily tallies; rows count however late they come.

    Tallies are sums, so a batch writes its own share of each day and nothing is kept in state: a
    late row corrects its day, and with it the rolling windows, as soon as it arrives. ``late``
    counts the rows of a batch that came more than ``delay_days`` after the latest day of the
    batches before, ``mark`` is the latest day so far. A batch reads the folder of the batch before
    it only, and overwrites its own on a replay.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = F.lit(_mark(spark, path, batch_id)).cast("date")
        own = daily_tallies(batch)
        late = F.when(F.col("day") < F.date_sub(mark, delay_days), F.col("scored")).otherwise(F.lit(0)).cast("long")
        # One row a day, also in a batch without rows, so that the mark goes on.
        latest = own.agg(F.greatest(mark, F.max("day")).alias("mark"))
        rows = own.select("day", *_SUMS, late.alias("late"), F.lit(None).cast("date").alias("mark"))
        rows = rows.unionByName(latest.select("mark"), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        scores.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_tallies(written: DataFrame) -> DataFrame:
    """The days of all batches so far: the sums, and how many of the scores came late."""
    days = written.filter(F.col("scored").isNotNull())
    return days.groupBy("day").agg(*[F.sum(c).alias(c) for c in (*_SUMS, "late")])


def rolling_monitors(daily: DataFrame, days: int = fv.ROLLING_DAYS) -> DataFrame:
    """Rolling recall, fallback share and score shift per day, with alarms.

    Input has one row per day, so the window holds a calendar, not events.
    """
    ordinal = F.unix_date("day")
    calendar = Window.partitionBy(F.lit(0)).orderBy(ordinal)
    rolling = calendar.rangeBetween(-(days - 1), 0)
    whole = Window.partitionBy(F.lit(0))

    def over(name: str, w=rolling) -> Column:
        return F.sum(name).over(w)

    recall = ratio(over("hits"), over("positives"))
    share = ratio(F.col("fallbacks"), F.col("scored"))
    shift = ratio(F.col("score_sum"), F.col("scored")) - ratio(over("score_sum", whole), over("scored", whole))
    return daily.select(
        "day",
        "scored",
        recall.alias("rolling_recall"),
        share.alias("fallback_share"),
        shift.alias("score_shift"),
        (recall < fv.ROLLING_RECALL_FLOOR).alias("recall_alarm"),
        (share > fv.FALLBACK_SHARE_LIMIT).alias("fallback_alarm"),
        (F.abs(shift) > fv.SCORE_SHIFT_LIMIT).alias("shift_alarm"),
    )


def suite_failure_rate(reports: DataFrame, by: list[str]) -> DataFrame:
    """Share of failed expectations per group, with an alarm."""
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("success")).alias("failed")
    ).withColumn("failure_rate", ratio(F.col("failed"), F.col("checks"))).withColumn(
        "alarm", F.col("failure_rate") > fv.SUITE_FAILURE_LIMIT
    )
