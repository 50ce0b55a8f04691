"""Classification measures over (label, prediction, probability) tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import ratio
from staywise.operators.ranking import running_counts
from staywise.session import written


def _tally(weight: Column | None = None) -> list[Column]:
    y, p = F.col("label") == 1, F.col("prediction") == 1
    cells = {"tp": y & p, "fn": y & ~p, "fp": ~y & p, "tn": ~y & ~p}
    if weight is None:
        return [F.count_if(test).alias(name) for name, test in cells.items()]
    return [F.coalesce(F.sum(F.when(test, weight)), F.lit(0)).alias(name) for name, test in cells.items()]


def confusion_matrix(df: DataFrame, by: list[str]) -> DataFrame:
    """tp, fn, fp, tn per group."""
    return df.groupBy(*by).agg(*_tally())


def with_rates(confusion: DataFrame) -> DataFrame:
    """Add recall, precision, f1 and the false positive rate; 0 where undefined."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return confusion.withColumns(
        {
            "recall": ratio(tp, tp + fn),
            "precision": ratio(tp, tp + fp),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fp_rate": ratio(fp, fp + tn),
        }
    )


def _area(tallied: DataFrame, by: list[str]) -> DataFrame:
    """Area from (group, score, pos, neg) rows with one row per score."""
    ranked = running_counts(tallied, by, "score", ["neg"])
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(wins), F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def _counts_by_score(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows per key and score, written once: ranking reads it twice, and it is all that is needed further on."""
    counted = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return written(counted, "scores")


def _sides(counted: DataFrame, by: list[str]) -> DataFrame:
    positive = F.col("label") == 1
    return counted.groupBy(*by, "score").agg(
        F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("neg"),
    )


def roc_auc(df: DataFrame, by: list[str], score: str = "probability") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL when a class is absent."""
    return _area(_sides(_counts_by_score(df, [*by, "label"], score), by), by)


def metric_suite(df: DataFrame, by: list[str], score: str = "probability") -> DataFrame:
    """recall, precision, f1 and roc_auc per group, from one scan of the scores."""
    counted = _counts_by_score(df, [*by, "label", "prediction"], score)
    rates = with_rates(counted.groupBy(*by).agg(*_tally(F.col("n"))))
    areas = _area(_sides(counted, by), by).select(*[F.col(b).alias(f"_{b}") for b in by], "roc_auc")
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return rates.join(areas, same).select(*by, *fv.RUN_METRICS)


def _from_run(run: str, value: Column) -> Column:
    """``value`` of one named run, on every row of a table with one row per run."""
    return F.max(F.when(F.col("run") == run, value)).over(Window.partitionBy(F.lit(0)))


def with_lift(metrics: DataFrame, base: str = fv.RUN_ORDER[0], lifted: str = fv.RUN_ORDER[2]) -> DataFrame:
    """Add recall and f1 lift of the stacked run over the structured one, NULL on other runs."""
    is_lifted = F.col("run") == lifted
    return metrics.withColumns(
        {
            f"{m}_lift": F.when(is_lifted, F.col(m) - _from_run(base, F.col(m)))
            for m in ("recall", "f1")
        }
    )


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "probability") -> DataFrame:
    """Confusion and rates at every threshold, from one scan."""
    y, p = F.col("label") == 1, F.col(score)
    tallies = []
    for i, t in enumerate(thresholds):
        hit = p >= F.lit(float(t))
        tallies += [F.count_if(y & hit).alias(f"tp{i}"), F.count_if(y & ~hit).alias(f"fn{i}")]
        tallies += [F.count_if(~y & hit).alias(f"fp{i}"), F.count_if(~y & ~hit).alias(f"tn{i}")]
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fn", "fp", "tn")])
        for i, t in enumerate(thresholds)
    ]
    return with_rates(df.agg(*tallies).select(F.inline(F.array(*rows))))


def false_positive_reduction(confusion: DataFrame, base: str = fv.RUN_ORDER[0]) -> DataFrame:
    """Share of the base run's false positives that each run avoids."""
    at_base = _from_run(base, F.col("fp"))
    return with_rates(confusion).withColumn("fp_reduction", ratio(at_base - F.col("fp"), at_base))


def group_fairness(df: DataFrame, groups: list[str]) -> DataFrame:
    """True and false positive rate per value of every group column, from one scan."""
    cells = [F.struct(F.lit(g).alias("attribute"), F.col(g).cast("string").alias("value")) for g in groups]
    long = df.select("label", "prediction", F.inline(F.array(*cells)))
    rated = with_rates(confusion_matrix(long, ["attribute", "value"]))
    return rated.withColumnRenamed("recall", "tp_rate").drop("precision", "f1")


def stability_index(df: DataFrame, column: str, is_actual: Column, bounds: list[float]) -> DataFrame:
    """Population stability index of one column between two parts of a table.

    Shares are floored so that an empty range counts without being infinite.
    """
    v = F.col(column).cast("double")
    bin_id = F.lit(0)
    for b in bounds:
        bin_id = bin_id + F.when(v >= b, 1).otherwise(0)
    counted = df.where(v.isNotNull()).groupBy(bin_id.cast("long").alias("bin")).agg(
        F.count_if(is_actual).alias("actual"), F.count_if(~is_actual).alias("expected")
    )
    # At most len(bounds) + 1 rows enter this window.
    whole = Window.partitionBy(F.lit(0))

    def share(name: str) -> Column:
        return F.greatest(ratio(F.col(name), F.sum(name).over(whole)), F.lit(1e-4))

    shares = counted.select("bin", share("actual").alias("actual_share"), share("expected").alias("expected_share"))
    part = (F.col("actual_share") - F.col("expected_share")) * F.ln(F.col("actual_share") / F.col("expected_share"))
    return shares.withColumn("part", part)


def top_risk(scores: DataFrame, k: int, score: str = "churn_probability", key: str = fv.ID) -> DataFrame:
    """The ``k`` customers most at risk."""
    return scores.orderBy(F.desc(score), F.asc(key)).limit(k)
