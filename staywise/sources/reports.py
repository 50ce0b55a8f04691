"""Report tables: dataset validation, model evaluation, multicollinearity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import round_exact
from staywise.functions.text import run_title
from staywise.sources.landing import path_exists

_METRICS = "struct<recall: double, precision: double, f1: double, roc_auc: double>"
_RUN = f"struct<run_id: string, metrics: {_METRICS}>"
_FUSION = f"struct<run_id: string, metrics: {_METRICS}, recall_lift: double, f1_lift: double>"
EVALUATION_SCHEMA = (
    f"structured_baseline {_RUN}, nlp_baseline {_RUN}, late_fusion_stacked {_FUSION}, meta map<string, string>"
)


def nest_evaluation(metrics: DataFrame, run_id: str, meta: dict[str, str]) -> DataFrame:
    """One row per run (run, metrics, lifts) to the single nested report row."""
    values = F.struct(*[F.col(m) for m in fv.RUN_METRICS])
    baseline = F.struct(F.lit(run_id).alias("run_id"), values.alias("metrics"))
    fusion = F.struct(F.lit(run_id).alias("run_id"), values.alias("metrics"), "recall_lift", "f1_lift")
    picks = [
        F.max(F.when(F.col("run") == name, fusion if name == "late_fusion_stacked" else baseline)).alias(name)
        for name in fv.RUN_ORDER
    ]
    pairs = [F.lit(part) for item in meta.items() for part in item]
    return metrics.agg(*picks).withColumn("meta", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))


def write_evaluation(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The comparison table of a written report; an absent file gives a one-row error table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([("evaluation report not found",)], "Error string")
    return compare_runs(spark.read.schema(EVALUATION_SCHEMA).option("multiLine", "true").json(path))


def compare_runs(report: DataFrame) -> DataFrame:
    """Nested report to one row per run, in fixed order; absent runs are skipped."""
    rows = []
    for position, name in enumerate(fv.RUN_ORDER):
        run = F.col(name)
        lift = name == "late_fusion_stacked"

        def number(c, default=0.0):
            return round_exact(F.coalesce(c, F.lit(default)), fv.DISPLAY_DIGITS)

        rows.append(
            F.when(
                run.isNotNull(),
                F.struct(
                    F.lit(position).cast("long").alias("position"),
                    run_title(F.lit(name)).alias("Model Architecture"),
                    number(run["metrics"]["recall"]).alias("Recall"),
                    number(run["metrics"]["precision"]).alias("Precision"),
                    number(run["metrics"]["f1"]).alias("F1 Score"),
                    number(run["metrics"]["roc_auc"]).alias("ROC AUC"),
                    (number(run["recall_lift"]) if lift else F.lit(None).cast("double")).alias("Recall Lift vs Baseline"),
                    (number(run["f1_lift"]) if lift else F.lit(None).cast("double")).alias("F1 Lift vs Baseline"),
                ),
            )
        )
    return report.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def write_validation(report: DataFrame, status: str, dataset_id: str, root: str, with_report: bool) -> None:
    """Append a status marker, and the report rows when the gate passed."""
    spark = report.sparkSession
    marker = spark.createDataFrame([(dataset_id, status)], "dataset string, status string")
    marker.coalesce(1).write.mode("append").json(f"{root}/status")
    if with_report:
        report.withColumn("dataset", F.lit(dataset_id)).coalesce(1).write.mode("append").json(f"{root}/report")


def write_vif(vif: DataFrame, path: str) -> None:
    vif.orderBy(F.desc("VIF")).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
