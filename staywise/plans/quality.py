"""Gate a dataset and leave a status marker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staywise.operators.gates import GateViolation, Suite, run_gate
from staywise.sources.landing import path_exists
from staywise.sources.reports import write_validation


def gate_table(spark: SparkSession, path: str, suite: Suite, dataset_id: str, stage: str, root: str) -> DataFrame | None:
    """Gate the Parquet table at ``path``.

    Passing writes status and report; failing writes the status and raises; a
    missing input writes nothing and returns None.
    """
    if not path_exists(spark, path):
        return None
    table = spark.read.parquet(path)
    try:
        report = run_gate(table, suite, dataset_id, stage)
    except GateViolation:
        write_validation(table.limit(0), "FAIL", dataset_id, root, with_report=False)
        raise
    write_validation(report, "PASS", dataset_id, root, with_report=True)
    return report
