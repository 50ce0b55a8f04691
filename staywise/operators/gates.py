"""Dataset gates: a suite of expectations checked in one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.numbers import cell
from staywise.functions.text import failure_label

REPORT_SCHEMA = (
    "position bigint, suite string, expectation string, column string, success boolean, element_count bigint, "
    "unexpected_count bigint, unexpected_fraction double, threshold double"
)


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    mostly: float = 1.0

    def broken(self, c: Column) -> Column:
        """True, false, or NULL where the cell ``c`` is not judged."""
        if self.kind == "expect_column_values_to_be_between":
            return self._outside(c)
        if self.kind == "expect_column_value_lengths_to_be_between":
            return self._outside(F.length(c))
        if self.kind == "expect_column_values_to_be_in_set":
            return ~c.isin(list(self.values))
        if self.kind == "expect_column_values_to_not_be_null":
            return c.isNull()
        raise ValueError(f"unknown expectation {self.kind}")

    def _outside(self, c: Column) -> Column:
        tests = [c < self.low] if self.low is not None else []
        tests += [c > self.high] if self.high is not None else []
        outside = tests[0]
        for test in tests[1:]:
            outside = outside | test
        return outside


@dataclass(frozen=True)
class Suite:
    name: str
    expectations: tuple[Expectation, ...] = field(default_factory=tuple)


class GateViolation(Exception):
    """A dataset broke its suite. Carries what a report needs."""

    def __init__(self, dataset_id: str, stage: str, suite: str, failures: list[str], failed: int, rows: int) -> None:
        super().__init__(fv.GATE_BROKEN.format(dataset_id, failed))
        self.dataset_id = dataset_id
        self.pipeline_stage = stage
        self.expectation = fv.GATE_EXPECTED.format(suite)
        self.actual_value = failures
        self.row_count_affected = rows


class SuiteRegistry:
    """A suite registered under a name is returned unchanged when asked for again."""

    def __init__(self) -> None:
        self._suites: dict[str, Suite] = {}

    def raw(self, name: str = "raw_customer_suite", schema: dict[str, str] | None = None) -> Suite:
        return self._suites.setdefault(name, raw_suite(name, schema))

    def enriched(self, name: str = "enriched_customer_suite", schema: dict[str, str] | None = None) -> Suite:
        return self._suites.setdefault(name, enriched_suite(name, schema))


def raw_suite(name: str = "raw_customer_suite", schema: dict[str, str] | None = None) -> Suite:
    columns = tuple(schema) if schema else tuple(fv.GATE_FALLBACK_COLUMNS)
    return Suite(
        name,
        (
            Expectation("expect_table_columns_to_match_set", values=columns),
            Expectation("expect_column_values_to_be_between", "tenure", low=0, high=120),
            Expectation("expect_column_values_to_be_in_set", "InternetService", values=tuple(fv.INTERNET_SERVICES)),
            Expectation("expect_column_values_to_be_in_set", "Contract", values=tuple(fv.CONTRACTS)),
            Expectation("expect_column_values_to_be_in_set", "Churn", values=tuple(fv.YES_NO)),
        ),
    )


def enriched_suite(name: str = "enriched_customer_suite", schema: dict[str, str] | None = None) -> Suite:
    presence = (Expectation("expect_table_columns_to_match_set", values=tuple(schema)),) if schema else ()
    return Suite(
        name,
        presence
        + (
            Expectation("expect_column_values_to_not_be_null", fv.NOTE, mostly=0.95),
            Expectation("expect_column_value_lengths_to_be_between", fv.NOTE, low=10, mostly=0.9),
            Expectation(
                "expect_column_values_to_be_in_set", fv.TAG, values=tuple(fv.SENTIMENT_TAGS), mostly=0.95
            ),
        ),
    )


def gate_report(df: DataFrame, suite: Suite) -> DataFrame:
    """One row per expectation, from a single aggregate over ``df``."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, e in enumerate(suite.expectations):
        if e.column in df.columns:
            value = cell(df, e.column)
            judged = F.lit(True) if e.kind.endswith("not_be_null") else value.isNotNull()
            aggregates += [F.count_if(judged).alias(f"judged_{i}"), F.count_if(judged & e.broken(value)).alias(f"broken_{i}")]
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    rows = []
    for i, e in enumerate(suite.expectations):
        if e.column is None:
            success = F.lit(set(e.values) <= set(df.columns))
            count, unexpected, fraction = none_long, none_long, none_double
        elif e.column not in df.columns:
            success, count, unexpected, fraction = F.lit(False), none_long, none_long, none_double
        else:
            judged, broken = F.col(f"judged_{i}"), F.col(f"broken_{i}")
            fraction = F.coalesce(F.try_divide(broken.cast("double"), judged.cast("double")), F.lit(0.0))
            kept = F.coalesce(F.try_divide((judged - broken).cast("double"), judged.cast("double")), F.lit(1.0))
            success, count, unexpected = kept >= F.lit(e.mostly), F.col("n"), broken
        rows.append(
            F.struct(
                F.lit(i).cast("long").alias("position"),
                F.lit(suite.name).alias("suite"),
                F.lit(e.kind).alias("expectation"),
                F.lit(e.column).cast("string").alias("column"),
                success.alias("success"),
                count.alias("element_count"),
                unexpected.alias("unexpected_count"),
                fraction.alias("unexpected_fraction"),
                F.lit(float(e.mostly)).alias("threshold"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def failure_labels(report: DataFrame, keep: int = 5) -> DataFrame:
    """One row: the number of failed expectations and the first labels in suite order."""
    failed = F.when(~F.col("success"), F.struct("position", failure_label(F.col("expectation"), F.col("column")).alias("label")))
    return report.agg(
        F.count_if(~F.col("success")).alias("failed"),
        F.transform(F.slice(F.sort_array(F.collect_list(failed)), 1, keep), lambda r: r["label"]).alias("first_failures"),
    )


def run_gate(df: DataFrame, suite: Suite, dataset_id: str, stage: str) -> DataFrame:
    """The report of a passing gate; a failing one raises ``GateViolation``."""
    # One row per expectation: the suite bounds what reaches the driver.
    counted = gate_report(df, suite)
    rows: list[Row] = sorted(counted.collect(), key=lambda r: r["position"])
    failed = [r for r in rows if not r["success"]]
    if failed:
        labels = [f"{r['expectation']} on '{r['column'] or 'table'}'" for r in failed[:5]]
        counts = [r["element_count"] for r in rows if r["element_count"] is not None]
        total = counts[0] if counts else df.count()
        raise GateViolation(dataset_id, stage, suite.name, labels, len(failed), total)
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
