from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators import clean, contracts, gates


def errors_of(df, contract):
    return [r["errors"] for r in contracts.with_errors(df, contract).collect()]


def test_customer_rows(make_customers):
    bad = {"SeniorCitizen": 5, "tenure": -1, "MonthlyCharges": -10.0}
    rows = make_customers({}, bad, {"TotalCharges": None}, {"gender": None}, {"MonthlyCharges": float("nan")}).coalesce(1)
    got = errors_of(rows, contracts.CUSTOMER_ROW)
    verdicts = [r[0] for r in rows.select(contracts.keeps(rows, contracts.CUSTOMER_ROW)).collect()]
    assert verdicts == [e == [] for e in got]
    assert got[0] == [] and got[2] == []
    assert got[1] == ["SeniorCitizen: outside 0..1", "tenure: outside 0..", "MonthlyCharges: outside 0.."]
    assert got[3] == ["gender: missing"]
    assert got[4] == ["MonthlyCharges: outside 0.."]


def test_split_into_accepted_and_quarantined(make_customers):
    checked = contracts.with_errors(make_customers({}, {"tenure": -1}), contracts.CUSTOMER_ROW)
    assert contracts.accepted(checked).count() == 1 and contracts.quarantined(checked).count() == 1
    assert "errors" not in contracts.accepted(checked).columns


def test_enrichment_input_ignores_the_label(make_customers):
    rows = clean.enrichment_inputs(make_customers({}, {"Contract": "Weekly"}, {"TechSupport": None}, {"gender": None})).coalesce(1)
    got = errors_of(rows, contracts.ENRICHMENT_INPUT)
    assert got[0] == [] and got[1] == ["Contract: not an allowed value"]
    assert got[2] == ["TechSupport: not an allowed value"]
    assert got[3] == []
    assert fv.TARGET not in contracts.ENRICHMENT_INPUT.required


def test_absent_column_is_named(make_customers):
    got = errors_of(make_customers({}).drop("tenure"), contracts.CUSTOMER_ROW)
    assert got == [["tenure: missing"]]


def test_note_and_vector_and_report_rows(spark):
    notes = spark.createDataFrame([("x", "Neutral"), ("", "Neutral"), ("x", "Angry"), (None, None)], "ticket_note string, primary_sentiment_tag string").coalesce(1)
    assert [len(e) for e in errors_of(notes, contracts.NOTE_OUTPUT)] == [0, 1, 1, 2]
    vectors = spark.createDataFrame([([1.0], 1), ([1.0], 2), ([], 0)], "embedding array<double>, dim int").coalesce(1)
    assert [len(e) for e in errors_of(vectors, contracts.vector_contract())] == [0, 1, 1]
    runs = spark.createDataFrame(
        [("structured_baseline", 0.7, 0.5, 0.6, 0.8, None, None), ("late_fusion_stacked", 0.7, 0.5, 0.6, 1.8, 0.07, None)],
        "run string, recall double, precision double, f1 double, roc_auc double, recall_lift double, f1_lift double",
    ).coalesce(1)
    assert errors_of(runs, contracts.EVALUATION_ROW) == [[], ["roc_auc: outside 0..1", "f1_lift: missing"]]


def test_scored_table_check(spark):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "customerID string")
    assert tuple(contracts.scored_table_check(ids, ids).first()) == (3, 3, True)
    assert tuple(contracts.scored_table_check(ids, ids.limit(0)).first()) == (3, 0, False)


def gate_rows(spark, tenure=12, churn="No"):
    return spark.createDataFrame(
        [("a", tenure, "DSL", "One year", 50.0, "600", churn), ("b", 1, None, "Two year", 20.0, " ", "Yes")],
        "customerID string, tenure bigint, InternetService string, Contract string, MonthlyCharges double, TotalCharges string, Churn string",
    )


def test_gate_passes_and_fails(spark):
    report = gates.run_gate(gate_rows(spark), gates.raw_suite(), "customers", "ingestion")
    assert report.count() == 5 and report.where("not success").count() == 0
    with pytest.raises(gates.GateViolation, match="Dataset customers failed 2 expectations.") as caught:
        gates.run_gate(gate_rows(spark, 500, "Maybe"), gates.raw_suite(), "customers", "ingestion")
    error = caught.value
    assert error.actual_value == [
        "expect_column_values_to_be_between on 'tenure'",
        "expect_column_values_to_be_in_set on 'Churn'",
    ]
    assert error.row_count_affected == 2 and error.pipeline_stage == "ingestion"


def test_gate_names_a_missing_column(spark):
    report = gates.gate_report(gate_rows(spark).drop("Contract"), gates.raw_suite())
    assert [r["success"] for r in report.orderBy("position").collect()] == [False, True, True, False, True]


def test_tolerances(spark):
    note = F.when(F.col("id") < 95, "long enough note")
    df = spark.range(100).select(note.alias("ticket_note"), F.lit("Neutral").alias("primary_sentiment_tag"))
    assert gates.gate_report(df, gates.enriched_suite()).where("success").count() == 3
    df = spark.range(100).select(F.when(F.col("id") < 94, "short").alias("ticket_note"), F.lit("Odd").alias("primary_sentiment_tag"))
    assert gates.gate_report(df, gates.enriched_suite()).where("success").count() == 0


def test_gate_scans_once(spark):
    plan = gates.gate_report(gate_rows(spark), gates.raw_suite())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1


def test_a_registered_suite_is_returned_unchanged():
    registry = gates.SuiteRegistry()
    first = registry.raw("s", {"a": "str"})
    assert registry.raw("s", {"b": "str"}) is first and registry.enriched("t") is registry.enriched("t")


def test_an_absent_column_silences_only_its_own_rules(make_customers):
    got = errors_of(make_customers({"MonthlyCharges": -1.0, "SeniorCitizen": 7}).drop("tenure"), contracts.CUSTOMER_ROW)
    assert got == [["tenure: missing", "SeniorCitizen: outside 0..1", "MonthlyCharges: outside 0.."]]


def test_nan_is_missing_in_gates_and_counts(spark):
    from staywise.operators.explore import missing_counts

    nan = float("nan")
    df = spark.createDataFrame([(1.0, "x"), (nan, None), (None, "nan"), (500.0, "y")], "tenure double, note string")
    suite = gates.Suite(
        "s",
        (
            gates.Expectation("expect_column_values_to_be_between", "tenure", low=0, high=120),
            gates.Expectation("expect_column_values_to_not_be_null", "tenure", mostly=0.5),
        ),
    )
    ranged, present = sorted(gates.gate_report(df, suite).collect(), key=lambda r: r["position"])
    assert (ranged["unexpected_count"], ranged["unexpected_fraction"]) == (1, 0.5)
    assert (present["unexpected_count"], present["success"]) == (2, True)
    assert {r["column"]: r["missing"] for r in missing_counts(df).collect()} == {"tenure": 2, "note": 1}
