from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions import numbers, text, vectors


def test_numbers_from_text(spark):
    given = ["1", "2.5", " ", "", None, "10", "nan", "1,000", "$5", "1_000", "0x10", "1.0d", " 7 ", "1e3", "+3", ".5"]
    want = [1.0, 2.5, None, None, None, 10.0, None, None, None, None, None, None, 7.0, 1000.0, 3.0, 0.5]
    df = spark.createDataFrame([(v,) for v in given], "v string").coalesce(1)
    assert [r[0] for r in df.select(numbers.to_number(F.col("v"))).collect()] == want
    assert math.isinf(spark.sql("select 'inf' v").select(numbers.to_number(F.col("v"))).first()[0])


def test_rounding_equals_python(spark):
    random.seed(3)
    values = [0.125, 2.675, 1.005, 0.005, 0.015, 1.5e-6, 5e-7, 0.1234565, -2.675, 0.9999995, 1e15, 123456.785, 0.0, 8589934593.1234567]
    values += [random.random() for _ in range(2000)]
    values += [(random.randint(0, 10**6) + 0.5) / 10 ** random.randint(0, 7) for _ in range(2000)]
    values += [random.randint(0, 10**9) / 2 ** random.randint(0, 40) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    c = F.col("v")
    rows = df.select("v", numbers.round_exact(c, 6), numbers.round_exact(c, 4), numbers.money_text(c)).collect()
    for v, six, four, money in rows:
        assert (six, four, money) == (round(v, 6), round(v, 4), f"{v:.2f}")


def test_missing_stays_missing_when_rounded(spark):
    row = spark.sql("select cast(null as double) v").select(numbers.round_exact(F.col("v"), 4), numbers.money_text(F.col("v"))).first()
    assert tuple(row) == (None, None)


def notes_of(df):
    return [tuple(r) for r in df.select(text.rule_note(text.charges_text()), text.rule_tag()).collect()]


def test_rules_take_the_first_match(make_customers):
    loyal = {"Contract": "Two year", "OnlineSecurity": "Yes"}
    fresh = {"tenure": 3, "Contract": "One year", "OnlineSecurity": "Yes"}
    rows = make_customers(
        {},
        {"TechSupport": "Yes"},
        {"TechSupport": "Yes", "MonthlyCharges": 70.0, "tenure": 20},
        loyal,
        fresh,
        {**fresh, "tenure": 7},
    ).coalesce(1)
    got = notes_of(rows)
    assert [t for _, t in got] == ["Frustrated", "Billing Inquiry", "Technical Issue", "Satisfied", "Neutral", "Neutral"]
    assert got[0][0].startswith("Cust C-0001 contacted") and "$91.25 were flagged" in got[0][0]
    assert got[4][0].startswith("New customer (3 months)")
    assert got[5][0].startswith("Cust with 7 months tenure on a One year contract")


def test_profile_lists_every_field(make_customers):
    profile = make_customers({"SeniorCitizen": 1}).select(text.profile_text(text.charges_text())).first()[0]
    assert profile.startswith("\nCustomer CRM Profile:\n- Customer ID     : C-0001\n")
    assert "- Senior Citizen  : Yes\n" in profile and "- Monthly Charges : $91.25\n" in profile
    assert "Churn" not in profile and profile.endswith("for this customer.\n")


GOOD = '{"ticket_note": "n", "primary_sentiment_tag": "Neutral"}'


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (GOOD, ("n", "Neutral")),
        (f"```json\n{GOOD}\n```", ("n", "Neutral")),
        (f"  ```{GOOD}```  ", ("n", "Neutral")),
        ('{"ticket_note": "n", "primary_sentiment_tag": [" Satisfied ", "x"]}', ("n", "Satisfied")),
        ('{"ticket_note": "n", "primary_sentiment_tag": " Frustrated "}', ("n", "Frustrated")),
        ('{"ticket_note": "n", "primary_sentiment_tag": []}', None),
        ('{"ticket_note": "n", "primary_sentiment_tag": "Happy"}', None),
        ('{"ticket_note": "", "primary_sentiment_tag": "Neutral"}', None),
        ('{"ticket_note": 5, "primary_sentiment_tag": "Neutral"}', None),
        ('{"primary_sentiment_tag": "Neutral"}', None),
        (GOOD[:-1], None),
        (GOOD + "{", None),
        (GOOD + "]", None),
        (GOOD + "}", None),
        (GOOD + ", 1", None),
        ("no json", None),
        ("", None),
        (None, None),
    ],
)
def test_replies_are_healed_or_refused(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(text.parse_reply(F.col("raw")).alias("r")).first()["r"]
    assert (None if got is None else tuple(got)) == want


def test_labels_and_titles(spark):
    row = spark.sql("select 'expect_x' e, cast(null as string) c, 'late_fusion_stacked' r").select(
        text.failure_label(F.col("e"), F.col("c")), text.run_title(F.col("r")), text.category_or_unknown(F.col("c")), text.text_or_empty(F.col("c"))
    )
    assert tuple(row.first()) == ("expect_x on 'table'", "Late Fusion Stacked", "Unknown", "")


def test_dense_forms(spark):
    df = spark.createDataFrame([(1.0, 2.0, [1.0, 0.0])], "a double, b double, x array<double>").withColumn("v", vectors.as_vector(F.array("a", "b")))
    row = df.select(vectors.dense_array(df, "v"), vectors.dense_array(df, "x"), vectors.dense_array(df, "a"), vectors.zero_array(3)).first()
    assert [list(c) for c in row] == [[1.0, 2.0], [1.0, 0.0], [1.0], [0.0, 0.0, 0.0]]
    assert np.isclose(fv.DECISION_THRESHOLD, 0.5)


def test_money_of_any_double(spark):
    values = [0.0, -0.005, 2.675, 1e17, -1e17, 2.0**61, 4.5e15 + 0.5, float("nan"), float("inf"), float("-inf"), 123456789012.345]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [r[0] for r in df.select(numbers.money_text(F.col("v"))).collect()]
    assert got == [f"{v:.2f}" for v in values]
