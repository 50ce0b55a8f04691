from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators import clean, resume, tags
from staywise.plans.enrichment import enrich, generate_notes

# Workers cannot import test modules, so their functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def finished(spark, rows):
    return spark.createDataFrame(rows, "customerID string, ticket_note string, primary_sentiment_tag string")


def by_id(df):
    return {r[fv.ID]: (r[fv.NOTE], r[fv.TAG]) for r in df.collect()}


def test_only_pending_rows_are_processed(spark, make_customers):
    raw = make_customers({"customerID": "C1"}, {"customerID": "C2"}, {"customerID": "C3"})
    done = finished(spark, [("C1", "kept one", "Neutral"), ("C3", "kept three", "Satisfied")])
    assert [r[0] for r in resume.pending_rows(raw, done).select(fv.ID).collect()] == ["C2"]
    result = enrich(raw, done)
    assert by_id(result)["C1"] == ("kept one", "Neutral") and by_id(result)["C3"] == ("kept three", "Satisfied")
    assert by_id(result)["C2"][1] == "Frustrated"
    assert [r[0] for r in result.where("source is not null").select(fv.ID).collect()] == ["C2"]
    assert by_id(enrich(raw, result.drop("source"))) == by_id(result)


def test_a_match_overrides_even_with_null(spark, make_customers):
    raw = make_customers({"customerID": "C1"}).withColumns({fv.NOTE: F.lit("old"), fv.TAG: F.lit("Neutral")})
    joined = resume.with_finished(raw, finished(spark, [("C1", "half done", None)]))
    assert by_id(joined)["C1"] == ("half done", None)
    assert resume.progress(joined).first().asDict() == {"total": 1, "processed": 0, "pending": 1}


def test_numeric_ids_match_as_text(spark, make_customers):
    done = spark.createDataFrame([(7, "n", "Neutral")], "customerID bigint, ticket_note string, primary_sentiment_tag string")
    assert by_id(resume.with_finished(make_customers({"customerID": "7"}), done))["7"] == ("n", "Neutral")


def test_duplicate_finished_ids_are_refused(spark, make_customers):
    done = finished(spark, [("C1", "a", "Neutral"), ("C1", "b", "Neutral")])
    with pytest.raises(resume.DuplicateIds):
        enrich(make_customers({"customerID": "C1"}), done)


def test_write_back_fills_only_pending_rows(spark, make_customers):
    table = resume.with_finished(
        make_customers({"customerID": "C1"}, {"customerID": "C2"}, {"customerID": "C3"}), finished(spark, [("C1", "a", "Neutral")])
    )
    merged = resume.write_back(table, finished(spark, [("C1", "new", "Satisfied"), ("C2", "two", "Satisfied")]))
    assert by_id(merged) == {"C1": ("a", "Neutral"), "C2": ("two", "Satisfied"), "C3": (None, None)}


def test_invalid_rows_stay_pending(make_customers):
    raw = make_customers({"customerID": "ok"}, {"customerID": "bad", "Contract": "Weekly"}, {"customerID": "gap", "tenure": None})
    got = by_id(enrich(raw))
    assert got["ok"][0] and got["bad"] == (None, None) and got["gap"] == (None, None)


def test_absent_columns_take_defaults(spark):
    got = enrich(spark.createDataFrame([("x", 30)], "customerID string, tenure bigint")).first()
    assert got[fv.TAG] == "Neutral" and got[fv.NOTE].startswith("Cust with 30 months tenure on a Month-to-month contract")
    assert set(got.asDict()) == {"customerID", "tenure", fv.NOTE, fv.TAG, "source"}


def test_limit_takes_the_first_rows(make_customers):
    raw = make_customers(*[{"customerID": f"C{i}"} for i in range(15)])
    assert enrich(raw, limit=5).count() == 5
    assert enrich(raw, limit=0).count() == enrich(raw).count() == 15


def replies(answers):
    def factory():
        return lambda profiles: [answers.get(p.split("Customer ID     : ")[1].split("\n")[0]) for p in profiles]

    return factory


def broken():
    raise TimeoutError("down")


GOOD = '{"ticket_note": "%s", "primary_sentiment_tag": ["Satisfied"]}'


def test_tiers_in_order(make_customers):
    rows = make_customers({"customerID": "A"}, {"customerID": "B"}, {"customerID": "C"})
    first = replies({"A": GOOD % "from first", "B": "nonsense"})
    second = replies({"A": GOOD % "not used", "B": "```json\n" + GOOD % "from second" + "\n```"})
    done = {r[fv.ID]: (r["source"], r["new_note"]) for r in generate_notes(rows, F.lit(True), first, second).collect()}
    assert done["A"] == ("primary", "from first") and done["B"] == ("secondary", "from second")
    assert done["C"][0] == "rules" and done["C"][1].startswith("Cust C contacted")
    down = generate_notes(rows, F.lit(True), broken, broken).select("source").distinct().collect()
    assert [r[0] for r in down] == ["rules"]


def test_generator_sees_only_pending_rows(spark, make_customers):
    raw = make_customers({"customerID": "A"}, {"customerID": "B"})

    def factory():
        def answer(profiles):
            assert all("Customer ID     : A" not in p for p in profiles)
            return [GOOD % "asked" for _ in profiles]

        return answer

    got = by_id(enrich(raw, finished(spark, [("A", "done", "Neutral")]), primary=factory))
    assert got == {"A": ("done", "Neutral"), "B": ("asked", "Satisfied")}


def test_cleaning_and_mapping(make_customers):
    rows = make_customers({"OnlineBackup": "No internet service", "MultipleLines": "No phone service", "Partner": "maybe"})
    mapped = clean.map_binaries(clean.collapse_redundant(rows)).first()
    assert (mapped["OnlineBackup"], mapped["MultipleLines"], mapped["Partner"], mapped["gender"], mapped["Churn"]) == (0, 0, None, 1, 0)
    assert clean.drop_missing(clean.coerce_numbers(make_customers({}, {"TotalCharges": " "}), ["TotalCharges"])).count() == 1


def test_model_inputs_leave_out_what_leaks(make_customers):
    table = make_customers({}).withColumns({fv.NOTE: F.lit("n"), fv.TAG: F.lit("Neutral")})
    inputs = clean.model_inputs(table).columns
    assert not {fv.ID, fv.TARGET, fv.TAG} & set(inputs) and fv.NOTE in inputs and len(inputs) == 20


def test_scoring_projection_order(make_customers):
    row = clean.scoring_projection(make_customers({"TotalCharges": None}))
    assert row.columns == fv.SCORING_COLUMNS and len(row.columns) == 19 and row.first()["TotalCharges"] == ""


def test_leaking_tag_is_flagged(spark):
    rows = [("Frustrated", "Yes")] * 1838 + [("Frustrated", "No")] * 13 + [("Billing", "Yes")] * 30 + [("Billing", "No")] * 70
    df = spark.createDataFrame(rows, "primary_sentiment_tag string, Churn string")
    flags = {r[fv.TAG]: (r["n"], round(r["label_rate"], 3), r["leaks"]) for r in tags.leaking_tags(df).collect()}
    assert flags == {"Frustrated": (1851, 0.993, True), "Billing": (100, 0.3, False)}


def test_review_sample_and_diversity(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias(fv.ID), F.concat(F.lit("note "), F.col("id") % 100).alias(fv.NOTE))
    share = tags.review_sample(df).count() / 20000
    assert abs(share - 0.1) < 0.01
    assert tags.note_diversity(df, exact=True).first()["unique_notes"] == 100
    assert abs(tags.note_diversity(df).first()["unique_notes"] - 100) <= 5


def test_repeated_results_are_refused(spark, make_customers):
    raw = make_customers({"customerID": "a"}, {"customerID": "b"})
    once = spark.createDataFrame([("a", "note", "Neutral"), (None, "n", "Neutral"), (None, "n", "Neutral")], "customerID string, ticket_note string, primary_sentiment_tag string")
    assert resume.with_finished(raw, once).count() == 2
    twice = once.union(once)
    for call in (lambda: resume.with_finished(raw, twice), lambda: resume.write_back(resume.with_finished(raw, once), twice)):
        with pytest.raises(resume.DuplicateIds):
            call()
    assert [tuple(r) for r in resume.repeated_ids(twice).collect()] == [("a", 2)]
