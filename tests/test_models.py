from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators import attribution
from staywise.plans import evaluation, scoring, training
from staywise.plans.feature_build import build_features
from staywise.session import new_folder, written
from staywise.sources import reports
from staywise.streaming.jobs import enrich_stream, open_rows, retry_pending, score_stream
from test_features import sample_rows
from staywise.sources.schema import ENRICHED_SCHEMA

FAST = training.TreeSettings(trees=3, depth=3)
PLAN = training.TrainingPlan(folds=3, oof=FAST, structured_candidates=(FAST,), text_candidates=(FAST,))


@pytest.fixture(scope="module")
def enriched(spark):
    return written(spark.createDataFrame(sample_rows(200), ENRICHED_SCHEMA), "sample")


@pytest.fixture(scope="module")
def build(enriched):
    return build_features(enriched, components=4, width=64)


@pytest.fixture(scope="module")
def model(build):
    return training.train_stacked(build.rows, PLAN)


@pytest.fixture(scope="module")
def scorer(build, model):
    return scoring.Scorer(build.structured, build.text, model, version="v1")


def test_out_of_fold_scores_every_row_once(build):
    train = training.training_rows(build.rows, "train")
    oof = training.out_of_fold(train, 3, FAST).collect()
    assert sorted(r[fv.ID] for r in oof) == sorted(r[0] for r in train.select(fv.ID).collect())
    assert {r["fold"] for r in oof} == {0, 1, 2}
    assert all(0 <= r["p_struct"] <= 1 and 0 <= r["p_nlp"] <= 1 for r in oof)


def test_stacking_equals_a_newton_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.random((150, 2))
    y = (rng.random(150) < 1 / (1 + np.exp(-(3 * x[:, 0] + x[:, 1] - 2)))).astype(int)
    oof = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "label int, p_struct double, p_nlp double")
    meta = training.fit_meta(oof)
    a = np.column_stack([x, np.ones(150)])
    w = np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    np.testing.assert_allclose([*meta.coefficients, meta.intercept], w, atol=1e-4)


def test_search_keeps_the_best_recall(build):
    train, val = training.training_rows(build.rows, "train"), training.training_rows(build.rows, "val")
    candidates = [training.TreeSettings(trees=1, depth=1), FAST]
    found = training.search(train.select("label", F.col("structured").alias("features")), val, "structured", candidates)
    best = max(r for _, _, r in found.recalls)
    assert dict((c, r) for c, _, r in found.recalls)[found.best] == best


def test_draws_stay_in_the_space():
    drawn = training.draw_settings(30, 42)
    assert drawn == training.draw_settings(30, 42) and len(set(drawn)) == 30
    for s in drawn:
        assert 100 <= s.trees <= 600 and 3 <= s.depth <= 9 and 0.01 <= s.learning_rate <= 0.3
        assert 1e-8 <= s.l1 <= 1 and 1e-8 <= s.l2 <= 1
        assert 0.6 <= s.row_share <= 1 and 0.6 <= s.column_share <= 1 and 1 <= s.min_child <= 10
    assert len(training.TrainingPlan().candidates("structured")) == 30 and len(training.TrainingPlan().candidates("text")) == 20


def test_report(spark, build, model):
    metrics, confusion = evaluation.evaluate(build.rows, model)
    got = {r["run"]: r for r in metrics.collect()}
    assert set(got) == set(fv.RUN_ORDER)
    tested = build.rows.where("split = 'test'").count()
    assert all(r["tp"] + r["fn"] + r["fp"] + r["tn"] == tested for r in confusion.collect())
    fused, base = got["late_fusion_stacked"], got["structured_baseline"]
    assert fused["recall_lift"] == pytest.approx(fused["recall"] - base["recall"]) and base["f1_lift"] is None
    path = new_folder(spark, "report")
    reports.write_evaluation(reports.nest_evaluation(metrics, "r1", {"cv_folds": "3"}), path)
    table = reports.read_evaluation(spark, path).collect()
    assert [r["Model Architecture"] for r in table] == ["Structured Baseline", "Nlp Baseline", "Late Fusion Stacked"]
    assert table[0]["Recall Lift vs Baseline"] is None and table[2]["Recall"] == round(fused["recall"], 4)


def test_report_that_is_absent_or_partial(spark):
    assert reports.read_evaluation(spark, "/tmp/no-such-report").columns == ["Error"]
    path = new_folder(spark, "partial")
    spark.createDataFrame([('{"structured_baseline": {"run_id": "r", "metrics": {"recall": 0.12345}}}',)], "value string").write.text(path)
    row = reports.read_evaluation(spark, path).collect()
    assert len(row) == 1 and row[0]["Recall"] == 0.1235 and row[0]["F1 Score"] == 0.0


def test_scores(spark, enriched, scorer, tmp_path):
    rows = scorer.score(enriched).collect()
    assert len(rows) == 200 and list(rows[0].asDict()) == [
        "customerID", "churn_probability", "churn_prediction", "p_structured", "p_nlp", "nlp_branch_available", "model_version"
    ]
    for r in rows:
        assert 0 <= r["churn_probability"] <= 1 and r["model_version"] == "v1" and r["nlp_branch_available"]
        if abs(r["churn_probability"] - 0.5) > 1e-6:
            assert r["churn_prediction"] == (r["churn_probability"] >= 0.5)
    totals = scoring.batch_totals(scorer.score(enriched)).first()
    assert tuple(totals) == (200, True)
    scorer.model.save(str(tmp_path / "m"))
    loaded = scoring.Scorer(scorer.structured, scorer.text, training.StackedModel.load(str(tmp_path / "m")), "v1")
    assert sorted(loaded.score(enriched).collect()) == sorted(rows)


def test_degraded_scores_use_the_zero_vector(enriched, scorer):
    rows = scorer.score(enriched, text_branch=False).collect()
    assert {r["nlp_branch_available"] for r in rows} == {False} and len({r["p_nlp"] for r in rows}) == 1
    full = {r[fv.ID]: r["p_structured"] for r in scorer.score(enriched).collect()}
    assert {r[fv.ID]: r["p_structured"] for r in rows} == full
    assert tuple(scoring.batch_totals(scorer.score(enriched, text_branch=False)).first()) == (200, False)


def test_scoring_does_not_shuffle(enriched, scorer):
    assert "Exchange" not in scorer.score(enriched)._jdf.queryExecution().executedPlan().toString()


def test_embedding_job(enriched, scorer):
    rows = scoring.embed(scorer.text, enriched, [fv.ID], version="h-4").collect()
    assert all(r["dim"] == 4 == len(r["embedding"]) and r["model_version"] == "h-4" for r in rows)


def exact_shapley(x, leaves, width):
    """Shapley values from the definition, over all subsets of features."""

    def value(known):
        total = 0.0
        for leaf in leaves:
            weight = 1.0
            for f, low, high, kept in zip(leaf.features, leaf.low, leaf.high, leaf.kept):
                weight *= float(low < x[f] <= high) if f in known else kept
            total += leaf.value * weight
        return total

    used = sorted({f for leaf in leaves for f in leaf.features})
    phi = np.zeros(width)
    n = len(used)
    for f in used:
        rest = [g for g in used if g != f]
        for size in range(n):
            for known in combinations(rest, size):
                weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                phi[f] += weight * (value({*known, f}) - value(set(known)))
    return phi, value(set())


def test_contributions_are_shapley_values(build, model, spark):
    names = build.structured.names()
    leaves = model.structured.leaves()
    rows = build.rows.select(fv.ID, "structured").limit(8)
    explained = attribution.attribute(rows, model.structured, names, "structured", [fv.ID, "structured"]).collect()
    for r in explained:
        phi, base = exact_shapley(np.array(r["structured"]), leaves, len(names))
        got = {c["feature"]: c["value"] for c in r["contributions"]}
        np.testing.assert_allclose([got[n] for n in names], phi, atol=1e-9)
        assert r["base"] == pytest.approx(base) and r["margin"] == pytest.approx(phi.sum() + base)


def test_contributions_give_the_model_score(build, model):
    scored = training.score_branch(build.rows.select(fv.ID, "structured"), model.structured, "structured", "p")
    explained = attribution.attribute(scored, model.structured, build.structured.names(), "structured", [fv.ID, "p"])
    for r in explained.collect():
        assert 1 / (1 + np.exp(-r["margin"])) == pytest.approx(r["p"], abs=1e-9)


def test_strongest_features(spark, build, model):
    df = spark.createDataFrame([([("a", 0.1), ("b", -0.9), ("c", 0.5)],)], "c array<struct<feature: string, value: double>>")
    top = df.select(attribution.top_contributions(F.col("c"), 2).alias("t")).first()["t"]
    assert [tuple(t) for t in top] == [("b", -0.9), ("c", 0.5)]
    named = attribution.top_importances(model.structured, build.rows, build.structured.names())
    assert named.count() == min(20, len(build.structured.names()))
    assert attribution.top_importances(model.text, build.rows, None, 2).first()["feature"].startswith("feature_")


def test_streamed_scores_equal_batch_scores(spark, enriched, scorer):
    source, output, progress = (new_folder(spark, n) for n in ("requests", "scored", "progress"))
    bad = enriched.limit(3).withColumn("tenure", F.lit(-1).cast("long"))
    enriched.unionByName(bad).repartition(4).write.parquet(source)
    requests = spark.readStream.schema(enriched.schema).option("maxFilesPerTrigger", 1).parquet(source)
    score_stream(requests, scorer, output, progress).awaitTermination()
    streamed = spark.read.parquet(f"{output}/scores").drop("batch")
    assert sorted(streamed.collect()) == sorted(scorer.score(enriched).collect())
    assert spark.read.parquet(f"{output}/quarantine").count() == 3


def test_enrichment_stream_is_idempotent(spark, make_customers):
    source, output, progress = (new_folder(spark, n) for n in ("raw", "enriched", "progress"))
    rows = make_customers(*[{"customerID": f"C{i}", "tenure": i} for i in range(30)], {"customerID": "bad", "tenure": -1})
    rows.repartition(5).write.parquet(source)

    def run(checkpoint):
        requests = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
        enrich_stream(requests, output, checkpoint).awaitTermination()
        return spark.read.parquet(f"{output}/done")

    assert run(progress).count() == 30
    assert run(progress).count() == 30
    # A lost checkpoint replays every file; finished ids are not written again under another batch.
    again = run(new_folder(spark, "progress"))
    assert again.count() == 30 and again.select(fv.ID).distinct().count() == 30
    # What broke the contract is kept with its reason, and still is the only open row.
    left = open_rows(spark, output).collect()
    assert [(r[fv.ID], r["errors"]) for r in left] == [("bad", ["tenure: outside 0.."])]


def test_stream_keeps_every_record_of_an_id(spark, make_customers):
    output, source, progress = (new_folder(spark, n) for n in ("enriched", "raw", "progress"))
    same = [{"customerID": "a", "tenure": 5, "Churn": c} for c in ("Yes", "No")]
    rows = make_customers(*same, {"customerID": "a", "tenure": 9}, {"customerID": "a", "tenure": -1}, {"customerID": "a", "tenure": -2})
    rows.coalesce(1).write.parquet(source)

    def run(checkpoint):
        requests = spark.readStream.schema(rows.schema).parquet(source)
        enrich_stream(requests, output, checkpoint).awaitTermination()
        return sorted((r["tenure"], r["Churn"]) for r in spark.read.parquet(f"{output}/done").collect())

    first = run(progress)
    assert sorted(t for t, _ in first) == [5, 5, 9] and {c for t, c in first if t == 5} == {"Yes", "No"}
    assert sorted(r["tenure"] for r in open_rows(spark, output).collect()) == [-2, -1]
    # Another record of a finished id comes in a later batch; a replay of all files adds nothing more.
    make_customers({"customerID": "a", "tenure": 30}).write.mode("append").parquet(source)
    later = run(progress)
    assert sorted(t for t, _ in later) == [5, 5, 9, 30]
    assert run(new_folder(spark, "progress")) == later
    assert sorted(r["tenure"] for r in open_rows(spark, output).collect()) == [-2, -1]


def test_stream_asks_once_for_equal_inputs(spark, make_customers):
    output, source = new_folder(spark, "enriched"), new_folder(spark, "raw")
    rows = make_customers(*[{"customerID": "a", "tenure": 5, "Churn": c} for c in ("Yes", "No")])
    rows.repartition(2).write.parquet(source)

    def factory():
        import uuid

        return lambda texts: ['{"ticket_note": "%s", "primary_sentiment_tag": "%s"}' % (uuid.uuid4(), fv.SENTIMENT_TAGS[0]) for _ in texts]

    enrich_stream(spark.readStream.schema(rows.schema).parquet(source), output, new_folder(spark, "progress"), factory).awaitTermination()
    done = spark.read.parquet(f"{output}/done").collect()
    assert len(done) == 2 and len({r[fv.NOTE] for r in done}) == 1 and {r["source"] for r in done} == {"primary"}


def test_open_rows_are_tried_again(spark, make_customers):
    output = new_folder(spark, "enriched")
    rows = make_customers({"customerID": "a"}, {"customerID": "a"}, {"customerID": "b", "tenure": -1}, {"customerID": None})
    source = new_folder(spark, "raw")
    rows.write.parquet(source)

    def run():
        requests = spark.readStream.schema(rows.schema).parquet(source)
        enrich_stream(requests, output, new_folder(spark, "progress")).awaitTermination()

    run()
    assert sorted(str(r[fv.ID]) for r in spark.read.parquet(f"{output}/done").collect()) == ["None", "a"]
    # The row arrives mended in a later batch's pending folder; the next run takes it up.
    mended = open_rows(spark, output).drop("batch").withColumn("tenure", F.lit(4).cast("long"))
    mended.write.parquet(f"{output}/pending/batch=9")
    retry_pending(spark, output)
    assert open_rows(spark, output).count() == 0
    done = {str(r[fv.ID]): r["batch"] for r in spark.read.parquet(f"{output}/done").collect()}
    assert done["b"] == -1
