"""Training, evaluation, scoring and attribution of the stacked model.

The registered queries train on the whole derived customer table within ``BUDGET``, which
spends the ``QUERY_*`` parameters; ``TrainingPlan()`` is the full plan.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.catalog.data_checks import enriched
from staywise.catalog.registry import query
from staywise.catalog.sql_views import CUSTOMERS, ENRICHED
from staywise.operators import attribution
from staywise.operators.clean import display_scores
from staywise.operators.contracts import EVALUATION_ROW, SCORE_RESPONSE, with_errors
from staywise.plans.evaluation import evaluate
from staywise.plans.feature_build import FeatureBuild, build_features
from staywise.plans.scoring import Scorer, batch_totals, embed
from staywise.plans.training import (
    StackedModel,
    TrainingPlan,
    TreeSettings,
    balanced,
    draw_settings,
    fit_meta,
    out_of_fold,
    score_branch,
    search,
    train_stacked,
    training_rows,
)
from staywise.session import new_folder, written
from staywise.sources.landing import path_stamp
from staywise.streaming.jobs import score_stream



def _trials(trials: int) -> tuple[TreeSettings, ...]:
    """The full plan's draws, with no more trees than a query may spend on one model."""
    return tuple(replace(s, trees=min(s.trees, fv.QUERY_MOST_TREES)) for s in draw_settings(trials, fv.SEED))


BUDGET = TrainingPlan(
    folds=fv.QUERY_FOLDS,
    oof=TreeSettings(trees=fv.QUERY_TREES, depth=fv.QUERY_DEPTH),
    structured_candidates=_trials(fv.STRUCTURED_TRIALS),
    text_candidates=_trials(fv.TEXT_TRIALS),
)

_ENRICHED: dict[tuple, DataFrame] = {}
_BUILDS: dict[tuple, FeatureBuild] = {}
_MODELS: dict[tuple, StackedModel] = {}


def _key(spark, sf) -> tuple:
    """This session and the state of the tables that the customer table derives from."""
    stamps = [path_stamp(spark, f"{sf}/{name}.parquet") for name in ("customer", "documents", "labels")]
    return (spark.sparkContext.applicationId, sf, *stamps)


def enriched_table(spark, sf):
    """The enriched table as the enrichment job leaves it, written once per session and folder."""
    key = _key(spark, sf)
    if key not in _ENRICHED:
        _ENRICHED[key] = written(enriched(spark, sf), "enriched")
    return _ENRICHED[key]


def built(spark, sf) -> FeatureBuild:
    """The feature build of this session and folder, fitted once."""
    key = _key(spark, sf)
    if key not in _BUILDS:
        build = build_features(enriched_table(spark, sf))
        _BUILDS[key] = FeatureBuild(written(build.rows, "feature-rows", ["split"]), build.structured, build.text)
    return _BUILDS[key]


def trained(spark, sf) -> StackedModel:
    key = _key(spark, sf)
    if key not in _MODELS:
        path = new_folder(spark, "models")
        train_stacked(built(spark, sf).rows, BUDGET).save(path)
        _MODELS[key] = StackedModel.load(path)
    return _MODELS[key]


def scorer(spark, sf) -> Scorer:
    build = built(spark, sf)
    return Scorer(build.structured, build.text, trained(spark, sf), version="stacked-1")


@query("oof_scores")
def oof_scores(spark, sf):
    return out_of_fold(training_rows(built(spark, sf).rows, "train"), BUDGET.folds, BUDGET.oof)


@query("meta_coefficients")
def meta_coefficients(spark, sf):
    meta = fit_meta(written(out_of_fold(training_rows(built(spark, sf).rows, "train"), BUDGET.folds, BUDGET.oof), "oof"))
    rows = [("p_struct", float(meta.coefficients[0])), ("p_nlp", float(meta.coefficients[1])), ("intercept", float(meta.intercept))]
    return spark.createDataFrame(rows, "term string, weight double")


@query("search_recall")
def search_recall(spark, sf):
    """Recall of every candidate on the untouched validation rows."""
    rows = built(spark, sf).rows
    train = training_rows(rows, "train")
    found = search(balanced(train, "structured", fv.SEED), training_rows(rows, "val"), "structured", BUDGET.candidates("structured"))
    tried = [(i, s.trees, given, s.depth, s.learning_rate, r, s == found.best) for i, (s, given, r) in enumerate(found.recalls)]
    return spark.createDataFrame(tried, "trial int, trees int, given int, depth int, learning_rate double, recall double, best boolean")


@query("late_fusion_report")
def late_fusion_report(spark, sf):
    metrics, _ = evaluate(built(spark, sf).rows, trained(spark, sf))
    return metrics


@query(
    "evaluation_row_errors",
    "SELECT unnest(['structured_baseline', 'nlp_baseline', 'late_fusion_stacked']) AS run, '' AS errors",
)
def evaluation_row_errors(spark, sf):
    """The report of the trained model keeps its own contract."""
    metrics, _ = evaluate(built(spark, sf).rows, trained(spark, sf))
    checked = with_errors(metrics, EVALUATION_ROW)
    return checked.select("run", F.array_join("errors", "; ").alias("errors"))


@query("late_fusion_confusion")
def late_fusion_confusion(spark, sf):
    _, confusion = evaluate(built(spark, sf).rows, trained(spark, sf))
    return confusion


@query("feature_importance")
def feature_importance(spark, sf):
    build = built(spark, sf)
    return attribution.top_importances(trained(spark, sf).structured, build.rows, build.structured.names())


@query("score_batch")
def score_batch(spark, sf):
    return scorer(spark, sf).score(enriched_table(spark, sf))


@query("score_table")
def score_table(spark, sf):
    return display_scores(scorer(spark, sf).score(enriched_table(spark, sf)))


@query("score_totals", CUSTOMERS + "SELECT count(*) AS total, true AS nlp_branch_available FROM v")
def score_totals(spark, sf):
    return batch_totals(scorer(spark, sf).score(enriched_table(spark, sf)))


@query(
    "score_degraded",
    ENRICHED + "SELECT customerID, false AS nlp_branch_available, CAST(1 AS BIGINT) AS p_nlp_values, true AS valid FROM e",
)
def score_degraded(spark, sf):
    """Without the text branch every row carries the one score its model gives the zero vector."""
    scores = written(scorer(spark, sf).score(enriched_table(spark, sf), text_branch=False), "degraded")
    distinct = scores.agg(F.count_distinct("p_nlp")).first()[0]
    checked = with_errors(scores, SCORE_RESPONSE)
    return checked.select(
        fv.ID, "nlp_branch_available", F.lit(distinct).cast("long").alias("p_nlp_values"), (F.size("errors") == 0).alias("valid")
    )


@query(
    "score_valid",
    ENRICHED + "SELECT customerID, true AS nlp_branch_available, true AS valid, 'stacked-1' AS model_version FROM e",
)
def score_valid(spark, sf):
    """Every request gets a score that keeps the response contract."""
    checked = with_errors(scorer(spark, sf).score(enriched_table(spark, sf)), SCORE_RESPONSE)
    return checked.select(fv.ID, "nlp_branch_available", (F.size("errors") == 0).alias("valid"), "model_version")


@query(
    "embedding_job",
    ENRICHED + "SELECT customerID, CAST(20 AS BIGINT) AS dim, CAST(20 AS BIGINT) AS length, 'hashing-pca20' AS model_version FROM e",
)
def embedding_job(spark, sf):
    vectors = embed(built(spark, sf).text, enriched_table(spark, sf), [fv.ID], version="hashing-pca20")
    return vectors.select(fv.ID, "dim", F.size("embedding").cast("long").alias("length"), "model_version")


@query("attribution")
def attributed(spark, sf):
    """The five strongest structured features behind every customer's score."""
    build = built(spark, sf)
    rows = build.rows.select(fv.ID, "structured")
    explained = attribution.attribute(rows, trained(spark, sf).structured, build.structured.names(), "structured", [fv.ID])
    return explained.select(
        fv.ID, "base", "margin", attribution.top_contributions(F.col("contributions"), 5).alias("top")
    )


@query("attribution_adds_up", CUSTOMERS + "SELECT customerID, true AS adds_up FROM v")
def attribution_adds_up(spark, sf):
    """Contributions plus base give the margin the model itself computes."""
    build, model = built(spark, sf), trained(spark, sf)
    rows = score_branch(build.rows.select(fv.ID, "structured"), model.structured, "structured", "p")
    explained = attribution.attribute(rows, model.structured, build.structured.names(), "structured", [fv.ID, "p"])
    expected = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return explained.select(fv.ID, (F.abs(expected - F.col("p")) < 1e-9).alias("adds_up"))


@query("meta_attribution")
def meta_attribution(spark, sf):
    """How far each branch moved the stacked score, in log odds."""
    service = scorer(spark, sf)
    rows = written(service.probabilities(enriched_table(spark, sf)).select(fv.ID, "p_struct", "p_nlp"), "branch-scores")
    means = rows.agg(F.avg("p_struct"), F.avg("p_nlp")).first()
    return rows.select(fv.ID, *attribution.linear_contributions(service.model.meta, list(means), ["p_struct", "p_nlp"]))


@query(
    "stream_scoring",
    ENRICHED + "SELECT customerID, true AS same FROM e",
)
def stream_scoring(spark, sf):
    """Scores of the stream next to scores of the batch, row by row."""
    service = scorer(spark, sf)
    source, output, checkpoint = (new_folder(spark, n) for n in ("score-requests", "scored", "progress"))
    enriched_table(spark, sf).write.parquet(source)
    arriving = spark.read.parquet(source)
    requests = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 4).parquet(source)
    score_stream(requests, service, output, checkpoint).awaitTermination()
    columns = ["churn_probability", "churn_prediction", "p_structured", "p_nlp", "nlp_branch_available", "model_version"]
    streamed = spark.read.parquet(f"{output}/scores").select(fv.ID, F.struct(*columns).alias("streamed"))
    batch = service.score(arriving).select(fv.ID, F.struct(*columns).alias("scored"))
    both = batch.join(streamed, fv.ID, "full")
    return both.select(fv.ID, F.col("streamed").eqNullSafe(F.col("scored")).alias("same"))
