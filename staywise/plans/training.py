"""Training: oversampled branches, out-of-fold scores, search, stacking."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.vectors import as_vector
from staywise.operators.boosting import Settings, Trainer
from staywise.operators.clean import encode_target
from staywise.operators.oversample import smote
from staywise.operators.splits import stratified_folds
from staywise.operators.tree_model import TreeModel, matrix, probability
from staywise.session import ship_code, work_root, written

BRANCHES = ("structured", "text")


@dataclass(frozen=True)
class TreeSettings:
    """Settings of the boosted trees of one model."""

    trees: int = fv.OOF_TREES
    depth: int = 5
    learning_rate: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0
    min_child: int = 1
    l1: float = 0.0
    l2: float = 1.0

    def boosting(self, seed: int, left_out: int | None = None) -> Settings:
        shares = (self.row_share, self.column_share, float(self.min_child), self.l1, self.l2)
        return Settings(self.trees, self.depth, self.learning_rate, *shares, left_out, seed)


@dataclass(frozen=True)
class StackedModel:
    structured: TreeModel
    text: TreeModel
    meta: LogisticRegressionModel

    def save(self, path: str) -> None:
        """Each branch as a table of nodes, the stacking model as Spark writes it."""
        for name in BRANCHES:
            getattr(self, name).save(SparkSession.active(), f"{path}/{name}")
        self.meta.write().overwrite().save(f"{path}/meta")

    @staticmethod
    def load(path: str) -> StackedModel:
        branches = (TreeModel.load(SparkSession.active(), f"{path}/{name}") for name in BRANCHES)
        return StackedModel(*branches, LogisticRegressionModel.load(f"{path}/meta"))


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def score_branch(df: DataFrame, model: TreeModel, array: str, output: str) -> DataFrame:
    """Add the positive-class probability of one branch."""
    return df.withColumn(output, probability(df.sparkSession, [model], array))


def training_rows(features: DataFrame, split: str) -> DataFrame:
    """id, label and both arrays of one split."""
    return features.where(F.col("split") == split).select(fv.ID, encode_target(F.col(fv.TARGET)).alias("label"), *BRANCHES)


def balanced(train: DataFrame, branch: str, seed: int) -> DataFrame:
    """One branch oversampled in its own space, written once for the many fits that follow."""
    rows = smote(train.select(fv.ID, F.col(branch).alias("features"), "label"), seed=seed)
    return written(rows.select("label", "features"), f"balanced-{branch}")


def out_of_fold(
    train: DataFrame,
    folds: int = fv.FOLDS,
    settings: TreeSettings | None = None,
    seed: int = fv.SEED,
    parallelism: int = 2,
) -> DataFrame:
    """(id, label, fold, p_struct, p_nlp): each row scored by models that never saw its fold.

    Folds are the same for both branches and cut from the rows before oversampling. A branch's
    models grow in the same scans; the branches run side by side as Spark jobs of one session.
    """
    settings = settings or TreeSettings()
    spark = train.sparkSession
    work_root(spark)
    folded = written(stratified_folds(train, label="label", folds=folds, seed=seed), "folds")

    def fit(branch: str) -> list[TreeModel]:
        rows = folded.withColumn("key", F.xxhash64(fv.ID))
        trainer = Trainer(rows, branch, [settings.boosting(seed, fold) for fold in range(folds)])
        trainer.grow(settings.trees)
        return [TreeModel.of(m) for m in trainer.fitted]

    with ThreadPoolExecutor(parallelism) as pool:
        structured, text = pool.map(fit, BRANCHES)
    own = F.col("fold").cast("int")
    return folded.select(
        fv.ID, "label", F.col("fold").cast("long").alias("fold"),
        probability(spark, structured, "structured", own).alias("p_struct"),
        probability(spark, text, "text", own).alias("p_nlp"),
    )


def draw_settings(trials: int, seed: int, space: dict | None = None) -> list[TreeSettings]:
    """Seeded random draws from the search space; the learning rate and the penalties are drawn on a log scale."""
    space = space or fv.SEARCH_SPACE
    rng = random.Random(seed)
    drawn = []
    for _ in range(trials):
        spread = lambda name: math.exp(rng.uniform(*(math.log(v) for v in space[name])))
        drawn.append(
            TreeSettings(
                trees=rng.randint(*space["trees"]),
                depth=rng.randint(*space["depth"]),
                learning_rate=spread("learning_rate"),
                row_share=rng.uniform(*space["row_share"]),
                column_share=rng.uniform(*space["column_share"]),
                min_child=rng.randint(*space["min_child"]),
                l1=spread("l1"),
                l2=spread("l2"),
            )
        )
    return drawn


@dataclass(frozen=True)
class SearchResult:
    model: TreeModel
    best: TreeSettings
    #: Per candidate: its settings, the trees it was given, and its recall with them.
    recalls: list[tuple[TreeSettings, int, float]]


def staged_recalls(validation: DataFrame, branch: str, models: list[TreeModel], stages: list[list[int]]) -> list[list[float]]:
    """Recall of every model with its first so many trees, for each number asked: one scan of the rows for all."""
    spark = validation.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast((models, stages))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, stages = shared.value
        hits = [[0] * len(own) for own in stages]
        for batch in batches:
            x = batch.column("x").filter(pc.fill_null(pc.equal(batch.column("label"), 1), False))
            values = {width: matrix(x, width) for width in {m.width for m in models}}
            for k, (model, own) in enumerate(zip(models, stages)):
                for j, trees in enumerate(own):
                    cut = TreeModel(model.width, *(a[:trees] for a in (model.feature, model.threshold, model.value, model.gain, model.cover)))
                    hits[k][j] += int((cut.margins(values[model.width]) >= math.log(fv.DECISION_THRESHOLD / (1 - fv.DECISION_THRESHOLD))).sum())
        counted = [(k, j, n) for k, own in enumerate(hits) for j, n in enumerate(own)]
        kinds = {"model": pa.int32(), "stage": pa.int32(), "hits": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in counted], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    rows = validation.select(F.col("label").cast("int").alias("label"), F.col(branch).alias("x"))
    positives = rows.filter("label = 1").count()
    found = rows.mapInArrow(judge, "model int, stage int, hits long").groupBy("model", "stage").agg(F.sum("hits").alias("hits")).collect()
    out = [[0.0] * len(own) for own in stages]
    for r in found:
        out[r["model"]][r["stage"]] = r["hits"] / positives if positives else 0.0
    return out


def search(
    train: DataFrame,
    validation: DataFrame,
    branch: str,
    candidates: list[TreeSettings],
    seed: int = fv.SEED,
    rungs: tuple[int, ...] = fv.SEARCH_RUNGS,
    keep: float = fv.SEARCH_KEEP,
) -> SearchResult:
    """All candidates grown side by side on the oversampled rows, the best recall on untouched validation rows kept.

    ``train`` has ``label`` and ``features``; ``validation`` has ``label`` and the branch array.
    At each rung (a number of trees) all that still grow are judged, and the share ``keep`` with the best
    recalls goes on; a candidate that has all its trees stays with its recall. Without rungs every
    candidate gets all its trees. A candidate's first trees are the same whatever follows, so its recall
    is that of a fit of its own with as many trees. Ties go to the first candidate.
    """
    trainer = Trainer(train, "features", [c.boosting(seed) for c in candidates])
    recalls = [0.0] * len(candidates)
    going = list(range(len(candidates)))
    for rung in (*sorted(rungs), max((c.trees for c in candidates), default=0)):
        trainer.grow(rung, going)
        models = [TreeModel.of(trainer.fitted[k]) for k in going]
        judged = staged_recalls(validation, branch, models, [[len(trainer.fitted[k].trees)] for k in going])
        for k, (recall,) in zip(going, judged):
            recalls[k] = recall
        ranked = sorted(going, key=lambda k: (-recalls[k], k))[: max(1, math.ceil(keep * len(going)))]
        going = sorted(k for k in ranked if len(trainer.fitted[k].trees) < candidates[k].trees)
        if not going:
            break
    given = [len(m.trees) for m in trainer.fitted]
    best = max(range(len(candidates)), key=lambda k: (recalls[k], given[k], -k))
    return SearchResult(TreeModel.of(trainer.fitted[best]), candidates[best], list(zip(candidates, given, recalls)))


def stack_vector(df: DataFrame) -> DataFrame:
    """The two branch scores as the stacking input, structured first."""
    return df.withColumn("stack", as_vector(F.array("p_struct", "p_nlp")))


def fit_meta(oof: DataFrame, strength: float = fv.META_C, max_iter: int = fv.META_MAX_ITER) -> LogisticRegressionModel:
    """L2 logistic regression; Spark averages the loss, so the penalty is 1 / (C n)."""
    n = oof.count()
    learner = LogisticRegression(
        featuresCol="stack",
        labelCol="label",
        predictionCol="meta_prediction",
        probabilityCol="meta_probability",
        rawPredictionCol="meta_raw",
        regParam=1.0 / (strength * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    )
    return learner.fit(stack_vector(oof).select("stack", "label"))


@dataclass(frozen=True)
class TrainingPlan:
    folds: int = fv.FOLDS
    oof: TreeSettings = TreeSettings()
    structured_candidates: tuple[TreeSettings, ...] = ()
    text_candidates: tuple[TreeSettings, ...] = ()
    seed: int = fv.SEED
    rungs: tuple[int, ...] = fv.SEARCH_RUNGS

    def candidates(self, branch: str) -> list[TreeSettings]:
        given = self.structured_candidates if branch == "structured" else self.text_candidates
        trials = fv.STRUCTURED_TRIALS if branch == "structured" else fv.TEXT_TRIALS
        return list(given) or draw_settings(trials, self.seed)


def train_stacked(features: DataFrame, plan: TrainingPlan | None = None) -> StackedModel:
    """Oversample, score out of fold, search and refit per branch, then fit the stacking model."""
    plan = plan or TrainingPlan()
    work_root(features.sparkSession)
    train = written(training_rows(features, "train"), "train")
    validation = written(training_rows(features, "val"), "val")
    oof = written(out_of_fold(train, plan.folds, plan.oof, plan.seed), "oof")

    def best(branch: str) -> TreeModel:
        rows = balanced(train, branch, plan.seed)
        return search(rows, validation, branch, plan.candidates(branch), plan.seed, plan.rungs).model

    with ThreadPoolExecutor(len(BRANCHES)) as pool:
        models = list(pool.map(best, BRANCHES))
    return StackedModel(*models, fit_meta(oof))
