"""Boosted trees that SQL can grow again: one split a tree, over columns with few values.

Whether a line costs more than 30,000 is told from its quantity, discount and tax. The SQL twins run the same rounds as
chained common tables: gradients per cell of equal lines, cumulative sums per column, the best
cut with leaf penalties, and new margins. Scores, leaf boxes, contributions and importances of
the fitted model are held against that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.catalog.registry import query
from staywise.operators import attribution
from staywise.operators.boosting import PARTS, Settings, fit
from staywise.operators.tree_model import TreeModel, margins_by_boxes, probability
from staywise.session import new_folder, written
from staywise.sources.landing import path_stamp

COLUMNS = ("l_quantity", "l_discount", "l_tax")
STUMPS = Settings(trees=6, depth=1, learning_rate=0.3, l1=2.0, l2=1.5)
_MODELS: dict[tuple, TreeModel] = {}


def _lines(spark, sf) -> DataFrame:
    label = (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30_000).cast("double")
    x = F.array(*[F.col(c).cast("double") for c in COLUMNS])
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(label.alias("label"), x.alias("x"), *[F.col(c).cast("double").alias(c) for c in COLUMNS])


def _model(spark, sf) -> TreeModel:
    """The model of this session and table, fitted on all its lines."""
    key = (spark.sparkContext.applicationId, sf, path_stamp(spark, f"{sf}/lineitem.parquet"))
    if key not in _MODELS:
        _MODELS[key] = TreeModel.of(fit(_lines(spark, sf).select("label", "x"), "x", [STUMPS])[0])
    return _MODELS[key]


def _cells(spark, sf) -> DataFrame:
    """Lines of equal values, counted."""
    cells = _lines(spark, sf).groupBy("x", *COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    return written(cells.withColumn("cell", F.concat_ws("|", *COLUMNS)), "cells")


def _shown(value: Column | str) -> Column:
    return F.round(value, 6) + F.lit(0.0)


def _rounds() -> str:
    s, l1, l2 = f"{PARTS:.1f}", STUMPS.l1, STUMPS.l2
    strength = lambda g, h: f"pow(greatest(abs({g}) - {l1}, 0), 2) / ({h} + {l2})"
    leaf = lambda g, h: f"-{STUMPS.learning_rate} * sign({g}) * greatest(abs({g}) - {l1}, 0) / ({h} + {l2})"
    names = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in COLUMNS)
    parts = [f"cells0 AS (SELECT {names}, count(*) FILTER (l_extendedprice * (1 - l_discount) > 30000) AS n1, count(*) FILTER (NOT l_extendedprice * (1 - l_discount) > 30000) AS n0, CAST(0 AS DOUBLE) AS m FROM lineitem GROUP BY ALL)"]
    for k in range(STUMPS.trees):
        p = "(1 / (1 + exp(-m)))"
        sums = " UNION ALL ".join(f"SELECT {j} AS f, {c} AS v, sum(g) AS g, sum(h) AS h FROM g{k} GROUP BY {c}" for j, c in enumerate(COLUMNS))
        value = "CASE f " + " ".join(f"WHEN {j} THEN {c}" for j, c in enumerate(COLUMNS)) + " END"
        parts += [
            f"g{k} AS (SELECT *, n1 * round(({p} - 1) * {s}) + n0 * round({p} * {s}) AS g, (n0 + n1) * round({p} * (1 - {p}) * {s}) AS h FROM cells{k})",
            f"""cum{k} AS (SELECT f, v, sum(g) OVER w / {s} AS lg, sum(h) OVER w / {s} AS lh, sum(g) OVER (PARTITION BY f) / {s} AS tg, sum(h) OVER (PARTITION BY f) / {s} AS th,
                max(v) OVER (PARTITION BY f) AS top FROM ({sums}) WINDOW w AS (PARTITION BY f ORDER BY v))""",
            f"""best{k} AS (SELECT {k} AS tree, f, v, 0.5 * ({strength("lg", "lh")} + {strength("(tg - lg)", "(th - lh)")} - {strength("tg", "th")}) AS gain, th AS cover, lh,
                {leaf("lg", "lh")} AS l, {leaf("(tg - lg)", "(th - lh)")} AS r FROM cum{k} WHERE v < top AND lh >= {STUMPS.min_child} AND th - lh >= {STUMPS.min_child} ORDER BY gain DESC, f, v LIMIT 1)""",
            f"cells{k + 1} AS (SELECT {', '.join(COLUMNS)}, n1, n0, m + CASE WHEN {value} <= v THEN l ELSE r END AS m FROM cells{k}, best{k})",
        ]
    trees = " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(STUMPS.trees))
    return "WITH " + ",\n".join([*parts, f"trees AS ({trees}), scored AS (SELECT * FROM cells{STUMPS.trees})\n"])


ROUNDS = _rounds()
_NAME = "CASE f " + " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(COLUMNS)) + " END"
_SIDE = "CASE f " + " ".join(f"WHEN {j} THEN {c}" for j, c in enumerate(COLUMNS)) + " END"


@query(
    "boosted_stumps",
    ROUNDS + f"SELECT tree, {_NAME} AS feature, v AS threshold, round(gain, 4) AS gain, round(l, 6) AS left_value, round(r, 6) AS right_value FROM trees",
)
def boosted_stumps(spark, sf):
    """Column, cut, gain and leaf values of every tree."""
    m = _model(spark, sf)
    rows = [(t, COLUMNS[m.feature[t, 0]], float(m.threshold[t, 0]), float(m.gain[t, 0]), float(m.value[t, 1]), float(m.value[t, 2])) for t in range(len(m.feature))]
    table = spark.createDataFrame(rows, "tree int, feature string, threshold double, gain double, left_value double, right_value double")
    return table.select("tree", "feature", "threshold", F.round("gain", 4).alias("gain"), _shown("left_value").alias("left_value"), _shown("right_value").alias("right_value"))


@query(
    "stump_scores",
    ROUNDS + f"SELECT {', '.join(COLUMNS)}, n0 + n1 AS n, round(1 / (1 + exp(-m)), 6) AS p, 1 / (1 + exp(-m)) >= 0.5 AS flagged FROM scored",
)
def stump_scores(spark, sf):
    """Every line scored by the saved and loaded model, shown per cell of equal lines."""
    path = new_folder(spark, "stumps")
    _model(spark, sf).save(spark, path)
    scored = _lines(spark, sf).withColumn("p", probability(spark, [TreeModel.load(spark, path)], "x"))
    cells = scored.groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    return cells.select(*COLUMNS, "n", _shown("p").alias("p"), (F.col("p") >= 0.5).alias("flagged"))


@query("stump_box_margins", ROUNDS + f"SELECT {', '.join(COLUMNS)}, round(m, 6) AS margin FROM scored")
def stump_box_margins(spark, sf):
    """Margins from the table of leaf boxes alone, by an interval join."""
    cells = _cells(spark, sf)
    margins = margins_by_boxes(cells, "cell", "x", _model(spark, sf).boxes(spark))
    return cells.join(margins, "cell").select(*COLUMNS, _shown("margin").alias("margin"))


@query(
    "stump_attribution",
    ROUNDS
    + f"""SELECT {", ".join(COLUMNS)}, round(any_value(base), 6) AS base, {", ".join(f"round(coalesce(sum(v) FILTER (f = {j}), 0), 6) AS by_{c}" for j, c in enumerate(COLUMNS))}
FROM (SELECT {", ".join(COLUMNS)}, f, CASE WHEN {_SIDE} <= v THEN l ELSE r END - (lh * l + (cover - lh) * r) / cover AS v FROM scored, trees),
     (SELECT sum((lh * l + (cover - lh) * r) / cover) AS base FROM trees) GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY " + ", ".join(COLUMNS)),
)
def stump_attribution(spark, sf):
    """What each column adds to the margin of every cell."""
    explained = attribution.attribute(_cells(spark, sf), _model(spark, sf), list(COLUMNS), "x", list(COLUMNS))
    by = [_shown(F.col("contributions")[j]["value"]).alias(f"by_{c}") for j, c in enumerate(COLUMNS)]
    return explained.select(*COLUMNS, _shown("base").alias("base"), *by)


@query(
    "stump_importances",
    ROUNDS
    + f"SELECT feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM trees), 6) AS importance FROM (SELECT unnest({list(COLUMNS)}) AS feature) LEFT JOIN (SELECT {_NAME} AS feature, gain FROM trees) USING (feature) GROUP BY feature",
)
def stump_importances(spark, sf):
    """Each column's share of all gain."""
    table = attribution.top_importances(_model(spark, sf), spark.range(0), list(COLUMNS))
    return table.select("feature", _shown("importance").alias("importance"))
