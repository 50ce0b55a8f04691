from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import explore, measures, ranking, splits


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema).repartition(4)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value; heavy tails, NaN and NULL besides."""
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(4000, 3.25), rng.lognormal(0, 4, 5000), -rng.lognormal(0, 2, 3000)])
    groups = rng.choice(["a", "b", "c"], len(values), p=[0.7, 0.2, 0.1])
    rows = [(g, float(v), float(int(v) % 7)) for g, v in zip(groups, values)]
    rows += [("a", float("nan"), 1.0), ("b", None, 2.0)]
    return rows


@pytest.mark.parametrize("accuracy", [10000, 10])
def test_quantiles_are_exact(spark, skewed, accuracy):
    df = frame(spark, skewed, "g string, v double, w double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    fitted = ranking.exact_quantiles(df, ["v", "w"], shares, ["g"], accuracy=accuracy)
    assert len(fitted) == 6
    for f in fitted:
        i = 1 if f["feature"] == "v" else 2
        mine = [r[i] for r in skewed if r[0] == f["g"] and r[i] is not None and not np.isnan(r[i])]
        assert f["count"] == len(mine)
        np.testing.assert_allclose(f["quantiles"], np.quantile(mine, shares), rtol=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert ranking.exact_quantiles(df, ["v"], [0.5])[0] == {"feature": "v", "count": 0, "quantiles": [None]}


def test_a_bracket_that_misses_is_searched_again(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    real, calls = ranking._look_inside, []

    def narrow(df, by, columns, groups, wanted):
        calls.append(len(wanted))
        if len(calls) == 1:
            wanted = [{**w, "low": 0.0, "high": 1.0} for w in wanted]
        return real(df, by, columns, groups, wanted)

    monkeypatch.setattr(ranking, "_look_inside", narrow)
    assert ranking.exact_quantiles(df, ["v"], [0.5])[0]["quantiles"] == [499.5]
    assert calls == [1, 1]


def test_running_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), int(n)) for g in "ab" for v, n in zip(rng.permutation(3000), rng.integers(1, 9, 3000))]
    got = ranking.running_counts(frame(spark, rows, "g string, v double, n bigint"), ["g"], "v", ["n"], ranges=16).collect()
    for g in "ab":
        mine = sorted((r["v"], r["n"], r["before_n"]) for r in got if r["g"] == g)
        n = np.array([m[1] for m in mine])
        assert [m[2] for m in mine] == list(np.cumsum(n) - n)


def brute_area(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_area_counts_ties_half(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900)
    s = np.round(rng.random(900) * 0.3 + y * 0.1, 2)
    s[:300] = 0.5
    rows = [("r", int(a), float(b)) for a, b in zip(y, s)]
    df = frame(spark, rows, "run string, label int, probability double")
    assert measures.roc_auc(df, ["run"]).first()["roc_auc"] == pytest.approx(brute_area(y, s), abs=1e-12)
    assert measures.roc_auc(df.where("label = 1"), ["run"]).first()["roc_auc"] is None


def test_metrics_on_four_rows(spark):
    rows = [("r", 0, 0, 0.1), ("r", 1, 1, 0.9), ("r", 0, 1, 0.8), ("r", 1, 1, 0.7)]
    df = spark.createDataFrame(rows, "run string, label int, prediction int, probability double")
    got = measures.metric_suite(df, ["run"]).first()
    assert [got["recall"], got["precision"], got["f1"], got["roc_auc"]] == pytest.approx([1.0, 2 / 3, 0.8, 0.75])


def test_published_confusions(spark):
    rows = [("structured_baseline", 216, 64, 173, 604), ("nlp_baseline", 199, 81, 328, 449), ("late_fusion_stacked", 183, 97, 125, 652)]
    df = spark.createDataFrame(rows, "run string, tp bigint, fn bigint, fp bigint, tn bigint")
    got = {r["run"]: r for r in measures.with_lift(measures.with_rates(df)).collect()}
    s, t, f = (got[r[0]] for r in rows)
    assert [round(s[m], 4) for m in ("recall", "precision", "f1")] == [0.7714, 0.5553, 0.6457]
    assert [round(t[m], 4) for m in ("recall", "f1")] == [0.7107, 0.4932]
    assert [round(f[m], 4) for m in ("recall", "f1")] == [0.6536, 0.6224]
    assert (round(f["recall_lift"], 3), round(f["f1_lift"], 3)) == (-0.118, -0.023)
    assert s["recall_lift"] is None
    assert [round(100 * r["fp_rate"], 1) for r in (s, t, f)] == [22.3, 42.2, 16.1]
    reduced = {r["run"]: r["fp_reduction"] for r in measures.false_positive_reduction(df).collect()}
    assert reduced["late_fusion_stacked"] == pytest.approx(48 / 173)


def test_measures_without_positives(spark):
    df = spark.createDataFrame([("r", 0, 0, 0.1)], "run string, label int, prediction int, probability double")
    got = measures.metric_suite(df, ["run"]).first()
    assert (got["recall"], got["precision"], got["f1"], got["roc_auc"]) == (0.0, 0.0, 0.0, None)


def test_split_sizes_of_the_full_table(spark):
    df = spark.range(7043).select(F.col("id").cast("string").alias("customerID"), F.when(F.col("id") < 1869, "Yes").otherwise("No").alias("Churn"))
    split = splits.stratified_split(df)
    got = {(r["split"], r["Churn"]): r["count"] for r in split.groupBy("split", "Churn").count().collect()}
    sizes = {s: got[(s, "Yes")] + got[(s, "No")] for s in ("train", "val", "test")}
    assert sizes == {"train": 4929, "val": 1057, "test": 1057}
    for s, n in sizes.items():
        assert abs(got[(s, "Yes")] - n * 1869 / 7043) <= 1
    assert splits.stratified_split(df.repartition(7)).exceptAll(split).count() == 0


def test_folds_are_balanced(spark):
    df = spark.range(1003).select(F.col("id").alias("customerID"), (F.col("id") % 3 == 0).cast("long").alias("Churn"))
    sizes = {}
    for r in splits.stratified_folds(df).groupBy("Churn", "fold").count().collect():
        sizes.setdefault(r["Churn"], {})[r["fold"]] = r["count"]
    for per_fold in sizes.values():
        assert sorted(per_fold) == [0, 1, 2, 3, 4] and max(per_fold.values()) - min(per_fold.values()) <= 1


def test_split_keeps_a_repeated_id_together(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("customerID"), F.lit("No").alias("Churn"))
    split = splits.stratified_split(df)
    assert split.where("customerID = 0").select("split").distinct().count() == 1
    assert split.where("split is null").count() == 0


def test_split_with_a_tiny_class(spark):
    df = spark.range(101).select(F.col("id").alias("customerID"), F.when(F.col("id") == 0, "Yes").otherwise("No").alias("Churn"))
    assert splits.stratified_split(df).where("split is null").count() == 0


def test_correlation_and_inflation(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1e6, 3, (500, 4))
    x[:, 3] = 2 * x[:, 0] + rng.normal(0, 1, 500)
    df = spark.createDataFrame([(*map(float, r), 5.0) for r in x], "a double, b double, c double, d double, k double").repartition(3)
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in explore.correlation_matrix(df, ["a", "b", "c", "d", "k"]).collect()}
    want = np.corrcoef(x.T)
    for i, p in enumerate("abcd"):
        for j, q in enumerate("abcd"):
            assert got[(p, q)] == pytest.approx(want[i, j], abs=1e-9)
    assert got[("k", "k")] is None and got[("a", "k")] is None
    z = rng.normal(0, 1, (400, 3)) + np.array([1.0, 0.0, 2.0])
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double, c double")
    vif = explore.variance_inflation(df, ["a", "b", "c"]).collect()
    assert [r["VIF"] for r in vif] == sorted((r["VIF"] for r in vif), reverse=True)
    for r in vif:
        i = "abc".index(r["Feature"])
        others = np.delete(z, i, axis=1)
        fit = others @ np.linalg.lstsq(others, z[:, i], rcond=None)[0]
        assert r["VIF"] == pytest.approx((z[:, i] ** 2).sum() / ((z[:, i] - fit) ** 2).sum())


def test_correlation_ignores_missing_pairs(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, 5.0), (None, 3.0), (float("nan"), 9.0)]
    got = explore.correlation_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    want = np.corrcoef([1.0, 3.0, 4.0], [2.0, 1.0, 5.0])[0, 1]
    assert got.where("feature_a = 'a' and feature_b = 'b'").first()["corr"] == pytest.approx(want)


def test_boxplot_on_skew(spark, skewed):
    df = frame(spark, skewed, "g string, v double, w double")
    for r in explore.boxplot_stats(df, ["v"], "g").collect():
        mine = np.array([x[1] for x in skewed if x[0] == r["g"] and x[1] is not None and not np.isnan(x[1])])
        q1, q3 = np.quantile(mine, [0.25, 0.75])
        near = mine[(mine >= q1 - 1.5 * (q3 - q1)) & (mine <= q3 + 1.5 * (q3 - q1))]
        assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (near.min(), near.max(), len(mine) - len(near))


def test_too_many_categories_are_refused(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        explore.category_values(df, ["c"], limit=10)


def test_wide_moments_in_tiles(spark, monkeypatch):
    """Tiles of several scans give the sums of one matrix product; rounding is carried along."""
    import numpy as np

    monkeypatch.setattr(explore, "BLOCK", 4)
    monkeypatch.setattr(explore, "TILE_CELLS", 32)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 11)) + 1e6
    x[:, 3] = 7.0
    x[::5, 2] = np.nan
    names = [f"c {k}" for k in range(11)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r.feature_a, r.feature_b): r.corr for r in explore.correlation_matrix(df, names).collect()}
    assert len(got) == 121
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 3 in (i, j):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    total, rest = np.array([1e16]), np.zeros(1)
    for _ in range(1000):
        total = explore._added(total, rest, np.array([1.0]))
    assert (total + rest)[0] == 1e16 + 1000
