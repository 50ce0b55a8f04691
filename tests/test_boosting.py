"""Boosted trees against plain loops, and saved models scored outside the library."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staywise.operators import attribution, boosting
from staywise.operators.boosting import PARTS, Settings
from staywise.operators.tree_model import TreeModel, margins_by_boxes
from staywise.plans import training


def plain_boost(x, y, cuts, s: Settings, key) -> list[dict]:
    """One model by recursion over row lists; a tree is {node: (feature, cut)} and {node: value}."""
    n, width = x.shape
    bins = [[sum(c < x[i, j] for c in cuts[j]) for j in range(width)] for i in range(n)]
    margin = [0.0] * n
    out = []
    for t in range(s.trees):
        p = [1.0 / (1.0 + math.exp(-m)) for m in margin]
        g = [round((p[i] - y[i]) * PARTS) for i in range(n)]
        h = [round(p[i] * (1 - p[i]) * PARTS) for i in range(n)]
        rows = np.flatnonzero(boosting.seen_rows(key, s, t)).tolist()
        allowed = boosting.seen_features(width, s, t).tolist()
        splits, values, where = {}, {}, {}

        def score(a, b):
            return max(abs(a) - s.l1, 0.0) ** 2 / (b + s.l2)

        def leaf(a, b):
            return -s.learning_rate * math.copysign(max(abs(a) - s.l1, 0.0), a) / (b + s.l2)

        def grow(node, own, level):
            total = sum(g[i] for i in own) / PARTS, sum(h[i] for i in own) / PARTS
            best = (1e-9, None)
            if level < s.depth:
                for f in allowed:
                    top = (0.0, None)
                    for c in range(len(cuts[f])):
                        left = [i for i in own if bins[i][f] <= c]
                        a, b = sum(g[i] for i in left) / PARTS, sum(h[i] for i in left) / PARTS
                        if b >= s.min_child and total[1] - b >= s.min_child:
                            gain = 0.5 * (score(a, b) + score(total[0] - a, total[1] - b) - score(*total))
                            if gain > top[0]:
                                top = (gain, (f, c))
                    if top[0] > best[0] + (1e-9 if best[1] else 0.0):
                        best = top
            if best[1] is None:
                values[node] = leaf(*total)
                return
            splits[node] = best[1]
            f, c = best[1]
            grow(2 * node + 1, [i for i in own if bins[i][f] <= c], level + 1)
            grow(2 * node + 2, [i for i in own if bins[i][f] > c], level + 1)

        grow(0, rows, 0)
        for i in range(n):
            node = 0
            while node in splits:
                f, c = splits[node]
                node = 2 * node + 1 + (bins[i][f] > c)
            margin[i] += values[node]
        out.append({"splits": splits, "values": values})
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 5))
    x[:, 3] = np.round(x[:, 3])
    x[:, 4] = 1.0
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * x[:, 3] + rng.normal(size=2000)) > 0.8).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    listed = [(float(b), i % 4, i, a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(listed, "label double, fold int, key long, x array<double>").repartition(3)


MODELS = [
    Settings(trees=3, depth=3, left_out=1),
    Settings(trees=3, depth=2, learning_rate=0.3, row_share=0.7, column_share=0.6, l1=0.8, l2=0.01, min_child=20.0, seed=5),
]


@pytest.fixture(scope="module")
def fitted(rows):
    return boosting.fit(rows, "x", MODELS, bins=16)


def test_models_equal_plain_loops(fitted, data):
    x, y = data
    assert len(fitted[0].cuts[4]) == 0 and len(fitted[0].cuts[0]) == 15 and len(fitted[0].cuts[3]) < 9
    for model, s in zip(fitted, MODELS):
        own = np.array([i for i in range(2000) if i % 4 != s.left_out])
        for tree, plain in zip(model.trees, plain_boost(x[own], y[own], model.cuts, s, own), strict=True):
            assert {int(i): (int(tree.feature[i]), int(tree.cut[i])) for i in np.flatnonzero(tree.feature >= 0)} == plain["splits"]
            for node, value in plain["values"].items():
                assert tree.value[node] == pytest.approx(value, abs=1e-9)


def test_dealing_of_rows_does_not_matter(rows, fitted, monkeypatch):
    monkeypatch.setattr(boosting, "SHARED_BYTES", 0)  # rows are dealt to tasks, not models
    monkeypatch.setattr(boosting, "KEEP", 2)  # margins are written in between
    monkeypatch.setattr(boosting, "SLICE", 8)  # every model's sums in several slices
    again = boosting.fit(rows.repartition(7), "x", MODELS, bins=16)
    for a, b in zip(fitted, again):
        for s, t in zip(a.trees, b.trees, strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all()


@pytest.mark.parametrize("shared", [0, boosting.SHARED_BYTES])
def test_first_trees_are_those_of_a_shorter_fit(rows, fitted, monkeypatch, shared):
    monkeypatch.setattr(boosting, "SHARED_BYTES", shared)
    trainer = boosting.Trainer(rows, "x", MODELS, bins=16)
    trainer.grow(2)
    assert [len(m.trees) for m in trainer.fitted] == [2, 2]
    trainer.grow(3, [1])
    assert [len(m.trees) for m in trainer.fitted] == [2, 3]
    assert (trainer.fitted[1].trees[2].value == fitted[1].trees[2].value).all()


@pytest.mark.parametrize("shared", [0, boosting.SHARED_BYTES])
def test_no_rows_and_one_class(spark, monkeypatch, shared):
    monkeypatch.setattr(boosting, "SHARED_BYTES", shared)
    schema = "label double, x array<double>"
    one = boosting.fit(spark.createDataFrame([(1.0, [1.0, 2.0]), (1.0, [2.0, 2.0])], schema), "x", [Settings(trees=2, depth=2)])[0]
    assert (one.trees[0].feature == -1).all() and one.trees[0].value[0] > 0
    none = boosting.fit(spark.createDataFrame([], schema), "x", [Settings(trees=1)])[0]
    assert none.cuts == [] and none.margins(np.zeros((2, 0))).tolist() == [0.0, 0.0]


def test_saved_model_scores_in_plain_sql(spark, rows, fitted, data, tmp_path):
    x, _ = data
    model = TreeModel.of(fitted[1])
    model.save(spark, str(tmp_path / "m"))
    loaded = TreeModel.load(spark, str(tmp_path / "m"))
    assert (loaded.feature[:, : model.feature.shape[1]] == model.feature).all()
    holed = x[:300].copy()
    holed[::7, 0] = np.nan
    expected = loaded.margins(holed)
    assert fitted[1].margins(holed) == pytest.approx(expected, abs=1e-12)
    boxes = loaded.boxes(spark)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(holed)], "id long, x array<double>")
    got = {r.id: r.margin for r in margins_by_boxes(df, "id", "x", boxes).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(expected.tolist(), abs=1e-9)
    # The same outside this library.
    sides = boxes.toPandas()
    cells = df.selectExpr("id", "posexplode(x) AS (feature, v)").toPandas()
    con = duckdb.connect()
    con.register("sides", sides)
    con.register("cells", cells)
    sql = """SELECT id, sum(value) FROM (SELECT id, tree, leaf, any_value(value) AS value FROM cells JOIN sides USING (feature)
             WHERE CASE WHEN isnan(coalesce(v, 'nan'::DOUBLE)) THEN low = '-inf'::DOUBLE ELSE v > low AND v <= high END
             GROUP BY ALL HAVING count(*) = any_value(sides)) GROUP BY id ORDER BY id"""
    assert [m for _, m in con.execute(sql).fetchall()] == pytest.approx(expected.tolist(), abs=1e-9)


def test_attribution_of_a_boosted_model(fitted, data):
    x, _ = data
    model = TreeModel.of(fitted[0])
    phi, base = attribution.contributions(x[:50], model.leaves())
    assert (phi.sum(axis=1) + base) == pytest.approx(model.margins(x[:50]).tolist(), abs=1e-9)


def test_staged_search_equals_separate_fits(spark, rows):
    train = rows.filter("fold > 0").select("label", "x", "key").withColumnRenamed("x", "features")
    validation = rows.filter("fold = 0").select("label", "x")
    some = [training.TreeSettings(trees=t, depth=d, learning_rate=r, l1=0.1) for t, d, r in ((2, 2, 0.1), (4, 3, 0.3), (4, 1, 0.2), (3, 2, 0.3))]
    whole = training.search(train, validation, "x", some, rungs=())
    assert [g for _, g, _ in whole.recalls] == [2, 4, 4, 3]
    for settings, _, recall in whole.recalls:
        alone = training.search(train, validation, "x", [settings], rungs=())
        assert alone.recalls[0][2] == recall
    halved = training.search(train, validation, "x", some, rungs=(1, 2), keep=0.5)
    assert sorted(g for _, g, _ in halved.recalls) == [1, 1, 2, 2] or max(g for _, g, _ in halved.recalls) == 4
    assert halved.recalls[some.index(halved.best)][2] == max(r for _, _, r in halved.recalls)


def test_sums_of_columns_equal_plain_ones():
    """Features of one, two and more bins; nodes without rows; more rows than one product takes."""
    rng = np.random.default_rng(3)
    sizes = np.array([2, 1, 5, 2, 64])
    bins = np.stack([rng.integers(0, k, 40_000) for k in sizes], axis=1).astype(np.uint8)
    g, h = rng.integers(-(1 << 24), 1 << 24, 40_000).astype(float), rng.integers(0, 1 << 22, 40_000).astype(float)
    features = np.array([0, 1, 2, 4])  # a tree need not see all of them
    own = sizes[features]
    offset, cells = np.cumsum(own) - own, int(own.sum())
    held = [np.arange(0, 30_000), np.zeros(0, np.int64), np.arange(30_000, 40_000, 2)]
    got = boosting._Columns(bins, sizes).sums(held, g, h, features, offset, own, cells)
    for k, rows in enumerate(held):
        for f, at, size in zip(features, offset, own):
            for w, v in enumerate((g, h)):
                assert (got[w, k, at : at + size] == [v[rows][bins[rows, f] == b].sum() for b in range(size)]).all()


def test_features_of_many_rows_are_summed_in_groups(monkeypatch):
    """One pass over the rows serves all features of a group, with the sums of the plain way."""
    rng = np.random.default_rng(4)
    sizes = np.array([64] * 4 + [2] * 24 + [1, 255, 9])
    assert sorted(f for group in boosting.feature_groups(sizes) for f in group) == [k for k in range(31) if k != 28]
    assert all(len(group) == 1 or np.prod(sizes[group]) <= boosting.JOINT for group in boosting.feature_groups(sizes))
    bins = np.stack([rng.integers(0, k, 30_000) for k in sizes], axis=1).astype(np.uint8)
    g, h = rng.integers(-(1 << 24), 1 << 24, 30_000).astype(float), rng.integers(0, 1 << 22, 30_000).astype(float)
    features = np.flatnonzero(rng.random(31) < 0.7)
    own = sizes[features]
    offset, cells = np.cumsum(own) - own, int(own.sum())
    held = [np.arange(0, 30_000, 2), np.zeros(0, np.int64), np.arange(1, 30_000, 4)]
    passes, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: passes.append(1) or plain(*a))
    got = boosting._Columns(bins, sizes).sums(held, g, h, features, offset, own, cells)
    assert len(passes) <= 2 * len(held) * 6
    monkeypatch.setattr(boosting, "JOINT", 1 << 40)
    assert (boosting._Columns(bins, sizes).sums(held, g, h, features, offset, own, cells) == got).all()


def test_many_rows_share_a_record(rows):
    """Rows travel in blocks, so a scan takes its time for cells and not for records."""
    trainer = boosting.Trainer(rows, "x", MODELS, bins=16)
    held = trainer.table.collect()
    assert sum(r.n for r in held) == 2000 and len(held) < 100
    assert max(len(r.bins) + len(r.margins) + len(r.label) + len(r.fold) + len(r.key) for r in held) <= boosting.BLOCK_BYTES


def test_a_row_without_label_spoils_its_own_bins():
    """Sums of gradients that are no numbers stay where the row is, also for features of two bins."""
    bins = np.array([[0, 0], [1, 2], [1, 1]], np.uint8)
    g, h, own = np.array([1.0, np.nan, 4.0]), np.array([1.0, np.nan, 2.0]), np.array([2, 3])
    got = boosting._Columns(bins, own).sums([np.arange(3)], g, h, np.arange(2), np.array([0, 2]), own, 5)[0, 0]
    assert got[[0, 2, 3]].tolist() == [1.0, 1.0, 4.0] and np.isnan(got[[1, 4]]).all()


def test_tasks_that_read_the_rows_grow_the_same_models(rows, fitted, monkeypatch):
    """Beyond the broadcast each task reads the table and holds few bytes a row; no job scans level by level."""
    trainer = boosting.Trainer(rows, "x", MODELS, bins=16)
    held = boosting.held_bytes(trainer.sizes, 2000)
    monkeypatch.setattr(boosting, "SHARED_BYTES", -(-held // boosting.HELD))
    monkeypatch.setattr(boosting, "_PART", 300)
    monkeypatch.setattr(boosting, "JOINT", 256)  # some nodes are summed by joint bins, others by feature
    monkeypatch.setattr(boosting.Trainer, "_level", None)
    trainer = boosting.Trainer(rows, "x", MODELS, bins=16)
    assert trainer.shared is None and trainer.held == 2000
    trainer.grow(2)
    trainer.grow(3)
    for a, b in zip(fitted, trainer.fitted, strict=True):
        for s, t in zip(a.trees, b.trees, strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all()


def test_joint_bins_tell_each_features_bin():
    rng = np.random.default_rng(6)
    sizes = np.array([64] * 3 + [2] * 15 + [1, 255, 9])
    bins = np.stack([rng.integers(0, k, 700) for k in sizes], axis=1).astype(np.uint8)
    columns = boosting._Joint(sizes, 800)
    columns.put(0, bins[:300])
    columns.put(300, bins[300:])
    rows = rng.permutation(700)[:400]
    assert all((columns.bin(f, rows) == bins[rows, f]).all() for f in np.flatnonzero(sizes > 1).tolist())
    assert (columns.twos(rows) == bins[rows][:, sizes == 2].T).all()


def test_cuts_are_sparks_quantiles(spark, monkeypatch):
    """Values that repeat, are missing, no numbers or all the same; runs that are thinned keep ranks closely."""
    rng = np.random.default_rng(8)
    columns = [rng.normal(size=3000), rng.integers(0, 2, 3000) * 1.0, rng.integers(0, 40, 3000) / 7, np.full(3000, 2.5), (rng.random(3000) < 0.01) * 1.0]
    x = [[float(v) for v in r] for r in zip(*columns)]
    x = [[None if i % 5 == 0 else r[0], *r[1:], math.nan if i == 7 else float(i), None] for i, r in enumerate(x)]
    df = spark.createDataFrame([(r,) for r in x], "x array<double>").repartition(5)
    shares = [k / 16 for k in range(1, 16)]
    found = df.agg(*[F.percentile_approx(F.col("x")[j], shares, 100_000) for j in range(7)], *[F.max(F.col("x")[j]) for j in range(7)]).first()
    want = [sorted({v for v in found[j] or [] if v < found[7 + j]}) for j in range(7)]
    assert [c.tolist() for c in boosting.quantile_cuts(df, "x", 7, 16)] == want and len(want[0]) == 15 and want[3] == want[5] == []
    monkeypatch.setattr(boosting, "_RANKED", 200)
    monkeypatch.setattr(boosting, "_MERGED", 800)
    order = np.sort([r[0] for r in x if r[0] is not None])
    parts = np.random.default_rng(9).permutation(len(order)).reshape(-1, 200)
    thin = [pa.RecordBatch.from_arrays([pa.array([[v] for v in order[p]])], ["x"]) for p in parts]
    ranked = [b for p in thin for b in boosting._ranked(iter([p]), 1)]
    cuts = next(boosting._cuts_of(iter(ranked), shares)).column("cuts").to_pylist()[0]
    ranks = np.searchsorted(order, cuts)
    assert np.abs(ranks - [q * len(order) for q in shares]).max() <= len(order) * (1 / 100 + 1 / 200 * 12)


def test_thinned_values_keep_counts():
    values, counts = boosting._thinned(np.arange(1000.0), np.ones(1000, np.int64), 500)
    assert counts.sum() == 1000 and len(values) <= 501 and values[-1] == 999
    assert (np.cumsum(counts) - 1 == values).all()  # the rank of each kept value is exact
