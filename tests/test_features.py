from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.operators import notes, oversample, preprocess
from staywise.operators.clean import prefixed_columns
from staywise.plans.feature_build import build_features, wide_features
from staywise.session import new_folder, written
from staywise.sources.schema import ENRICHED_SCHEMA, struct_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sample_rows(n=60):
    """Cyclic customers with a note; tenure, charges and label vary."""
    from conftest import CUSTOMER

    rows = []
    for i in range(n):
        row = {
            **CUSTOMER,
            "customerID": f"C{i:03d}",
            "tenure": [12, 1, 0, 72, 50][i % 5],
            "TotalCharges": " " if i % 5 == 2 else str(i * 10.5),
            "Contract": fv.CONTRACTS[i % 3],
            "Churn": ["Yes", "No", "Yes", "No", "No"][i % 5],
            "ticket_note": f"customer {i} called about invoice number {i % 7} and topic {i % 3}",
            "primary_sentiment_tag": "Neutral",
        }
        rows.append(tuple(row[f.name] for f in ENRICHED_SCHEMA))
    return rows


@pytest.fixture(scope="module")
def enriched(spark):
    return spark.createDataFrame(sample_rows(), ENRICHED_SCHEMA).repartition(3)


def test_fit_and_apply(spark, make_customers):
    train = make_customers(
        {"tenure": 1, "MonthlyCharges": 10.0, "TotalCharges": "5"},
        {"tenure": 3, "MonthlyCharges": 20.0, "TotalCharges": " ", "Contract": "One year"},
        {"tenure": 8, "MonthlyCharges": 60.0, "TotalCharges": "25", "Contract": None},
        {"tenure": 4, "MonthlyCharges": 10.0, "TotalCharges": "9"},
    )
    fitted = preprocess.fit_structured(train)
    assert fitted.numbers["TotalCharges"].median == 9.0
    filled = np.array([5.0, 9.0, 25.0, 9.0])
    assert fitted.numbers["TotalCharges"].mean == pytest.approx(filled.mean())
    assert fitted.numbers["TotalCharges"].spread == pytest.approx(filled.std())
    assert fitted.categories["Contract"] == ["Month-to-month", "One year", "Unknown"]
    assert fitted.names()[:3] == ["num__tenure", "num__MonthlyCharges", "num__TotalCharges"]
    new = make_customers({"TotalCharges": "oops", "Contract": "Two year", "gender": None})
    row = fitted.apply(new, [fv.ID]).first().asDict()
    assert row["num__TotalCharges"] == pytest.approx((9.0 - filled.mean()) / filled.std())
    assert [row[f"cat__Contract_{v}"] for v in fitted.categories["Contract"]] == [0.0, 0.0, 0.0]
    assert row["cat__gender_Female"] == 0.0 and row["cat__SeniorCitizen_0"] == 1.0


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "a double, b double")
    fitted = preprocess.fit_structured(df, ["a", "b"], [])
    assert fitted.names() == ["num__a"]
    assert [r[0] for r in fitted.apply(df, []).collect()] == [0.0, 0.0]


def test_structured_transform_round_trip(spark, enriched):
    fitted = preprocess.fit_structured(enriched)
    path = new_folder(spark, "structured")
    fitted.save(spark, path)
    assert preprocess.StructuredTransform.load(spark, path) == fitted


def test_transform_stays_in_the_jvm(enriched):
    fitted = preprocess.fit_structured(enriched)
    plan = fitted.apply(written(enriched, "enriched"), [fv.ID])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "WholeStageCodegen" in plan or "*(1)" in plan


def test_feature_build(spark, enriched):
    build = build_features(enriched, components=4, width=64)
    wide = wide_features(build)
    assert wide.count() == enriched.count() and wide.select(fv.ID).distinct().count() == enriched.count()
    assert not any("sentiment" in c for c in wide.columns)
    names = prefixed_columns(wide, fv.TEXT_PREFIXES)
    assert names == [f"nlp__pca{i}" for i in range(4)]
    train = wide.where("split = 'train'")
    means = train.agg(*[F.avg(f"`{c}`") for c in ["num__tenure", "num__MonthlyCharges", *names]]).first()
    assert np.allclose(list(means), 0.0, atol=1e-9)
    whole = preprocess.fit_structured(enriched)
    assert whole.numbers != build.structured.numbers


def test_components_match_a_direct_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2.0, 1.0, (80, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    from staywise.functions.vectors import as_vector

    vectors = df.withColumn("v", as_vector(F.col("x"))).repartition(3)
    pca, mean = notes.fit_pca(vectors, "v", 3)
    got = notes.TextTransform(pca, mean, width=6).reduce(vectors, "v", "z").orderBy("id").select("z").collect()
    centred = x - x.mean(axis=0)
    directions = np.linalg.svd(centred, full_matrices=False)[2][:3]
    signs = np.sign(directions[np.arange(3), np.abs(directions).argmax(axis=1)])
    np.testing.assert_allclose([r["z"] for r in got], centred @ (directions * signs[:, None]).T, atol=1e-8)


def letters():
    """An encoder by letter counts."""
    return lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]


def down():
    raise ConnectionError("no encoder")


def test_plugged_encoder_and_its_failure(spark, enriched):
    fitted = notes.fit_notes(enriched, components=2, width=5, factory=letters)
    rows = fitted.apply(enriched.select(fv.ID, fv.NOTE)).collect()
    assert all(r["nlp_available"] and len(r["nlp_vector"]) == 2 for r in rows)
    path = new_folder(spark, "text")
    fitted.save(spark, path)
    again = notes.TextTransform.load(spark, path, letters).apply(enriched.select(fv.ID, fv.NOTE))
    assert {r[fv.ID]: r["nlp_vector"] for r in again.collect()} == {r[fv.ID]: r["nlp_vector"] for r in rows}
    fitted.factory = down
    failed = fitted.apply(enriched.select(fv.ID, fv.NOTE)).collect()
    assert all(not r["nlp_available"] and list(r["nlp_vector"]) == [0.0, 0.0] for r in failed)


def test_default_encoder_round_trip(spark, enriched):
    fitted = notes.fit_notes(enriched, components=3, width=32)
    path = new_folder(spark, "text")
    fitted.save(spark, path)
    loaded = notes.TextTransform.load(spark, path)
    a = {r[fv.ID]: r["nlp_vector"] for r in fitted.apply(enriched).collect()}
    assert a == {r[fv.ID]: r["nlp_vector"] for r in loaded.apply(enriched).collect()}
    empty = spark.createDataFrame([("x", None), ("y", "")], "customerID string, ticket_note string")
    assert len({tuple(r["nlp_vector"]) for r in fitted.apply(empty).collect()}) == 1


def test_tokens_cover_every_script(spark):
    got = spark.createDataFrame([("Élan, l'été — 42 ok_go! ",)], "t string").select(notes.tokens(F.col("t"))).first()[0]
    assert got == ["élan", "l", "été", "42", "ok_go"]


def points_frame(spark, x):
    return spark.createDataFrame(
        [(f"p{i:04d}", [float(v) for v in r], 1) for i, r in enumerate(x)], "pid string, x array<double>, copies bigint"
    ).repartition(3)


@pytest.mark.parametrize(("chunk", "slice_rows"), [(20000, 20000), (500, 500), (7, 5)])
def test_neighbours_are_exact(spark, monkeypatch, chunk, slice_rows):
    monkeypatch.setattr(oversample, "_CELL_ROWS", 1000 if chunk > 1000 else 14)
    monkeypatch.setattr(oversample, "_CHUNK_ROWS", chunk)
    monkeypatch.setattr(oversample, "_SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(4)
    crowd = rng.normal(0, 0.01, (60, 3))
    x = np.concatenate([crowd, rng.normal(0, 3, (100, 3)), rng.uniform(20, 30, (3, 3))])
    df = points_frame(spark, x)
    near = {r["pid"]: [e["distance"] for e in r["near"]] for r in oversample.nearest_neighbours(df, df.select("pid"), 5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        np.testing.assert_allclose(near[f"p{i:04d}"], np.sort(d[i])[:5], atol=1e-6)


def labelled(spark, x, y):
    rows = [(f"r{i:04d}", [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "customerID string, features array<double>, label bigint").repartition(4)


def test_oversampling_balances_and_interpolates(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (200, 3)), np.array([1] * 54 + [0] * 146)
    df = labelled(spark, x, y)
    grown = oversample.smote(df)
    rows = grown.collect()
    counts = {c: sum(r["label"] == c for r in rows) for c in (0, 1)}
    assert counts == {0: 146, 1: 146}
    kept = {r["customerID"]: list(r["features"]) for r in rows if not r["synthetic"]}
    assert kept == {f"r{i:04d}": list(map(float, v)) for i, v in enumerate(x)}
    minority = x[:54]
    d = np.sqrt(((minority[:, None] - minority[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    for r in rows:
        if r["synthetic"]:
            assert r["label"] == 1 and r["customerID"] is None
            s = np.array(r["features"])
            assert any(
                abs(np.linalg.norm(s - minority[i]) + np.linalg.norm(minority[j] - s) - np.linalg.norm(minority[j] - minority[i])) < 1e-9
                for i in range(54)
                for j in near[i]
            )
    assert sorted(map(tuple, (r["features"] for r in grown.collect()))) == sorted(map(tuple, (r["features"] for r in rows)))


def test_oversampling_with_a_third_identical(spark, monkeypatch):
    monkeypatch.setattr(oversample, "_BLOCK_DRAWS", 8)
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (160, 2))
    x[:20] = 1.5
    x[20:23] = -2.5
    y = np.array([1] * 60 + [0] * 100)
    rows = oversample.smote(labelled(spark, x, y)).where("synthetic").collect()
    assert len(rows) == 40
    from_crowd = [r for r in rows if list(r["features"]) == [1.5, 1.5]]
    # Twenty identical rows take about a third of the draws and only have each other as neighbours.
    assert 6 <= len(from_crowd) <= 22


def test_oversampling_needs_enough_rows(spark):
    with pytest.raises(ValueError):
        oversample.smote(labelled(spark, np.zeros((20, 2)), [1] * 3 + [0] * 17))
    balanced = oversample.smote(labelled(spark, np.arange(40).reshape(20, 2), [1] * 10 + [0] * 10))
    assert balanced.count() == 20


def test_schema_builder():
    assert [f.dataType.simpleString() for f in struct_of({"a": "str", "b": "int", "c": "float"})] == ["string", "bigint", "double"]
    for bad in ({}, {"a": "date"}):
        with pytest.raises(ValueError):
            struct_of(bad)


def test_a_failing_encoder_fits_nothing(spark):
    def factory():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise ConnectionError("down")
            return [[float(len(t)), 1.0, 0.0] for t in texts]

        return encode

    rows = spark.createDataFrame([("one",), ("three",), ("bad",)], "ticket_note string")
    with pytest.raises(notes.EncoderUnavailable):
        notes.fit_notes(rows.repartition(1), components=2, width=3, factory=factory)
    assert notes.fit_notes(rows.where("ticket_note <> 'bad'"), components=2, width=3, factory=factory).components == 2


def test_neighbours_of_a_bounded_sample(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    points = spark.createDataFrame([(str(i), [float(v) for v in r], 1) for i, r in enumerate(x)], "pid string, x array<double>, copies bigint")
    whole = {r["pid"]: [e["near"] for e in r["near"]] for r in oversample.neighbours_among(points, points.select("pid"), 5, 1000).collect()}
    distances = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    np.fill_diagonal(distances, np.inf)
    assert all(whole[str(i)] == [str(j) for j in np.argsort(distances[i])[:5]] for i in range(300))
    part = oversample.neighbours_among(points, points.select("pid"), 5, 50).collect()
    used = {e["near"] for r in part for e in r["near"]}
    assert len(part) == 300 and len(used) <= 50
    for r in part[:20]:
        i = int(r["pid"])
        allowed = sorted((distances[i][int(j)], j) for j in used if int(j) != i)
        assert [e["distance"] for e in r["near"]] == pytest.approx([d for d, _ in allowed[:5]])


def test_synthetic_rows_lie_between_two_of_their_class(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(40, 3)), rng.normal(size=(90, 3)) + 9])
    y = [1] * 40 + [0] * 90
    grown = oversample.smote(labelled(spark, x, y), max_points=25).where("synthetic").collect()
    assert len(grown) == 50
    minority = x[:40]
    for r in grown:
        p = np.array(r["features"])
        a, b = minority[:, None], minority[None, :]
        along = np.clip(((p - a) * (b - a)).sum(-1) / np.maximum(((b - a) ** 2).sum(-1), 1e-300), 0, 1)
        off = np.linalg.norm(a + along[..., None] * (b - a) - p, axis=-1)
        assert off.min() < 1e-9


def test_oversampling_searches_all_points_at_every_size(spark, monkeypatch):
    # Six points far from the crowd: a sample of fifteen misses most of them and would aim at the crowd.
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(90, 3)), rng.normal(size=(6, 3)) + 1000, rng.normal(size=(200, 3))])
    y = [1] * 96 + [0] * 200
    monkeypatch.setattr(fv, "MAX_NEIGHBOUR_POINTS", 15)
    monkeypatch.setattr(oversample, "_CELL_ROWS", 12)
    among = oversample.neighbours_among
    monkeypatch.setattr(oversample, "neighbours_among", lambda points, requests, k, bound, seed: among(points, requests, k, min(bound, 15), seed))
    grown = oversample.smote(labelled(spark, x, y)).where("synthetic").collect()
    assert len(grown) == 104
    minority = x[:96]
    d = np.linalg.norm(minority[:, None] - minority[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    ends = [(minority[i], minority[j]) for i in range(96) for j in near[i]]
    for r in grown:
        s = np.array(r["features"])
        assert min(np.linalg.norm(s - a) + np.linalg.norm(b - s) - np.linalg.norm(b - a) for a, b in ends) < 1e-9


def test_boxes_rule_most_points_out(monkeypatch):
    """Numbers beside zeros and ones: requests find their exact neighbours while they look at few of the points."""
    rng = np.random.default_rng(11)
    x = np.hstack([rng.normal(size=(6000, 2)), (rng.random((6000, 12)) < 0.5) * 1.0])
    splits = oversample.Splits.of(x[:1500], 8)
    cell = splits.cell(x)
    assert splits.cells > 150 and set(cell.tolist()) <= set(range(splits.cells))
    low, high = np.full((2, splits.cells, 14), np.nan)
    for c in np.unique(cell):
        low[c], high[c] = x[cell == c].min(axis=0), x[cell == c].max(axis=0)
    pid = np.array([f"p{i}" for i in range(6000)], dtype=object)
    group, seen, plain = oversample._Group(0, 5, low, high), [], oversample._distances
    monkeypatch.setattr(oversample, "_distances", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    homes = np.unique(cell)[:20]
    rows = np.concatenate([np.flatnonzero(cell == c) for c in homes])
    for c in homes:
        own = cell == c
        group.add(int(c), pid[own], x[own], np.full((own.sum(), 5), np.inf), np.full((own.sum(), 5), None, object), np.zeros((own.sum(), 5), np.int64))
    for c in (*homes, *np.setdiff1d(np.unique(cell), homes)):
        own = cell == c
        group.meet(int(c), pid[own], x[own], np.ones(own.sum(), np.int64))
    d = np.linalg.norm(x[rows][:, None] - x[None], axis=2)
    d[np.arange(len(rows)), rows] = np.inf
    np.testing.assert_allclose(group.distance, np.sort(d, axis=1)[:, :5], atol=1e-6)
    assert sum(seen) < 0.3 * len(rows) * 6000
    batch = next(group.found())
    assert batch.num_rows == len(rows) and batch.column("pid").to_pylist() == pid[rows].tolist()


def test_requests_are_dealt_to_groups_of_bounded_size():
    dealt = oversample._grouped({0: 3, 1: 4, 2: 25, 3: 1, 5: 8}, 10)
    assert dealt == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (5, 4, 1)]


def test_rows_that_found_nothing_yet_travel_without_null_lists(spark):
    lists = spark.range(1).select(*oversample._nothing())
    assert [c.nullable for c in lists.schema] == [False] * 3 and lists.first() == ([], [], [])
