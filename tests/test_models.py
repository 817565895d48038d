"""Fitted models against closed forms, and iterative ones against trivial predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedside.operators.folds import fold_moments, solve_linear, zscore_exprs
from bedside.operators.models import apply_model, fit_classifier, fit_regressor
from bedside.plans.evaluation_runs import (
    cross_validate, fit_final, fold_metrics, run_grid, score, summarize,
)
from bedside.sources.models import Variant

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = rng.normal([5, 0.5, 8], [2, 0.1, 3], (400, 3))
    x[:, 2] = np.round(x[:, 2])
    y = 3 + x @ [1.5, -20.0, 0.3] + 0.4 * x[:, 0] ** 2 + rng.normal(0, 1, 400)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, table):
    x, y = table
    data = [(i, *map(float, r), float(v), float(v > np.median(y))) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, label double").cache()


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def predictions(model, frame, column="predicted"):
    return np.array([r[0] for r in apply_model(model, frame).orderBy("id").select(column).collect()])


def ridge(x, y, alpha):
    z, t = scaled(x), scaled(y)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ t)
    return z @ w * y.std() + y.mean()


@pytest.mark.parametrize("kind, alpha", [("linear", 0.0), ("ridge", 1.0), ("sgd", 0.04)])
def test_linear_models_match_closed_form(frame, table, kind, alpha):
    x, y = table
    want = ridge(x, y, alpha)
    model = fit_regressor(frame, kind, FEATURES, "y")
    assert predictions(model, frame) == pytest.approx(want, abs=1e-6)
    everything, _ = fold_moments(frame.withColumn("fold", F.lit(0)), [*FEATURES, "y"])
    coefficients, intercept = solve_linear(everything, FEATURES, "y", alpha)
    assert x @ [coefficients[f] for f in FEATURES] + intercept == pytest.approx(want, abs=1e-8)


def test_logistic_matches_newton(frame, table):
    x, y = table
    z = np.hstack([scaled(x), np.ones((len(x), 1))])
    t = (y > np.median(y)).astype(float)
    w, penalty = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - t) + penalty @ w)
    model = fit_classifier(frame, "logistic", FEATURES)
    assert predictions(model, frame, "score") == pytest.approx(1 / (1 + np.exp(-z @ w)), abs=1e-5)


def test_ridge_classifier_matches_closed_form(frame, table):
    x, y = table
    z, t = scaled(x), np.where(y > np.median(y), 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (t - t.mean()))
    model = fit_classifier(frame, "ridge", FEATURES)
    assert predictions(model, frame, "score") == pytest.approx(z @ w + t.mean(), abs=1e-6)


@pytest.mark.parametrize("kind", ["kernel_huber", "gbt"])
def test_regressors_beat_the_mean(frame, table, kind):
    _, y = table
    got = predictions(fit_regressor(frame, kind, FEATURES, "y"), frame)
    assert np.sqrt(np.mean((got - y) ** 2)) < 0.6 * y.std()


@pytest.mark.parametrize("kind", ["sgd", "kernel_svc", "mlp", "multi"])
def test_classifiers_beat_the_majority(frame, table, kind):
    _, y = table
    got = predictions(fit_classifier(frame, kind, FEATURES), frame)
    assert np.mean(got == (y > np.median(y))) > 0.75


def test_scaling_round_trip_and_constant_column(spark):
    df = spark.createDataFrame([(0, 1.0, 7.0), (0, 2.0, 7.0), (1, 4.0, 7.0)], "fold int, x double, k double")
    m, outside = fold_moments(df, ["x", "k"])
    assert m.spread("k") == 1.0 and m.spread("x") == pytest.approx(np.std([1, 2, 4]))
    assert outside[0].center("x") == 4.0 and outside[1].center("x") == pytest.approx(1.5)
    z = zscore_exprs(m, ["x"])["x"]
    assert [r[0] for r in df.select(z * m.spread("x") + m.center("x")).collect()] == pytest.approx([1, 2, 4])


KEY = ["visit"]


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    from checks.inputs import source

    return source(spark, sf_dir, "samples").withColumn("visit", F.monotonically_increasing_id()).cache()


def test_cross_validation_scores_every_row_once(samples):
    variant = Variant("classification", "logistic")
    out = cross_validate(samples, KEY, variant, k=3)
    assert out.count() == out.select("visit").distinct().count() > 0
    wide = {r["metric"] for r in fold_metrics(out, variant).collect()}
    assert {"roc_auc", "average_precision", "bic", "f1", "accuracy"} <= wide


def test_grid_covers_all_variants(samples):
    summary = summarize(run_grid(samples, KEY, "regression", ["linear", "ridge"], k=3))
    assert summary.count() == 2 * 2 * 2 * 2 and {r["folds"] for r in summary.collect()} == {3}


def test_saved_model_scores_like_the_fitted_one(samples, tmp_path):
    variant = Variant("regression", "linear", seven_features=True, filter_spo2=True)
    model = fit_final(samples, KEY, variant, str(tmp_path))
    assert (tmp_path / "regression/filtered/linear/7f").is_dir()
    rows = samples.where("Map IS NOT NULL")
    want = apply_model(model, rows).agg(F.sum(F.rint(F.col("predicted") * 100) / 100)).first()[0]
    got = score(rows, str(tmp_path), variant).agg(F.sum("predicted")).first()[0]
    assert got == pytest.approx(want)


def test_boosted_trees_grow_on_cells_as_on_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 12, 3000), rng.integers(0, 7, 3000), rng.integers(0, 2, 3000)]).astype(float)
    y = x[:, 0] ** 2 + 5 * x[:, 1] * x[:, 2] + rng.normal(0, 1, 3000)
    data = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    got = predictions(fit_regressor(data, "gbt", FEATURES, "y"), data)
    assert seen == [len(np.unique(x, axis=0))]  # before: one training row for every row
    centred = data.withColumn("t", (F.col("y") - float(y.mean())) / float(y.std()))
    plain = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="v"), GBTRegressor(featuresCol="v", labelCol="t", predictionCol="p", maxIter=20, maxDepth=5, seed=1)])
    want = np.array([r[0] for r in plain.fit(centred).transform(centred).orderBy("id").select("p").collect()]) * y.std() + y.mean()
    assert got == pytest.approx(want, abs=1e-6)


def test_bin_edges_cut_many_values_at_quantiles_and_few_between_them(spark):
    from bedside.operators.models import bin_edges

    data = spark.range(10_000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 3 * 2.0).alias("b"), F.lit(1.0).alias("c"))
    many, few, one = bin_edges(data, ["a", "b", "c"])
    assert len(many) == 31 and many == pytest.approx([10_000 * i / 32 for i in range(1, 32)], abs=20)
    assert few == [1.0, 3.0] and one == []
