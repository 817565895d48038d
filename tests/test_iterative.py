"""Fold-batched iterative fits against closed forms, exact solutions and finite differences."""

import uuid
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedside.operators import batched, kernels, networks, newton, perceptrons
from bedside.operators.fold_models import fit_folds
from bedside.operators.models import apply_model, fit_classifier, fit_regressor

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 1200
    x = rng.normal([5, 0.5, 8], [2, 0.1, 3], (n, 3))
    y = 3 + x @ [1.5, -20.0, 0.3] + 0.4 * x[:, 0] ** 2 + rng.normal(0, 1, n)
    return x, y, np.arange(n) % 4


@pytest.fixture(scope="module")
def frame(spark, table, tmp_path_factory):
    x, y, fold = table
    data = pd.DataFrame(x, columns=FEATURES).assign(
        id=range(len(y)), label=y, fold=fold.astype(np.int32), two=(y > np.median(y)).astype(float),
        four=np.digitize(y, np.quantile(y, [0.2, 0.5, 0.8])).astype(float),
    )
    path = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame(data).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def relabelled(frame, column):
    return frame.drop("label").withColumnRenamed(column, "label")


def jobs(spark, run):
    """Result and number of Spark jobs (an aggregation with AQE may take two)."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_logistic_of_all_folds_equals_one_fit_a_fold(spark, frame):
    rows = relabelled(frame, "two")
    scale = batched.scaling(rows, FEATURES)
    fit, n = jobs(spark, lambda: newton.newton_by_fold(rows, scale, newton.logistic, np.ones(4)))
    assert n <= 2 * fit.passes and fit.passes < 15 and fit.gradient.max() < 1e-9
    for fold in (0, 3):
        model = fit_classifier(rows.where(f"fold <> {fold}"), "logistic", FEATURES).stages[-1]
        want = [*model.coefficients, model.intercept]
        assert fit.coefficients[fold, 0] == pytest.approx(want, abs=1e-6)


def test_softmax_of_all_folds_equals_one_fit_a_fold(frame):
    rows = relabelled(frame, "four")
    scale = batched.scaling(rows, FEATURES)
    fit = newton.newton_by_fold(rows, scale, newton.softmax, np.ones(4), classes=4)
    assert fit.gradient.max() < 1e-9
    model = fit_classifier(rows.where("fold <> 1"), "multi", FEATURES).stages[-1]
    assert fit.coefficients[1, :, :-1] == pytest.approx(model.coefficientMatrix.toArray(), abs=2e-4)
    # intercepts are settled up to a common shift
    got, want = fit.coefficients[1, :, -1], model.interceptVector.toArray()
    assert got - got.mean() == pytest.approx(want - want.mean(), abs=2e-4)


def test_newton_does_not_depend_on_partitions_and_takes_all_rows(frame, table):
    rows = relabelled(frame, "two")
    one, many = (newton.newton_by_fold(r, batched.scaling(r, FEATURES), newton.logistic, np.ones(4)) for r in (rows.coalesce(1), rows.repartition(7)))
    assert one.coefficients == pytest.approx(many.coefficients, abs=1e-9)
    scale = batched.scaling(rows, FEATURES, by_fold=False)
    fit = newton.newton_by_fold(rows, scale, newton.logistic, np.ones(1))
    x, y, _ = table
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    w = fit.coefficients[0, 0]
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - (y > np.median(y))) + w * [1, 1, 1, 0]
    assert scale.models == (batched.ALL,) and np.abs(slope).max() < 1e-6


@pytest.mark.parametrize("loss", [newton.logistic, newton.Ramp("hinge", 0, 0.3), newton.Ramp("insensitive", 0.1, 0.3), newton.softmax])
def test_losses_against_finite_differences(loss):
    rng = np.random.default_rng(1)
    k = 3 if loss is newton.softmax else 1
    margin = rng.normal(size=(40, k))
    target = rng.integers(0, 2, 40).astype(float) * (2 if isinstance(loss, newton.Ramp) else 1) - isinstance(loss, newton.Ramp)
    value, first, second = loss(margin, target)
    for a in range(k):
        step = np.zeros(k)
        step[a] = 1e-6
        up, down = loss(margin + step, target), loss(margin - step, target)
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(first[:, a], abs=1e-6)
        assert (up[1] - down[1]) / 2e-6 == pytest.approx(second[:, a], abs=1e-4)


def test_halved_steps_find_the_minimum(frame):
    # a start far away, where full Newton steps overshoot
    rows = relabelled(frame, "two")
    scale = batched.scaling(rows, FEATURES)
    far = np.full((4, 1, 4), 8.0) * [1, -1, 1, -1]
    fit = newton.newton_by_fold(rows, scale, newton.logistic, np.ones(4), start=far)
    want = newton.newton_by_fold(rows, scale, newton.logistic, np.ones(4))
    assert fit.coefficients == pytest.approx(want.coefficients, abs=1e-6)


# --- networks ----------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes, loss, classes", [((3, 6, 3, 1), networks.squared, None), ((3, 5, 1), networks.cross_entropy, 2), ((3, 4, 4, 4), networks.cross_entropy, 4)])
def test_gradients_against_finite_differences(sizes, loss, classes):
    rng = np.random.default_rng(0)
    flat = np.stack([networks.glorot(sizes, k) for k in (1, 2)]) + 0.1
    z, weight = rng.normal(size=(2, 9, 3)), rng.integers(0, 2, (2, 9)).astype(float)
    target = rng.integers(0, classes, (2, 9)).astype(float) if classes else rng.normal(size=(2, 9))
    value, slope = networks.loss_and_gradient(flat, sizes, z, target, weight, loss)
    for i in range(flat.shape[1]):
        moved = [flat + s * 1e-6 * (np.arange(flat.shape[1]) == i) for s in (1, -1)]
        up, down = (networks.loss_and_gradient(f, sizes, z, target, weight, loss)[0] for f in moved)
        assert (up - down) / 2e-6 == pytest.approx(slope[:, i], abs=1e-6)


def errors(predicted, y):
    return float(np.sqrt(np.mean((predicted - y) ** 2)))


@pytest.mark.parametrize("shard_rows", [50_000, 300])
def test_network_beats_the_linear_fit_out_of_fold(spark, frame, table, shard_rows):
    x, y, fold = table
    scale = batched.scaling(frame, FEATURES, "label")
    trained, n = jobs(spark, lambda: networks.train_by_fold(frame, scale, (6, 3), ["id"], rounds=8, shard_rows=shard_rows))
    assert trained.rounds <= 8 and n <= 4 * (trained.rounds + 1) + 8  # not one for each fold and mini-batch
    assert (trained.history.min(axis=0) < 0.3 * trained.history[0]).all()

    def predict(g, x):
        out = networks.forward(trained.state[g : g + 1], (3, 6, 3, 1), scale.inputs(g, x)[None])[-1][0, :, 0]
        return out * scale.label_spread[g] + scale.label_center[g]

    scored = batched.with_predictions(frame, FEATURES, scale.models, predict, ["predicted"]).toPandas()
    assert len(scored) == len(y) and scored["predicted"].notna().all()
    linear = np.zeros(len(y))
    for g in range(4):
        own = fold != g
        w = np.linalg.lstsq(np.c_[x[own], np.ones(own.sum())], y[own], rcond=None)[0]
        linear[~own] = np.c_[x[~own], np.ones((~own).sum())] @ w
    assert errors(scored["predicted"], scored["label"]) < 0.8 * errors(linear, y)


def test_training_is_the_same_however_rows_are_partitioned(frame):
    scale = batched.scaling(frame, FEATURES, "label")
    one, two = (networks.train_by_fold(r, scale, (4,), ["id"], rounds=2, shard_rows=200) for r in (frame.coalesce(1), frame.repartition(6)))
    assert one.state == pytest.approx(two.state, rel=1e-6, abs=1e-9)


def test_a_model_learns_nothing_from_its_own_fold(frame):
    scale = batched.scaling(frame, FEATURES, "label")
    spoiled = frame.withColumn("label", F.expr("CASE WHEN fold = 2 THEN 1e6 ELSE label END"))
    a, b = (networks.train_by_fold(r, scale, (4,), ["id"], rounds=2) for r in (frame, spoiled))
    assert a.state[2] == pytest.approx(b.state[2]) and not np.allclose(a.state[1], b.state[1])


def test_averaged_descent_comes_to_the_closed_form(frame, table):
    x, y, fold = table
    scale = batched.scaling(frame, FEATURES, "label")
    steps = networks.Steps("sgd", rate=0.2, penalty=1e-4, batch=20, round_rows=30_000)
    trained = networks.train_by_fold(frame, scale, (), ["id"], steps=steps, rounds=6, held_share=0)
    for g in (0, 2):
        own = fold != g
        z, t = scale.inputs(g, x[own]), scale.targets(g, y[own])
        want = np.linalg.solve(z.T @ z + 1e-4 * len(t) * np.eye(3), z.T @ t)
        assert trained.state[g, :3] == pytest.approx(want, abs=0.02)
        assert trained.state[g, 3] == pytest.approx(0, abs=0.02)


# --- kernel machines ---------------------------------------------------------------------------


def exact(kernel, target, cost, tube=None):
    """Least primal objective of a support vector machine, by pairwise steps on its dual."""
    if tube is None:
        sign, linear, at = target, -np.ones(len(target)), np.arange(len(target))
    else:
        n = len(target)
        sign, at = np.repeat([1.0, -1.0], n), np.tile(np.arange(n), 2)
        linear = np.concatenate([tube - target, tube + target])
    q = kernel[np.ix_(at, at)] * np.outer(sign, sign)
    alpha, slope = np.zeros(len(sign)), linear.copy()
    for _ in range(40_000):
        up = ((sign > 0) & (alpha < cost)) | ((sign < 0) & (alpha > 0))
        low = ((sign < 0) & (alpha < cost)) | ((sign > 0) & (alpha > 0))
        score = -sign * slope
        i, j = np.where(up, score, -np.inf).argmax(), np.where(low, score, np.inf).argmin()
        if score[i] - score[j] < 1e-3:
            break
        curve = max(q[i, i] + q[j, j] - 2 * sign[i] * sign[j] * q[i, j], 1e-12)
        step = (score[i] - score[j]) / curve
        step = min(step, cost - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else cost - alpha[j])
        alpha[i] += sign[i] * step
        alpha[j] -= sign[j] * step
        slope += q[:, i] * sign[i] * step - q[:, j] * sign[j] * step
    return -(alpha @ q @ alpha / 2 + linear @ alpha)


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_machines_against_the_exact_kernel_solution(spark, table, kind):
    x, y, _ = table
    x, y = x[:400], y[:400]
    label = y if kind == "regression" else (y > np.median(y)).astype(float)
    data = pd.DataFrame(x, columns=FEATURES).assign(label=label, fold=np.int32(0))
    rows = spark.createDataFrame(data)
    scale = batched.scaling(rows, FEATURES, "label" if kind == "regression" else None, by_fold=False)
    machine = kernels.fit_machines(rows, scale, kind, many=120)
    z, w = scale.inputs(0, x), machine.fit.coefficients[0, 0]
    margin = machine.margin(scale, 0, x)
    gauss = kernels._gauss(z, z, 1 / 3)
    if kind == "regression":
        t = scale.targets(0, label)
        lost = np.maximum(np.abs(margin - t) - kernels.TUBE, 0).sum()
        want = exact(gauss, t, 1.0, kernels.TUBE)
    else:
        lost = np.maximum(1 - (2 * label - 1) * margin, 0).sum()
        want = exact(gauss, 2 * label - 1, 1.0)
        assert machine.odds[0, 0] > 0 and ((margin * machine.odds[0, 0] + machine.odds[0, 1] > 0) == label).mean() > 0.9
    assert lost + (w[:-1] ** 2).sum() / 2 == pytest.approx(want, rel=0.02)


def test_landmarks_cover_the_rows(frame, table):
    x = table[0]
    scale = batched.scaling(frame, FEATURES, by_fold=False)
    points = kernels.landmarks(frame, FEATURES, scale.center[0], scale.spread[0], 20)
    again = kernels.landmarks(frame.coalesce(1), FEATURES, scale.center[0], scale.spread[0], 20)
    z = scale.inputs(0, x)

    def radius(points):
        return np.sqrt(((z[:, None] - points) ** 2).sum(axis=2).min(axis=1).max())

    best = radius(z[kernels.farthest(z, 20)])
    assert len(points) == 20 and radius(points) < 2 * best and radius(again) < 2 * best
    assert len(kernels.farthest(np.repeat(z[:3], 5, axis=0), 20)) == 3 and len(kernels.farthest(z[:0], 3)) == 0


def test_shards_side_by_side_move_as_alone():
    rng = np.random.default_rng(4)
    sizes, steps = (3, 4, 1), networks.Steps(batch=20)
    scale = batched.Scaling(tuple(FEATURES), (0, 1), np.array([[0.0, 1, 2], [1, 1, 1]]), np.full((2, 3), 2.0), np.ones(2), np.zeros(2), np.ones(2))
    state, full = np.stack([networks.glorot(sizes, k) for k in (1, 2)]), [130, 70, 95]
    x, y = rng.normal(size=(3, 130, 3)), rng.integers(0, 2, (3, 130)).astype(float)
    weight = np.stack([np.where(np.arange(130) < n, np.arange(130) % 2 == np.arange(2)[:, None], 0) for n in full]).astype(float)

    def moved(own):
        out = networks.Shards(len(own), state, np.zeros((2, *state.shape)), sizes, networks.cross_entropy, steps, 0.01, np.zeros(2))
        n = max(full[s] for s in own)
        out.learn(x[own, :n], y[own, :n], weight[own, :, :n], scale, [np.random.default_rng([1, s]) for s in own], 2)
        return out.result()

    assert moved([0, 1, 2]) == pytest.approx(sum(moved([s]) for s in range(3)), rel=1e-9, abs=1e-12)
    assert moved([0, 1, 2])[:, 0] == pytest.approx(2 * weight.sum(axis=(0, 2)) / 2)


@pytest.mark.parametrize("shard_rows, held_rows", [(200, 10_000), (200, 500), (200, 10)])
def test_training_does_not_depend_on_how_many_shards_go_side_by_side(frame, monkeypatch, shard_rows, held_rows):
    scale = batched.scaling(frame, FEATURES, "label")
    want = networks.train_by_fold(frame, scale, (4,), ["id"], rounds=2, shard_rows=shard_rows)
    monkeypatch.setattr(networks, "HELD_ROWS", held_rows)
    got = networks.train_by_fold(frame, scale, (4,), ["id"], rounds=2, shard_rows=shard_rows)
    assert got.state == pytest.approx(want.state, rel=1e-9) and got.history == pytest.approx(want.history, rel=1e-9)


def test_newton_on_inputs_turned_by_the_driver(frame):
    rows = relabelled(frame, "two")
    scale = batched.scaling(rows, FEATURES)
    turn = np.array([[1.0, 0.5], [0.0, 2.0], [-1.0, 1.0]])
    for loss in (newton.logistic, newton.Ramp("hinge", 0.0, 0.5)):
        options = {"width": 2, "targets": lambda g, y: y if loss is newton.logistic else 2 * y - 1}
        got = newton.newton_by_fold(rows, scale, loss, np.ones(4), inputs=scale.inputs, turn=turn, **options)
        want = newton.newton_by_fold(rows, scale, loss, np.ones(4), inputs=lambda g, x: scale.inputs(g, x) @ turn, **options)
        assert got.coefficients == pytest.approx(want.coefficients, abs=1e-7)


@pytest.mark.parametrize("loss, k", [(newton.logistic, 1), (newton.softmax, 3), (newton.Ramp("hinge", 0.0, 0.3), 1), (newton.Ramp("insensitive", 0.1, 0.3), 1)])
def test_sums_of_models_that_share_inputs_equal_their_own(loss, k):
    rng = np.random.default_rng(2)
    batch = rng.normal(size=(5000, 3)), rng.integers(0, max(2, k), 5000).astype(float), rng.integers(0, 3, 5000)
    at, args = rng.normal(size=(3, k, 4)), ((0, 1, 2), (0, 2))
    before = rng.normal(size=(3, k, 4)) if isinstance(loss, newton.Ramp) else None
    shared = newton._shared_sums(batch, *args, at, before, lambda x: x, lambda g, y: y, loss)
    own = newton._own_sums(batch, *args, at, before, lambda g, x: x, lambda g, y: y, loss)
    assert shared == pytest.approx(own, rel=1e-9, abs=1e-7)
    if before is not None:
        half = newton._own_sums(batch, *args, (at + before) / 2, None, lambda g, x: x, lambda g, y: y, loss).reshape(2, -1)[:, 0]
        assert own.reshape(2, -1)[:, 1 + 4] == pytest.approx(half, rel=1e-9)


def objective(margin, label, w):
    return np.maximum(1 - (2 * label - 1) * margin, 0).sum() + (w**2).sum() / 2


def test_kernel_huber_of_all_folds_equals_one_fit_a_fold(spark, frame):
    models, n = jobs(spark, lambda: fit_folds(frame, ["id"], "regression", "kernel_huber", FEATURES))
    assert n <= 2 * models.rounds + 5 and models.settled.max() < 1e-6
    got = {r.id: r.predicted for r in models.predict(frame).collect()}
    model = fit_regressor(frame.where("fold <> 2"), "kernel_huber", FEATURES, "label")
    want = {r.id: r.predicted for r in apply_model(model, frame.where("fold = 2")).collect()}
    spread = np.std(list(want.values()))
    assert max(abs(got[i] - v) for i, v in want.items()) < 0.01 * spread
    as_sql = {r.id: r.predicted for r in apply_model(models.pipeline(2), frame.where("fold = 2")).collect()}
    assert max(abs(got[i] - v) for i, v in as_sql.items()) < 1e-8 * spread


def test_kernel_svc_of_all_folds_is_no_worse_than_one_fit_a_fold(spark, frame):
    rows = relabelled(frame, "two")
    models, n = jobs(spark, lambda: fit_folds(rows, ["id"], "classification", "kernel_svc", FEATURES))
    assert n <= 2 * models.rounds + 5
    model = fit_classifier(rows.where("fold <> 2"), "kernel_svc", FEATURES)
    fitted = model.stages[-2]
    learned = rows.where("fold <> 2").toPandas()
    margin = models.outputs(2, learned[FEATURES].to_numpy())[:, 0]
    waves = kernels.Waves.drawn(3, 1, 64)
    z = waves.values(models.scale.inputs(2, learned[FEATURES].to_numpy()))
    label = learned.label.to_numpy()
    w = fitted.coefficients.toArray()
    theirs = objective(z @ w + fitted.intercept, label, w)
    own = np.linalg.lstsq(np.column_stack([z, np.ones(len(z))]), margin, rcond=None)[0][:-1]
    assert objective(margin, label, own) <= 1.01 * theirs
    assert np.maximum(1 - (2 * label - 1) * margin, 0).sum() < len(label) / 2
    got = {r.id: (r.predicted, r.score) for r in models.predict(rows).collect()}
    told = {r.id: (r.predicted, r.score) for r in apply_model(model, rows.where("fold = 2")).collect()}
    assert np.mean([got[i][0] == v[0] for i, v in told.items()]) > 0.97
    assert np.mean([abs(got[i][1] - v[1]) for i, v in told.items()]) < 0.05


@pytest.mark.parametrize("kind, column", [("logistic", "two"), ("svr", "label"), ("kernel_huber", "label")])
def test_a_start_on_a_part_of_the_rows_saves_passes_and_keeps_the_minimum(frame, monkeypatch, kind, column):
    rows = frame if column == "label" else relabelled(frame, column)
    task = "regression" if column == "label" else "classification"
    whole = fit_folds(rows, ["id"], task, kind, FEATURES)
    monkeypatch.setattr(newton, "START_ROWS", 150)
    started = fit_folds(rows, ["id"], task, kind, FEATURES)
    assert started.rounds < whole.rounds
    x = rows.toPandas()[FEATURES].to_numpy()
    for g in range(4):
        want = whole.outputs(g, x)
        assert np.abs(started.outputs(g, x) - want).max() < 1e-3 * want.std()
    assert started.settled.max() < 1e-4


def test_the_spread_of_huber_is_left_out_of_the_inputs(frame):
    scale = batched.scaling(frame, FEATURES, "label")
    machine = kernels.fit_waves(frame, scale, "regression", size=16, seed=1)
    spreads = machine.fit.coefficients[:, 1]
    assert np.abs(spreads[:, :-1]).max() < 1e-12 and (spreads[:, -1] > 0).all()


def test_cosine_by_series():
    angle = np.concatenate([np.linspace(-400, 400, 100_001), np.arange(-8, 9) * np.pi / 2])
    assert np.abs(kernels._cosine(angle.copy()) - np.cos(angle)).max() < 1e-12


def test_huber_against_finite_differences():
    rng = np.random.default_rng(1)
    margin, target = np.column_stack([rng.normal(0, 2, 40), rng.uniform(0.5, 2, 40)]), rng.normal(size=40)
    loss = newton.Huber()
    _, first, second = loss(margin, target)
    for a, step in enumerate(np.eye(2) * 1e-6):
        up, down = loss(margin + step, target), loss(margin - step, target)
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(first[:, a], abs=1e-6)
        assert (up[1] - down[1]) / 2e-6 == pytest.approx(second[:, a], abs=1e-4)
    assert np.isinf(loss(margin * [1, -1], target)[0]).all()


def test_perceptron_gradients(frame):
    rng = np.random.default_rng(2)
    sizes, n = [3, 4, 3, 2], 50
    flat = rng.normal(0, 1, (2, networks.count(sizes)))
    z, target, weight = rng.normal(0, 1, (2, 3, n)), (rng.random(n) < 0.4).astype(float), (rng.random((2, n)) < 0.8).astype(float)
    out = perceptrons.loss_and_gradient(flat, sizes, z, target, weight)
    for g in range(2):
        for j in range(flat.shape[1]):
            near = [flat.copy(), flat.copy()]
            for own, step in zip(near, (1e-5, -1e-5)):
                own[g, j] += step
            high, low = (perceptrons.loss_and_gradient(own, sizes, z, target, weight)[g, 0] for own in near)
            assert out[g, 1 + j] == pytest.approx((high - low) / 2e-5, abs=1e-5)
    far = perceptrons.loss_and_gradient(flat * 1e4, sizes, z, target, weight)
    assert np.isfinite(far).all()


def test_searches_reach_the_lowest_point():
    def told(x):
        return 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])

    search = perceptrons.Search(np.array([-1.2, 1.0]), 200, 1e-12)
    while not search.done:
        search.tell(*told(search.at))
    assert search.point == pytest.approx([1, 1], abs=1e-4) and search.steps < 100
    short = perceptrons.Search(np.array([-1.2, 1.0]), 5, 1e-12)
    while not short.done:
        short.tell(*told(short.at))
    assert short.steps == 5
    with pytest.raises(ValueError, match="null"):
        perceptrons.Search(np.zeros(2), 5, 1e-6).tell(float("nan"), np.zeros(2))


@pytest.mark.parametrize("tasks", [0, 256])
def test_perceptrons_of_all_folds_equal_one_fit_a_fold(spark, frame, table, monkeypatch, tasks):
    monkeypatch.setattr(perceptrons, "FEW_TASKS", tasks)
    monkeypatch.setattr("bedside.operators.fold_models.fit_perceptrons", partial(perceptrons.fit_perceptrons, most=8))
    rows = relabelled(frame, "two")
    models, n = jobs(spark, lambda: fit_folds(rows, ["id"], "classification", "mlp", FEATURES))
    assert n <= 2 * models.rounds + 4 and models.rounds < 30

    x, y, fold = table
    two, sizes, g = (y > np.median(y)).astype(float), [3, 6, 3, 2], 2
    z = models.scale.inputs(g, x)
    search = perceptrons.Search(perceptrons._start(sizes, 1), 8, 1e-6)
    while not search.done:
        loss, *gradient = perceptrons.loss_and_gradient(search.at[None], sizes, z.T[None], two, (fold != fold[g])[None].astype(float))[0] / (fold != fold[g]).sum()
        search.tell(loss, np.array(gradient))
    want = perceptrons.margins(search.point, sizes, z)
    assert models.outputs(g, x)[:, 0] == pytest.approx(want, abs=1e-6)

    scored = models.predict(rows).where("fold = 2").toPandas().set_index("id")
    again = apply_model(models.pipeline(g), rows.where("fold = 2")).toPandas().set_index("id").loc[scored.index]
    assert scored.score.to_numpy() == pytest.approx(again.score.to_numpy(), abs=1e-9)
    assert scored.score.to_numpy() == pytest.approx(1 / (1 + np.exp(-want[scored.index])), abs=1e-6)
    assert (scored.predicted == again.predicted).all()


@pytest.mark.parametrize("kind, column", [("logistic", "two"), ("multi", "four"), ("svc", "two"), ("svr", "label")])
def test_a_start_on_a_part_is_one_job(spark, frame, monkeypatch, kind, column):
    monkeypatch.setattr(newton, "START_ROWS", 150)
    rows = frame if column == "label" else relabelled(frame, column)
    models, n = jobs(spark, lambda: fit_folds(rows, ["id"], "regression" if column == "label" else "classification", kind, FEATURES))
    assert n <= models.rounds + 12  # scaling, landmarks, a start of each fit


def test_a_pass_with_few_numbers_is_one_job(spark, frame):
    rows = relabelled(frame, "two")
    scale = batched.scaling(rows, FEATURES)
    fit, n = jobs(spark, lambda: newton.newton_by_fold(rows, scale, newton.logistic, np.ones(4)))
    assert n == fit.passes


@pytest.mark.parametrize("apart, exact", [(0.0, 1e-12), (1e-4, 1e-11), (1e-2, 1e-11), (3.0, 1e-12)])
def test_kernel_values_of_folds_that_differ_little(apart, exact):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(300, 3)), [[40.0, -3, 2]], np.zeros((1, 3))])
    scale = batched.Scaling(tuple(FEATURES), tuple(range(4)), apart * rng.normal(size=(4, 3)), np.exp(apart * rng.normal(size=(4, 3))), np.ones(4), np.zeros(4), np.ones(4))
    values = kernels.Values(kernels.Kernel.at(rng.normal(size=(20, 3)), 1 / 3), scale)
    of = values.of(x)
    for g in range(4):
        assert of(g) == pytest.approx(values(g, x), rel=exact, abs=1e-300)


def test_tanh_of_any_number():
    z = np.concatenate([np.linspace(-30, 30, 100_001), [-1e300, -800, 0, 800, 1e300, np.inf, -np.inf]])
    out = np.empty_like(z)
    networks._tanh(z.copy(), out)
    assert np.abs(out - np.tanh(z)).max() < 1e-15
    nan = np.array([np.nan])
    networks._tanh(nan, nan)
    assert np.isnan(nan[0])


def test_tasks_have_as_many_shards(frame, monkeypatch):
    kept = []

    def written(df):
        kept.append(df.select("shard", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().collect())
        return df.localCheckpoint()

    monkeypatch.setattr(networks, "written", written)
    monkeypatch.setattr(networks, "remove", lambda df: None)
    networks.train_by_fold(frame, batched.scaling(frame, FEATURES, "label"), (2,), ["id"], rounds=1, shard_rows=60)
    (tasks,) = kept
    assert sum(r["count"] for r in tasks) == 20 and len(tasks) == 8 and max(r["count"] for r in tasks) == 3


@pytest.mark.parametrize("kind, column", [("svr", "label"), ("multi", "four")])
def test_parts_that_grow_keep_the_minimum(frame, monkeypatch, kind, column):
    rows = frame if column == "label" else relabelled(frame, column)
    task = "regression" if column == "label" else "classification"
    whole = fit_folds(rows, ["id"], task, kind, FEATURES)
    monkeypatch.setattr(newton, "START_ROWS", 50)
    monkeypatch.setattr(newton, "MORE", 4)
    grown = fit_folds(rows, ["id"], task, kind, FEATURES)
    x = rows.toPandas()[FEATURES].to_numpy()
    assert grown.rounds < whole.rounds and grown.settled.max() < 1e-4
    if kind == "svr":
        want = whole.outputs(1, x)
        assert np.abs(grown.outputs(1, x) - want).max() < 1e-3 * want.std()
    else:
        assert (grown.values(1, x) == whole.values(1, x)).all()
