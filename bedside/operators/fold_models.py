"""Models that are fitted for all folds together, their out-of-fold predictions, and the same models as SQL.

``fit_folds`` trains one model for each fold on the rows outside of it (or one on all rows); ``predict`` scores every row
by the model that has not seen it, in one pass. A model of all rows becomes a pipeline of SQL stages over the raw
features, so it is saved, loaded and applied without Python in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from .batched import Scaling, scaling, with_predictions
from .kernels import fit_machines, fit_waves
from .models import HIDDEN_LAYERS, INVERSE_PENALTY, KERNEL_FEATURES, SGD_PENALTY
from .networks import Steps, count, forward, train_by_fold, unpack
from .newton import logistic, newton_in_turn, softmax
from .perceptrons import fit_perceptrons, margins

FOLD_REGRESSORS = ("descent", "svr", "kernel_huber", "network")
FOLD_CLASSIFIERS = ("logistic", "sgd", "multi", "descent", "svc", "kernel_svc", "mlp", "network")
# Hidden layers by task and number of features, and classes of the severity label.
HIDDEN = {
    ("regression", 3): (6, 3), ("regression", 7): (16, 8, 5),
    ("classification", 3): (6, 3), ("classification", 7): (12, 8, 6, 4, 4),
}
CLASSES = 4


@dataclass
class FoldModels:
    """Fitted models, one for each entry of ``scale.models``.

    ``outputs``: raw outputs (rows x k) of model g. ``settled``: largest gradient entry per row (Newton) or the share of the
    first held-out loss that is left (descent), per model. ``rounds``: passes over the rows.
    """

    task: str
    kind: str
    scale: Scaling
    outputs: Callable[[int, np.ndarray], np.ndarray]
    settled: np.ndarray
    rounds: int
    layers: Callable[[int], list[list[str]]]  # stages of named SQL expressions that end in __out_0, __out_1, ...
    odds: np.ndarray | None = None

    @property
    def names(self) -> list[str]:
        return ["predicted"] if self.task == "regression" or self.kind == "multi" else ["predicted", "score"]

    def values(self, g: int, x: np.ndarray) -> np.ndarray:
        """Predictions on the label's own scale; for two classes also the chance of class 1."""
        out = self.outputs(g, x)
        if self.task == "regression":
            return out * self.scale.label_spread[g] + self.scale.label_center[g]
        if self.kind == "multi":
            return out.argmax(axis=1).astype(float)[:, None]
        margin = out[:, 0]
        shown = margin if self.odds is None else self.odds[g, 0] * margin + self.odds[g, 1]
        return np.column_stack([margin > 0, 1 / (1 + np.exp(-np.clip(shown, -700, 700)))]).astype(float)

    def predict(self, rows: DataFrame) -> DataFrame:
        return with_predictions(rows, self.scale.features, self.scale.models, self.values, self.names)

    def pipeline(self, g: int = 0) -> PipelineModel:
        """Model g over raw features, as SQL; adds ``predicted`` and, for two classes, ``score``."""
        scale, features = self.scale, self.scale.features
        scaled = [f"(CAST({c} AS DOUBLE) - {_n(scale.center[g, i])}) / {_n(scale.spread[g, i])} AS __z_{i}" for i, c in enumerate(features)]
        stages = [scaled, *self.layers(g)]
        if self.task == "regression":
            stages.append([f"__out_0 * {_n(scale.label_spread[g])} + {_n(scale.label_center[g])} AS predicted"])
        elif self.kind == "multi":
            highest = "greatest(" + ", ".join(f"__out_{k}" for k in range(CLASSES)) + ")"
            cases = " ".join(f"WHEN __out_{k} = {highest} THEN {k}D" for k in range(CLASSES))
            stages.append([f"CASE {cases} END AS predicted"])
        else:
            shown = "__out_0" if self.odds is None else f"{_n(self.odds[g, 0])} * __out_0 + {_n(self.odds[g, 1])}"
            stages.append(["CASE WHEN __out_0 > 0 THEN 1D ELSE 0D END AS predicted", f"1D / (1D + exp(-({shown}))) AS score"])
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {', '.join(s)} FROM __THIS__") for s in stages])


def _n(x: float) -> str:
    return f"({float(x)!r}D)"


def _weighted(weights: np.ndarray, names: Sequence[str], shift: float) -> str:
    return " + ".join([_n(shift), *[f"{_n(w)} * {c}" for w, c in zip(weights, names)]])


def _scaled(scale: Scaling) -> list[str]:
    return [f"__z_{i}" for i in range(len(scale.features))]


def _linear_models(rows: DataFrame, scale: Scaling, kind: str) -> FoldModels:
    classes, loss = (CLASSES, softmax) if kind == "multi" else (1, logistic)
    penalty = SGD_PENALTY * scale.rows if kind == "sgd" else np.full(len(scale.models), 1 / INVERSE_PENALTY)
    fit = newton_in_turn(rows, scale, [loss], penalty, classes=classes)
    w = fit.coefficients

    def layers(g: int) -> list[list[str]]:
        return [[f"{_weighted(w[g, k, :-1], _scaled(scale), w[g, k, -1])} AS __out_{k}" for k in range(classes)]]

    return FoldModels(
        "classification", kind, scale, lambda g, x: scale.inputs(g, x) @ w[g, :, :-1].T + w[g, :, -1], fit.gradient, fit.passes, layers
    )


def _machines(rows: DataFrame, scale: Scaling, task: str, kind: str, landmarks: int) -> FoldModels:
    machine = fit_machines(rows, scale, task, many=landmarks)
    points, gamma = machine.kernel.points, machine.kernel.gamma

    def layers(g: int) -> list[list[str]]:
        w = machine.fit.coefficients[g, 0]
        distance = [" + ".join(f"pow(__z_{i} - {_n(v)}, 2D)" for i, v in enumerate(p)) for p in points]
        values = [f"exp({_n(-gamma)} * ({d})) AS __k_{j}" for j, d in enumerate(distance)]
        names = [f"__k_{j}" for j in range(len(points))]
        return [values, [f"{_weighted(machine.kernel.root @ w[:-1], names, w[-1])} AS __out_0"]]

    return FoldModels(
        task, kind, scale, lambda g, x: machine.margin(scale, g, x)[:, None], machine.fit.gradient, machine.passes, layers, machine.odds
    )


def _waves(rows: DataFrame, scale: Scaling, task: str, kind: str, seed: int) -> FoldModels:
    machine = fit_waves(rows, scale, task, size=KERNEL_FEATURES, seed=seed, cost=INVERSE_PENALTY)
    waves = machine.kernel

    def layers(g: int) -> list[list[str]]:
        w = machine.fit.coefficients[g, 0]
        turned = [_weighted(own, _scaled(scale), phase) for own, phase in zip(waves.weights, waves.phases)]
        values = [f"{_n(np.sqrt(2.0 / waves.width))} * cos({t}) AS __k_{j}" for j, t in enumerate(turned)]
        return [values, [f"{_weighted(w[:-1], [f'__k_{j}' for j in range(waves.width)], w[-1])} AS __out_0"]]

    return FoldModels(
        task, kind, scale, lambda g, x: machine.margin(scale, g, x)[:, None], machine.fit.gradient, machine.passes, layers, machine.odds
    )


def _networks(rows: DataFrame, scale: Scaling, task: str, kind: str, key: Sequence[str], seed: int, options: dict) -> FoldModels:
    classes = 2 if task == "classification" else None
    hidden = HIDDEN.get((task, len(scale.features)), (2 * len(scale.features),)) if kind == "network" else ()
    if kind == "descent":
        options = {"steps": Steps("sgd", rate=0.1, penalty=SGD_PENALTY, batch=20, round_rows=20_000), "rounds": 6, "held_share": 0, **options}
    trained = train_by_fold(rows, scale, hidden, key, classes=classes, seed=seed, **options)
    sizes = [len(scale.features), *hidden, 1]
    assert trained.state.shape[1] == count(sizes)
    state = trained.state

    def layers(g: int) -> list[list[str]]:
        out, names = [], _scaled(scale)
        shapes = unpack(state[g : g + 1], sizes)
        for k, (w, b) in enumerate(shapes):
            last = k + 1 == len(shapes)
            sums = [_weighted(w[0, :, j], names, b[0, 0, j]) for j in range(w.shape[2])]
            names = [f"__out_{j}" if last else f"__h{k}_{j}" for j in range(w.shape[2])]
            out.append([f"{s if last else f'tanh({s})'} AS {n}" for s, n in zip(sums, names)])
        return out

    left = trained.history.min(axis=0) / np.maximum(trained.history[0], 1e-300)
    return FoldModels(
        task, kind, scale, lambda g, x: forward(state[g : g + 1], sizes, scale.inputs(g, x)[None])[-1][0], left, trained.rounds, layers
    )


def _perceptrons(rows: DataFrame, scale: Scaling, kind: str, seed: int) -> FoldModels:
    p = len(scale.features)
    hidden = HIDDEN_LAYERS.get(p, (2 * p, p))
    fit, sizes = fit_perceptrons(rows, scale, hidden, seed=seed), [p, *hidden, 2]

    def layers(g: int) -> list[list[str]]:
        out, names = [], _scaled(scale)
        *inner, (w, b) = unpack(fit.state[g : g + 1], sizes)
        for k, (weights, biases) in enumerate(inner):
            sums = [_weighted(weights[0, :, j], names, biases[0, 0, j]) for j in range(weights.shape[2])]
            names = [f"__h{k}_{j}" for j in range(len(sums))]
            out.append([f"1D / (1D + exp(-({s}))) AS {n}" for s, n in zip(sums, names)])
        return [*out, [f"{_weighted(w[0, :, 1] - w[0, :, 0], names, b[0, 0, 1] - b[0, 0, 0])} AS __out_0"]]

    return FoldModels(
        "classification", kind, scale, lambda g, x: margins(fit.state[g], sizes, scale.inputs(g, x))[:, None], fit.gradient, fit.passes, layers
    )


def fit_folds(
    rows: DataFrame,
    key: Sequence[str],
    task: str,
    kind: str,
    features: Sequence[str],
    passthrough: Sequence[str] = (),
    *,
    by_fold: bool = True,
    seed: int = 1,
    landmarks: int = 64,
    **options,
) -> FoldModels:
    """Models of ``kind`` on ``rows`` (``key``, ``features``, ``label``, ``fold``), scaled by their own training rows.

    ``logistic``, ``sgd`` (its optimum) and ``multi`` take Newton steps; ``svr`` and ``svc`` are kernel machines on ``landmarks``
    rows, ``kernel_huber`` and ``kernel_svc`` linear models on random Fourier features;
    ``mlp`` is Spark ML's sigmoid perceptron; ``network`` is a tanh network and ``descent`` averaged stochastic gradient descent, with ``options`` for their training.
    With ``by_fold`` off one model learns from all rows.
    """
    known = FOLD_REGRESSORS if task == "regression" else FOLD_CLASSIFIERS
    if kind not in known:
        raise ValueError(f"unknown {task} model {kind!r}, one of {known}")
    scale = scaling(rows, features, "label" if task == "regression" else None, passthrough, by_fold=by_fold)
    if kind in ("logistic", "sgd", "multi"):
        return _linear_models(rows, scale, kind)
    if kind in ("svr", "svc"):
        return _machines(rows, scale, task, kind, landmarks)
    if kind in ("kernel_huber", "kernel_svc"):
        return _waves(rows, scale, task, kind, seed)
    if kind == "mlp":
        return _perceptrons(rows, scale, kind, seed)
    return _networks(rows, scale, task, kind, key, seed, options)
