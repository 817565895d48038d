"""Penalised models of all folds by Newton's method: each step is one aggregation for every fold together.

A pass returns, per fold, the value of its objective, the gradient and the Hessian at the point it was sent, over
the rows outside the fold. A step that did not lower the objective is halved and tried again in the next pass, for
that fold alone; folds that have settled drop out. Where the loss is a ramp, halving is often needed, so a pass also
returns the values at shorter lengths, and the next one goes to the lowest. The penalty is on all coefficients but the intercept.

Sums are taken over inputs that tasks get cheaply, and turned into those of the fit on the driver, which is exact as
the latter are linear in the former: folds that differ in scaling only share products of inputs, and a kernel machine's
tasks need not turn kernel values. Rows where the loss has no curvature add nothing to a Hessian and are left out of it.

The objectives have one minimum, wherever a fit starts. ``newton_in_turn`` therefore takes the first steps on a few rows (a task
a model, all in one job) and only the last ones on all: what it returns is the minimum over all rows, settled there to the same tolerance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from ..sources.lineage import remove, written
from .batched import Batch, Scaling, apart, share, total

#: (margins n x k, targets n) -> values n, gradients n x k, Hessians n x k x k
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (model, raw features) -> inputs. Where it has ``of`` (raw features -> (model -> inputs)), models of the same rows share work; what
#: that returns for one model holds until it is asked for the next.
Inputs = Callable[[int, np.ndarray], np.ndarray]
#: Rows that are worked on at once, few enough for a core's cache.
CHUNK = 2_000
#: Rows, about, that a start is fitted on when there are many more.
START_ROWS = 50_000
#: How many times as many rows the next part has, and the tolerance of fits on parts after the first.
MORE, ROUGH = 6, 1e-5
#: Numbers of all tasks that a pass may send to the driver without a shuffle.
FEW_NUMBERS = 2_000_000
#: A step's shorter lengths whose values a pass returns too.
SHORTER = 0.5 ** np.arange(1, 7)


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels 0 and 1."""
    m = margin[:, 0]
    p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
    return np.logaddexp(0, m) - label * m, (p - label)[:, None], (p * (1 - p))[:, None, None]


def softmax(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels 0 to k - 1."""
    top = margin.max(axis=1, keepdims=True)
    e = np.exp(margin - top)
    p = e / e.sum(axis=1, keepdims=True)
    own = label[:, None] == np.arange(margin.shape[1])
    value = np.log(e.sum(axis=1)) + top[:, 0] - (margin * own).sum(axis=1)
    return value, p - own, p[:, :, None] * (np.eye(margin.shape[1]) - p[:, None, :])


@dataclass(frozen=True)
class Ramp:
    """A loss that is 0 up to ``free``, then rises with slope 1; the corner is rounded over ``corner``.

    ``kind`` "insensitive": the distance of margin and target; "hinge": 1 - margin * target, targets -1 and 1.
    """

    kind: str
    free: float
    corner: float

    def value(self, margin: np.ndarray, target: np.ndarray) -> np.ndarray:
        over = (1 - target * margin if self.kind == "hinge" else np.abs(margin - target)) - self.free
        near = np.clip(over, 0, self.corner)
        return near**2 / (2 * self.corner) + np.maximum(over - self.corner, 0)

    def __call__(self, margin: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = margin[:, 0]
        if self.kind == "hinge":
            over, direction = 1 - target * m, -target
        else:
            over, direction = np.abs(m - target), np.sign(m - target)
        over = over - self.free
        share = np.clip(over / self.corner, 0, 1)
        value = np.where(over < self.corner, share * np.maximum(over, 0) / 2, over - self.corner / 2)
        inside = ((over > 0) & (over < self.corner)) / self.corner
        return value, (direction * share)[:, None], inside[:, None, None]


@dataclass(frozen=True)
class Huber:
    """Huber's loss with a spread ``s`` that is fitted too: (s + s * h(r / s)) / 2, where h(u) is u ** 2 up to ``bend`` and goes on straight.

    The second margin is the spread: an intercept only. Where it is not positive the loss is infinite.
    """

    bend: float = 1.35
    constant = 1  #: number of the margin without inputs

    def __call__(self, margin: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, s = margin[:, 0] - target, margin[:, 1]
        slope, curve = np.zeros((len(r), 2)), np.zeros((len(r), 2, 2))
        if len(s) and s.min() <= 0:
            return np.full(len(r), np.inf), slope, curve
        u = r / s
        near = np.abs(u) <= self.bend
        value = s / 2 * (1 + np.where(near, u**2, self.bend * (2 * np.abs(u) - self.bend)))
        slope[:, 0] = np.clip(u, -self.bend, self.bend)
        slope[:, 1] = (1 - np.minimum(np.abs(u), self.bend) ** 2) / 2
        curve[:, 0, 0] = near / s
        curve[:, 0, 1] = curve[:, 1, 0] = np.where(near, -u, 0) / s
        curve[:, 1, 1] = near * u**2 / s
        return value, slope, curve


@dataclass
class Fit:
    """Coefficients (models x k x inputs + 1, the intercept last), passes over the rows, and what each model ended with."""

    coefficients: np.ndarray
    passes: int
    value: np.ndarray
    gradient: np.ndarray  # largest absolute entry, divided by the number of rows
    lowered: np.ndarray = field(repr=False)  # models whose last pass was accepted


def _sizes(k: int, width: int) -> tuple[int, int]:
    """Coefficients of a model, and numbers it sends: value, gradient for each pair of classes half of a symmetric matrix, values of shorter steps."""
    q = k * width
    return q, 1 + q + len(SHORTER) + k * (k + 1) // 2 * (width * (width + 1) // 2)


def _values(first: np.ndarray, last: np.ndarray, target: np.ndarray, loss: Ramp) -> np.ndarray:
    """Values (rows x shorter lengths) on the way between two points whose margins are given; margins are linear along it."""
    return loss.value(first[:, None] + (last - first)[:, None] * SHORTER, target[:, None])


def _with_ones(z: np.ndarray) -> np.ndarray:
    return np.hstack([z, np.ones((len(z), 1))])


def _shared_sums(batch, models, wanted, at, before, inputs, targets, loss: Loss) -> np.ndarray:
    """Value, gradient, values of shorter steps from ``before`` and Hessian of the wanted models over a record batch, one
    after the other; all have the same ``inputs`` (raw features)."""
    x, y, fold = batch
    k, width = at.shape[1:]
    a, b = np.triu_indices(k)
    i, j = np.triu_indices(width)
    q = k * width
    rest = q + 1 + len(SHORTER)
    out = np.zeros((len(wanted), _sizes(k, width)[1]))
    for start in range(0, len(x), CHUNK):
        part = slice(start, start + CHUNK)
        z = _with_ones(inputs(x[part]))
        slopes, curves = [], []
        for own, g in zip(out, wanted):
            learns = (fold[part] != models[g]).astype(float)
            target = targets(g, y[part])
            margin = z @ at[g].T
            value, first, second = loss(margin, target)
            own[0] += value @ learns
            if before is not None:
                own[q + 1 : rest] += learns @ _values(z @ before[g, 0], margin[:, 0], target, loss)
            slopes.append(first * learns[:, None])
            curves.append(second[:, a, b] * learns[:, None])
        out[:, 1 : q + 1] += (np.hstack(slopes).T @ z).reshape(len(wanted), -1)
        out[:, rest:] += (np.hstack(curves).T @ (z[:, i] * z[:, j])).reshape(len(wanted), -1)
    return out.reshape(-1)


def _own_sums(batch, models, wanted, at, before, inputs: Inputs, targets, loss: Loss) -> np.ndarray:
    """The same where each model has ``inputs`` (model, raw features) of its own."""
    x, y, fold = batch
    k, width = at.shape[1:]
    q = k * width
    rest = q + 1 + len(SHORTER)
    pairs = list(zip(*np.triu_indices(k)))
    constant = getattr(loss, "constant", None)
    out, blocks = np.zeros((len(wanted), _sizes(k, width)[1])), np.zeros((len(wanted), len(pairs), width, width))
    for start in range(0, len(x), CHUNK):
        part = slice(start, start + CHUNK)
        raw, folds = x[part], fold[part]
        of = inputs.of(raw) if hasattr(inputs, "of") else lambda g, raw=raw: inputs(g, raw)
        for own, block, g in zip(out, blocks, wanted):
            learns, z, target = folds != models[g], of(g), targets(g, y[part])
            margin = z @ at[g, :, :-1].T + at[g, :, -1]
            value, first, second = loss(margin, target)
            own[0] += value[learns].sum()
            first = first * learns[:, None]
            own[1 : q + 1] += np.hstack([first.T @ z, first.sum(axis=0)[:, None]]).reshape(-1)
            if before is not None:
                own[q + 1 : rest] += _values(z @ before[g, 0, :-1] + before[g, 0, -1], margin[:, 0], target, loss)[learns].sum(axis=0)
            for into, (a, b) in zip(block, pairs):
                curve = second[:, a, b] * learns
                if b == constant:  # only the column of the constant counts
                    into[:, -1] += np.append(curve @ z, curve.sum())
                elif len(bent := np.flatnonzero(curve)):
                    zs = _with_ones(z if len(bent) == len(z) else z[bent])
                    into += zs.T @ (curve[bent, None] * zs)
    i, j = np.triu_indices(width)
    out[:, rest:] = blocks[:, :, i, j].reshape(len(wanted), -1)
    return out.reshape(-1)


def _whole_hessian(flat: np.ndarray, k: int, width: int) -> np.ndarray:
    """Blocks (k x width x k x width) from the halves that were sent."""
    out = np.zeros((k, width, k, width))
    half = np.triu_indices(width)
    for own, a, b in zip(flat.reshape(-1, len(half[0])), *np.triu_indices(k)):
        block = np.zeros((width, width))
        block[half] = own
        block += np.triu(block, 1).T
        out[a, :, b] = out[b, :, a] = block
    return out


def newton_by_fold(
    rows: DataFrame | Batch,
    scale: Scaling,
    loss: Loss,
    penalty: np.ndarray,
    *,
    classes: int = 1,
    inputs: Inputs | None = None,
    width: int | None = None,
    turn: np.ndarray | None = None,
    targets: Callable[[int, np.ndarray], np.ndarray] | None = None,
    start: np.ndarray | None = None,
    most_passes: int = 60,
    tolerance: float = 1e-10,
) -> Fit:
    """Minimise, for every model of ``scale``, the sum of ``loss`` over its training rows plus penalty / 2 times the squared coefficients.

    ``rows``: features, ``label`` and ``fold``, or these as arrays that are here. ``inputs`` (model, raw features) are the scaled features unless given, with
    their number as ``width``; with ``turn`` (their number x width) the fit's inputs are ``inputs @ turn``. A loss with a margin
    ``constant`` needs ``inputs``; that margin's coefficients but its intercept stay 0. A model has settled when no entry of its gradient is above ``tolerance`` times its
    rows, or when its objective cannot be lowered any more in floating point.
    """
    targets = targets or (lambda g, y: y)
    width = (width or len(scale.features)) + 1
    many, models = len(scale.models), scale.models
    if inputs is None:
        center, spread = scale.center.mean(axis=0), scale.spread.mean(axis=0)
        turns = []
        for g in range(many):
            own = np.eye(width)
            own[:-1, :-1] *= spread / scale.spread[g]
            own[-1, :-1] = (center - scale.center[g]) / scale.spread[g]
            turns.append(own)
        sums, inputs = _shared_sums, lambda x: (x - center) / spread
    else:
        own = np.eye(width) if turn is None else np.pad(turn, ((0, 1), (0, 1)))
        own[-1, -1] = 1.0
        turns, sums = [own] * many, _own_sums
    sent = len(turns[0])
    q, (raw, size) = classes * width, _sizes(classes, sent)
    ridge = np.tile(np.append(np.ones(width - 1), 0.0), classes)
    moves = np.ones(q, dtype=bool)
    if (constant := getattr(loss, "constant", None)) is not None:
        moves[constant * width : (constant + 1) * width - 1] = False
    best = np.zeros((many, classes, width)) if start is None else start.copy()
    value, gradient = np.full(many, np.inf), np.full(many, np.inf)
    step, length = np.zeros_like(best), np.ones(many)
    open_, passes = list(range(many)), 0
    tasks = rows.rdd.getNumPartitions() if isinstance(rows, DataFrame) else 1
    while open_ and passes < most_passes:
        trial = best + length[:, None, None] * step
        wanted = tuple(open_)
        point, before = (np.stack([v[g] @ turns[g].T for g in range(many)]) for v in (trial, best))

        def add(batch, point=point, before=before if passes and isinstance(loss, Ramp) else None, wanted=wanted):
            return sums(batch, models, wanted, point, before, inputs, targets, loss)

        if isinstance(rows, DataFrame):
            found = total(rows, scale.features, add, len(wanted) * size, few=tasks * len(wanted) * size <= FEW_NUMBERS)
        else:
            found = add(rows)
        found = found.reshape(len(wanted), size)
        passes += 1
        for own, g in zip(found, wanted):
            w = trial[g].reshape(-1)
            now = own[0] + penalty[g] / 2 * (ridge * w**2).sum()
            if now > value[g] + 1e-12 * abs(value[g]):
                half = 0.5
                if isinstance(loss, Ramp):
                    ways = [best[g].reshape(-1) * (1 - t) + t * w for t in SHORTER]
                    values = own[raw + 1 : raw + 1 + len(SHORTER)] + [penalty[g] / 2 * (ridge * v**2).sum() for v in ways]
                    half = SHORTER[values.argmin() if values.min() < value[g] else -1]
                length[g] *= half
                if length[g] < 1e-9:
                    open_.remove(g)
                continue
            slope = (own[1 : raw + 1].reshape(classes, sent) @ turns[g]).reshape(-1) + penalty[g] * ridge * w
            slope[~moves] = 0.0
            stuck = value[g] - now <= 1e-14 * abs(now)
            best[g], value[g] = trial[g], now
            gradient[g] = np.abs(slope).max() / scale.rows[g]
            if gradient[g] <= tolerance or stuck:
                open_.remove(g)
                continue
            curve = turns[g].T @ _whole_hessian(own[raw + 1 + len(SHORTER) :], classes, sent).swapaxes(1, 2) @ turns[g]
            curve = curve.swapaxes(1, 2).reshape(q, q) + penalty[g] * np.diag(ridge)
            curve[~moves], curve[:, ~moves] = 0.0, 0.0
            # the intercepts of several classes may move together, so the curve can be flat
            step[g] = -np.linalg.lstsq(curve + 1e-12 * np.trace(curve) * np.eye(q), slope, rcond=None)[0].reshape(classes, width)
            step[g].reshape(-1)[~moves] = 0.0
            length[g] = 1.0
    return Fit(best, passes, value, gradient, length == 1)


def newton_in_turn(
    rows: DataFrame, scale: Scaling, losses: Sequence[Loss], penalty: np.ndarray, *, start: np.ndarray | None = None, **options
) -> Fit:
    """``newton_by_fold`` for ``losses`` that come ever closer to the last, each from where the one before ended.

    With many times ``START_ROWS`` rows all losses are first fitted on a part of the rows of about that size, with a penalty as much
    smaller; then only the last, on parts that grow by ``MORE``, and on all rows from there. ``passes`` counts the passes over all rows only.
    """
    many = int(scale.rows.max(initial=0)) // START_ROWS
    if many >= 4:
        start = _started(*share(rows, scale, many), losses, penalty / many, start, **options)
        losses = losses[-1:]
        rough = {**options, "tolerance": max(options.get("tolerance", 0.0), ROUGH)}
        while (many := many // MORE) >= 3:
            part, fewer = share(rows, scale, many)
            part = written(part)
            start = newton_by_fold(part, fewer, losses[0], penalty / many, start=start, **rough).coefficients
            remove(part)
    passes = 0
    for loss in losses:
        fit = newton_by_fold(rows, scale, loss, penalty, start=start, **options)
        start, passes = fit.coefficients, passes + fit.passes
    return replace(fit, passes=passes)


def _started(
    part: DataFrame, scale: Scaling, losses: Sequence[Loss], penalty: np.ndarray, start: np.ndarray | None, *,
    inputs: Inputs | None = None, targets: Callable[[int, np.ndarray], np.ndarray] | None = None, classes: int = 1, width: int | None = None, **options
) -> np.ndarray:
    """Coefficients after all ``losses`` in turn on rows few enough for one task: each model has a task of its own, so this is one job."""
    size = classes * ((width or len(scale.features)) + 1)

    def fit(g: int, rows: Batch) -> np.ndarray:
        x, y, fold = rows
        own = None if start is None else start[g : g + 1]
        more = {} if targets is None else {"targets": lambda _, y: targets(g, y)}
        if inputs is not None:
            x, more["inputs"] = inputs(g, x), lambda _, z: z
        for loss in losses:
            own = newton_by_fold((x, y, fold), scale.only(g), loss, penalty[[g]], start=own, classes=classes, width=width, **more, **options).coefficients
        return own.reshape(-1)

    out = np.zeros((len(scale.models), size)) if start is None else start.reshape(-1, size).copy()
    for g, flat in apart(part, scale, fit).items():
        out[g] = flat
    return out.reshape(len(out), classes, -1)
