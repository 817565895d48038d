"""Sigmoid perceptrons for two classes, fitted for all folds together by limited-memory BFGS.

Every step of every model needs the loss and gradient over all of its training rows. One pass adds these up for all models
that are not done, each at the point that its own search asks for, so a fit of ten folds takes about as many passes as its
slowest model takes steps. Searches live on the driver and hold some vectors of a model's size. Starting weights, two softmax
outputs, steps and the rules to stop are those of Spark ML's perceptron.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .batched import FEW_TASKS, Batch, Scaling, total
from .networks import count, shapes, unpack

#: Rows that go through the layers of all models at once, so that what lies between them stays in a core's cache.
AT_ONCE = 2_048
#: Pairs of steps and gradient changes that a search keeps, losses that it looks back on, trials along a direction.
PAIRS, LOOK_BACK, TRIALS = 10, 20, 20


@dataclass
class Perceptrons:
    """Flat numbers of each model (models x numbers), its mean loss, the norm of its gradient, its steps; passes over the rows."""

    state: np.ndarray
    loss: np.ndarray
    gradient: np.ndarray
    steps: np.ndarray
    passes: int


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        np.exp(np.negative(z, out=z), out=z)
        z += 1
        return np.reciprocal(z, out=z)


def _forward(flat: np.ndarray, sizes: Sequence[int], z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Outputs of the layers before the last (models x units x rows), the inputs first, and the margin of class 1 (models x rows)."""
    *inner, (w, b) = unpack(flat, sizes)
    out = [z]
    for weights, biases in inner:
        z = weights.swapaxes(1, 2) @ out[-1]
        z += biases.swapaxes(1, 2)
        out.append(_sigmoid(z))
    margin = ((w[:, :, 1] - w[:, :, 0])[:, None] @ out[-1])[:, 0]
    margin += b[:, :, 1] - b[:, :, 0]
    return out, margin


def margins(flat: np.ndarray, sizes: Sequence[int], z: np.ndarray) -> np.ndarray:
    """Margin of class 1 of one model for scaled inputs (rows x features)."""
    return _forward(flat[None], sizes, np.ascontiguousarray(z.T)[None])[1][0]


def loss_and_gradient(flat: np.ndarray, sizes: Sequence[int], z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per model the weighted sum of the cross-entropy, then its gradient (models x (1 + numbers)).

    ``z``: models x features x rows; ``target``: rows, 0 or 1; ``weight``: models x rows.
    """
    passed, margin = _forward(flat, sizes, z)
    small = np.exp(-np.abs(margin))
    loss = np.maximum(margin, 0) - target * margin + np.log(1 + small)
    slope = (np.where(margin >= 0, 1, small) / (1 + small) - target) * weight
    out = np.empty((len(flat), 1 + flat.shape[1]))
    out[:, 0] = (loss * weight).sum(axis=1)
    layers, into = unpack(flat, sizes), unpack(out[:, 1:], sizes)
    last, (w, b) = layers[-1][0], into[-1]
    w[:, :, 1] = (passed[-1] @ slope[:, :, None])[:, :, 0]
    w[:, :, 0] = -w[:, :, 1]
    b[:, 0, 1] = slope.sum(axis=1)
    b[:, 0, 0] = -b[:, 0, 1]
    slope = (last[:, :, 1] - last[:, :, 0])[:, :, None] * slope[:, None]
    for k in range(len(layers) - 2, -1, -1):
        inner = 1 - passed[k + 1]
        inner *= passed[k + 1]
        slope *= inner
        w, b = into[k]
        w[...] = passed[k] @ slope.swapaxes(1, 2)
        b[:, 0] = slope.sum(axis=2)
        if k:
            slope = layers[k][0] @ slope
    return out


class Search:
    """Limited-memory BFGS of one model that is told the loss and gradient at ``at``, and then has the next point there.

    Along a direction it halves and doubles until the loss has fallen enough and the slope has flattened (Wolfe). It is done
    after ``most`` steps, once the last losses differ by less than ``tolerance`` of the first, or when the gradient vanishes.
    """

    def __init__(self, start: np.ndarray, most: int, tolerance: float):
        self.at, self.point, self.steps, self.done = start, start, 0, False
        self.loss, self.gradient = np.inf, np.zeros_like(start)
        self._most, self._tolerance = most, tolerance
        self._pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=PAIRS)
        self._losses: deque[float] = deque(maxlen=LOOK_BACK)
        self._first: float | None = None

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        if self._first is None:
            if not np.isfinite(loss):
                raise ValueError("the loss of the perceptron is not finite: are features or labels null?")
            self._first = loss
            self._arrive(loss, gradient)
            return
        down = float(self.gradient @ self._way)
        if not loss <= self.loss + 1e-4 * self._length * down:  # not a number neither
            self._high = self._length
        elif gradient @ self._way < 0.9 * down:
            self._low, self._kept = self._length, (self.at, loss, gradient)
        else:
            self._move(loss, gradient)
            return
        self._trials += 1
        if self._trials >= TRIALS:
            if self._kept is not None:  # the loss has fallen, if not as far as it could
                self.at, loss, gradient = self._kept
                self._move(loss, gradient)
            elif self._pairs:
                self._pairs.clear()
                self._set_out()
            else:
                self.done = True
            return
        self._length = 2 * self._low if self._high is None else (self._low + self._high) / 2
        self.at = self.point + self._length * self._way

    def _move(self, loss: float, gradient: np.ndarray) -> None:
        step, change = self.at - self.point, gradient - self.gradient
        if step @ change > 0:
            self._pairs.append((step, change))
        self.steps += 1
        self._arrive(loss, gradient)

    def _arrive(self, loss: float, gradient: np.ndarray) -> None:
        self.point, self.loss, self.gradient = self.at, loss, gradient
        still = len(self._losses) >= 2 and abs(loss - max(self._losses)) <= self._tolerance * self._first
        self._losses.append(loss)
        flat = np.linalg.norm(gradient) <= max(self._tolerance * loss, 1e-8)
        self.done = still or flat or self.steps >= self._most
        if not self.done:
            self._set_out()

    def _set_out(self) -> None:
        way, shares = -self.gradient, []
        for step, change in reversed(self._pairs):
            share = step @ way / (step @ change)
            shares.append(share)
            way = way - share * change
        if self._pairs:
            step, change = self._pairs[-1]
            way = way * (step @ change / (change @ change))
        for (step, change), share in zip(self._pairs, reversed(shares)):
            way = way + (share - change @ way / (step @ change)) * step
        self._way, self._low, self._high, self._trials, self._kept = way, 0.0, None, 0, None
        self._length = 1.0 if self._pairs else 1 / max(float(np.linalg.norm(way)), 1e-300)
        self.at = self.point + self._length * way


def _start(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4 / a, 2.4 / a, a * b + b) for a, b in shapes(sizes)])


def fit_perceptrons(
    rows: DataFrame, scale: Scaling, hidden: Sequence[int], *, most: int = 200, tolerance: float = 1e-6, seed: int = 1
) -> Perceptrons:
    """One perceptron for every model of ``scale``, each on all rows outside of its fold; ``rows``: features, ``label`` (0, 1), ``fold``."""
    sizes = [len(scale.features), *hidden, 2]
    searches = [Search(_start(sizes, seed), most, tolerance) for _ in scale.models]
    numbers, passes, few = count(sizes), 0, rows.rdd.getNumPartitions() <= FEW_TASKS
    while going := [g for g, s in enumerate(searches) if not s.done]:
        flat, left_out = np.array([searches[g].at for g in going]), np.array([scale.models[g] for g in going])
        center, spread = scale.center[going][:, :, None], scale.spread[going][:, :, None]

        def add(batch: Batch) -> np.ndarray:
            x, y, fold = batch
            out = np.zeros((len(flat), 1 + numbers))
            for start in range(0, len(y), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                z = (np.ascontiguousarray(x[part].T) - center) / spread
                out += loss_and_gradient(flat, sizes, z, y[part], (fold[part] != left_out[:, None]).astype(float))
            return out.reshape(-1)

        found = total(rows, scale.features, add, len(going) * (1 + numbers), few=few).reshape(len(going), -1)
        passes += 1
        for g, (loss, *gradient) in zip(going, found / np.maximum(scale.rows[going], 1)[:, None]):
            searches[g].tell(float(loss), np.array(gradient))
    return Perceptrons(
        np.array([s.point for s in searches]), np.array([s.loss for s in searches]),
        np.array([np.linalg.norm(s.gradient) for s in searches]), np.array([s.steps for s in searches]), passes,
    )
