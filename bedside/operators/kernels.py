"""Support vector machines with a Gaussian kernel, through landmarks (Nyström).

Landmarks are rows far from each other: each task keeps the farthest points of its rows, then a few tasks those of
what the first kept, then the driver those of the rest. With the kernel's values at the landmarks as inputs a kernel
machine is a linear one, and all folds are fitted together by ``newton.py``. The losses have a corner; it is rounded, and
the rounding made narrower from fit to fit, each starting from the one before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batched import Scaling
from .newton import Fit, Huber, Ramp, logistic, newton_in_turn

#: Cost of an error, width of the free tube of the regression.
COST = 1.0
TUBE = 0.1
#: Relative error that kernel values of a model may have while it is fitted.
EXACT = 1e-12
#: Rounding of the losses' corner, in turn; the first takes in margins of 0, where a fit starts.
CORNERS = (2.0, 0.5, 0.1, 0.02)


def farthest(points: np.ndarray, many: int) -> np.ndarray:
    """Numbers of ``many`` rows, each the farthest from those before; the first is the farthest from the mean. Repeated rows count once."""
    if not len(points):
        return np.zeros(0, dtype=int)
    chosen: list[int] = []
    distance = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
    while len(chosen) < many:
        at = int(distance.argmax())
        if chosen and distance[at] <= 0:
            break
        own = ((points - points[at]) ** 2).sum(axis=1)
        distance = own if not chosen else np.minimum(distance, own)
        chosen.append(at)
    return np.array(chosen)


def landmarks(rows: DataFrame, features: Sequence[str], center: np.ndarray, spread: np.ndarray, many: int, parts: int = 8) -> np.ndarray:
    """At most ``many`` scaled rows that cover the scaled inputs; a task and the driver hold a few times that."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(features)))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
            held = np.concatenate([held, x])
            held = held[farthest((held - center) / spread, many)]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in held.T], list(features))

    schema = ", ".join(f"`{c}` double" for c in features)
    far = rows.select(*[F.col(c).cast("double") for c in features]).mapInArrow(keep, schema)
    table = far.repartition(parts).mapInArrow(keep, schema).toArrow()  # parts * many rows
    x = np.column_stack([table[c].to_numpy() for c in features]).reshape(-1, len(features))
    x = x[np.lexsort(x.T)]  # the same order whatever the tasks
    z = (x - center) / spread
    return z[farthest(z, many)]


@dataclass(frozen=True)
class Kernel:
    """Kernel values at the landmarks, turned so that inner products of two rows approximate the kernel of them."""

    points: np.ndarray
    gamma: float
    root: np.ndarray

    @classmethod
    def at(cls, points: np.ndarray, gamma: float) -> Kernel:
        value, vector = np.linalg.eigh(_gauss(points, points, gamma))
        keep = value > 1e-10 * max(value.max(), 1e-300) if len(value) else value > 0
        return cls(points, gamma, vector[:, keep] / np.sqrt(value[keep]))

    @property
    def width(self) -> int:
        return self.root.shape[1]

    def values(self, z: np.ndarray) -> np.ndarray:
        """Kernel of the rows and the landmarks, before it is turned by ``root``."""
        return _gauss(z, self.points, self.gamma)

    def inputs(self, z: np.ndarray) -> np.ndarray:
        return self.values(z) @ self.root


@dataclass(frozen=True)
class Waves:
    """Random Fourier features (models ``kernel_huber`` and ``kernel_svc``): their inner products approximate a Gaussian kernel whose
    width is one over the number of inputs."""

    weights: np.ndarray  # features x inputs
    phases: np.ndarray

    @classmethod
    def drawn(cls, inputs: int, seed: int, size: int) -> Waves:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2.0 / inputs), (size, inputs)), rng.uniform(0.0, 2 * np.pi, size))

    @property
    def width(self) -> int:
        return len(self.phases)

    @property
    def root(self) -> np.ndarray:
        return np.eye(self.width)

    def values(self, z: np.ndarray) -> np.ndarray:
        turned = z @ self.weights.T
        turned += self.phases
        out = _cosine(turned)
        out *= np.sqrt(2.0 / self.width)
        return out


def _cosine(angle: np.ndarray) -> np.ndarray:
    """Cosine to 1e-14 or so, for angles of any usual size, several times as fast as ``np.cos``; changes ``angle``.

    With the angle brought within half a turn either way, it is one less twice the squared sine of its half, which a series gives.
    """
    angle *= 0.5 / np.pi
    angle -= np.rint(angle)
    angle *= np.pi
    square = angle * angle
    out = square * _SINE[0]
    for c in _SINE[1:-1]:
        out += c
        out *= square
    out += _SINE[-1]
    out *= out
    out *= square
    out *= -2.0
    out += 1.0
    return out


#: Series of sin(x) / x in x ** 2, the highest power first.
_SINE = [(-1.0) ** k / math.factorial(2 * k + 1) for k in range(10, -1, -1)]


def _gauss(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """One product gives minus gamma times the squared distances."""
    left = np.hstack([a, (a**2).sum(axis=1)[:, None], np.ones((len(a), 1))])
    right = gamma * np.hstack([2 * b, -np.ones((len(b), 1)), -(b**2).sum(axis=1)[:, None]])
    square = left @ right.T
    np.minimum(square, 0, out=square)
    return np.exp(square, out=square)


@dataclass
class Machine:
    """Coefficients (models x width + 1) on ``kernel`` inputs, jobs run, and for classifiers scale and shift of the log-odds."""

    kernel: Kernel | Waves
    fit: Fit
    passes: int
    odds: np.ndarray | None = None  # models x 2

    def margin(self, scale: Scaling, g: int, x: np.ndarray) -> np.ndarray:
        return self._of(g, self.kernel.values(scale.inputs(g, x)))

    def _of(self, g: int, values: np.ndarray) -> np.ndarray:
        w = self.fit.coefficients[g, 0]
        return values @ (self.kernel.root @ w[:-1]) + w[-1]


@dataclass(frozen=True)
class Values:
    """Kernel values of a model's scaled inputs (model, raw features), with ``of`` for many models of the same rows.

    Folds differ little in scaling. So values are worked out once, at the folds' mean scaling, and a model's own are these times
    the exponential of a small number, by as much of its series as ``EXACT`` asks for; where the number is not small, they are worked out anew.
    """

    kernel: Kernel | Waves
    scale: Scaling

    def __call__(self, g: int, x: np.ndarray) -> np.ndarray:
        return self.kernel.values(self.scale.inputs(g, x))

    def of(self, x: np.ndarray) -> Callable[[int], np.ndarray]:
        scale, kernel = self.scale, self.kernel
        if not isinstance(kernel, Kernel) or len(scale.models) < 2:
            return lambda g: self(g, x)
        center, spread = scale.center.mean(axis=0), scale.spread.mean(axis=0)
        z = (x - center) / spread
        square, values = z**2, kernel.values(z)
        small, out = np.empty((2, *values.shape))  # for all models in turn

        def own(g: int) -> np.ndarray:
            # scaled by the model: wide * z + shift; left are all terms by which its squared distances differ from those of z
            wide, shift = spread / scale.spread[g], (center - scale.center[g]) / scale.spread[g]
            alone = square @ (wide**2 - 1) + z @ (2 * wide * shift) + shift @ shift
            left = np.column_stack([z, alone, np.ones(len(z))])
            right = -kernel.gamma * np.vstack([-2 * (wide - 1)[:, None] * kernel.points.T, np.ones(len(kernel.points)), -2 * kernel.points @ shift])
            np.matmul(left, right, out=small)
            most = max(small.max(initial=0), -small.min(initial=0))
            terms = next((k for k in range(1, 6) if most ** (k + 1) < EXACT * math.factorial(k + 1)), None)
            if terms is None:
                return self(g, x)
            np.multiply(small, 1 / math.factorial(terms), out=out)
            for k in range(terms - 1, -1, -1):
                np.add(out, 1 / math.factorial(k), out=out)
                np.multiply(out, small if k else values, out=out)
            return out

        return own


@dataclass(frozen=True)
class Margins:
    """A machine's margins as the only input (model, raw features), with ``of`` as ``Values`` has it."""

    machine: Machine
    values: Values

    def __call__(self, g: int, x: np.ndarray) -> np.ndarray:
        return self.machine._of(g, self.values(g, x))[:, None]

    def of(self, x: np.ndarray) -> Callable[[int], np.ndarray]:
        values = self.values.of(x)
        return lambda g: self.machine._of(g, values(g))[:, None]


def fit_machines(
    rows: DataFrame, scale: Scaling, kind: str, *, many: int = 64, cost: float = COST, corners: Sequence[float] = CORNERS
) -> Machine:
    """Machines of all models of ``scale``: ``kind`` "regression" (scaled labels) or "classification" (labels 0 and 1).

    The kernel's width is one over the number of features, on scaled features. A classifier's margins get their
    probabilities from a logistic fit on the training rows.
    """
    center, spread = scale.center.mean(axis=0), scale.spread.mean(axis=0)
    kernel = Kernel.at(landmarks(rows, scale.features, center, spread, many), 1 / len(scale.features))
    hinge = kind == "classification"
    losses = [Ramp("hinge", 0.0, c) if hinge else Ramp("insensitive", TUBE, c) for c in corners]
    return _fitted(rows, scale, kernel, losses, cost, hinge)


def fit_waves(rows: DataFrame, scale: Scaling, kind: str, *, size: int, seed: int, cost: float = COST, corners: Sequence[float] = CORNERS) -> Machine:
    """Linear models of all folds on ``Waves``: Huber's loss with a fitted spread for "regression", the hinge for "classification",
    with probabilities as in ``fit_machines``. Tasks work the features out again in each pass; none are stored."""
    kernel = Waves.drawn(len(scale.features), seed, size)
    hinge = kind == "classification"
    return _fitted(rows, scale, kernel, [Ramp("hinge", 0.0, c) for c in corners] if hinge else [Huber()], cost, hinge)


def _fitted(rows: DataFrame, scale: Scaling, kernel: Kernel | Waves, losses: Sequence[Ramp | Huber], cost: float, hinge: bool) -> Machine:
    inputs = Values(kernel, scale)

    def targets(g: int, y: np.ndarray) -> np.ndarray:
        return 2 * y - 1 if hinge else scale.targets(g, y)

    start, classes = None, 1
    if isinstance(losses[0], Huber):
        start, classes = np.zeros((len(scale.models), 2, kernel.width + 1)), 2
        start[:, 1, -1] = 1.0  # the spread of scaled labels
    fit = newton_in_turn(
        rows, scale, losses, np.full(len(scale.models), 1 / cost), classes=classes, inputs=inputs, width=kernel.width,
        turn=kernel.root, targets=targets, start=start, tolerance=1e-6,
    )
    machine = Machine(kernel, fit, fit.passes)
    if hinge:
        told = newton_in_turn(rows, scale, [logistic], np.full(len(scale.models), 1e-6), inputs=Margins(machine, inputs), width=1, tolerance=1e-8)
        machine = Machine(kernel, fit, fit.passes + told.passes, told.coefficients[:, 0])
    return machine
