"""Small tanh networks, and linear models as networks without hidden layers, trained in rounds that are averaged.

Rows are dealt to shards by a hash of their key and stored so. In a round every shard starts from the same state, goes
through its rows in mini-batches (Adam, or averaged stochastic gradient descent), and returns its state; the states are
averaged, weighted by rows. All folds' models are trained by the same pass, as one stack of matrices, and a row only
moves the models that do not leave out its fold. So a fit is one job a round, whatever the number of folds
and mini-batches. A task steps several shards side by side, as further entries of the stack, and holds their rows while
they are few; of larger shards it holds one record batch. A share of the rows, also chosen by hash, moves no
model: the loss on them says which round's state each model keeps, and when it stops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.lineage import remove, written
from .batched import Scaling, hash_bucket

#: (outputs models x rows x k, targets models x rows) -> values models x rows, gradients models x rows x k
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Shards that a task steps side by side, and the rows of them that it holds at most.
SIDE, HELD_ROWS = 8, 500_000
#: Shards that a file holds at most.
FILE_SHARDS = 24
#: Rows of a shard that are dealt into mini-batches anew, and rows that are scaled at once.
DEALT, SCALED = 10_000, 1_000


def shapes(sizes: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:]))


def count(sizes: Sequence[int]) -> int:
    """Numbers of a network: weights and biases of each layer."""
    return sum(a * b + b for a, b in shapes(sizes))


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights (models x inputs x outputs) and biases (models x 1 x outputs) of each layer."""
    out, at = [], 0
    for a, b in shapes(sizes):
        weights, biases = flat[:, at : at + a * b], flat[:, at + a * b : at + a * b + b]
        out.append((weights.reshape(-1, a, b), biases.reshape(-1, 1, b)))
        at += a * b + b
    return out


def layers(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Views (models x (inputs + 1) x outputs) of each layer: its weights, and its biases as the last row."""
    out, at = [], 0
    for a, b in shapes(sizes):
        out.append(flat[:, at : at + (a + 1) * b].reshape(-1, a + 1, b))
        at += (a + 1) * b
    return out


def _tanh(z: np.ndarray, out: np.ndarray) -> None:
    """To 1e-15 or so; changes ``z``. ``np.tanh`` takes twice as long where it does not use vector registers."""
    with np.errstate(over="ignore"):
        z *= 2
        np.exp(z, out=z)
        z += 1
        np.divide(-2, z, out=z)
        np.add(z, 1, out=out)


def through(flat: np.ndarray, sizes: Sequence[int], z: np.ndarray, into: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
    """Outputs of each layer (models x units x rows), the inputs first: tanh inside, linear at the end.

    Inputs and inner layers have a row of ones below their units, for the biases. ``into``: arrays to write to, with these ones.
    """
    out, last = [z], len(sizes) - 2
    for k, w in enumerate(layers(flat, sizes)):
        own = w.swapaxes(1, 2) @ out[-1]
        if k < last:
            units, own = own, np.ones((len(flat), w.shape[2] + 1, z.shape[2])) if into is None else into[k][:, :, : z.shape[2]]
            _tanh(units, own[:, :-1])
        out.append(own)
    return out


def _rows_last(z: np.ndarray) -> np.ndarray:
    """Models x rows x features as ``through`` takes them."""
    out = np.ones((z.shape[0], z.shape[2] + 1, z.shape[1]))
    out[:, :-1] = z.swapaxes(1, 2)
    return out


def forward(flat: np.ndarray, sizes: Sequence[int], z: np.ndarray) -> list[np.ndarray]:
    """Outputs of each layer (models x rows x units), the inputs first."""
    return [out[:, :units].swapaxes(1, 2) for out, units in zip(through(flat, sizes, _rows_last(z)), sizes)]


def squared(output: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    error = output[..., 0] - target
    return error**2 / 2, error[..., None]


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def slope_only(loss: Loss, output: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gradients of ``loss`` without its values, where these cost extra."""
    if loss is cross_entropy and output.shape[-1] == 1:
        return _chance(output) - target[..., None]
    return loss(output, target)[1]


def cross_entropy(output: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets 0 to the number of outputs - 1; one output: targets 0 and 1."""
    if output.shape[-1] == 1:
        margin = output[..., 0]
        return np.logaddexp(0, margin) - target * margin, (_chance(margin) - target)[..., None]
    top = output.max(axis=-1, keepdims=True)
    e = np.exp(output - top)
    whole = e.sum(axis=-1, keepdims=True)
    own = target[..., None] == np.arange(output.shape[-1])
    return (np.log(whole) + top)[..., 0] - (output * own).sum(axis=-1), e / whole - own


def loss_and_gradient(
    flat: np.ndarray, sizes: Sequence[int], z: np.ndarray, target: np.ndarray, weight: np.ndarray, loss: Loss
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum of each model's loss, and its gradient, by back-propagation."""
    passed = through(flat, sizes, _rows_last(z))
    value, slope = loss(passed[-1].swapaxes(1, 2), target)
    return (value * weight).sum(axis=1), back(flat, sizes, passed, (slope * weight[..., None]).swapaxes(1, 2))


def back(flat: np.ndarray, sizes: Sequence[int], passed: list[np.ndarray], slope: np.ndarray) -> np.ndarray:
    """Gradient of each model from what ``through`` returned and the slope at the last layer (models x k x rows)."""
    gradient = np.empty_like(flat)
    own, into = layers(flat, sizes), layers(gradient, sizes)
    for k in range(len(own) - 1, -1, -1):
        np.matmul(passed[k], slope.swapaxes(1, 2), out=into[k])
        if k:
            slope = own[k][:, :-1] @ slope
            inner = np.square(passed[k][:, :-1])
            np.subtract(1, inner, out=inner)
            slope *= inner
    return gradient


@dataclass(frozen=True)
class Steps:
    """How a shard moves: ``adam``, or ``sgd`` with a rate that falls with the square root of the steps and averaged states.

    A round goes over a record batch as often as it takes for a shard to see ``round_rows`` rows, once at least.
    """

    kind: str = "adam"
    rate: float = 0.01
    penalty: float = 0.0
    batch: int = 50
    round_rows: int = 20_000


@dataclass
class Trained:
    """Flat numbers of each model (models x numbers), the rounds it took, and the held-out loss per row after each round."""

    state: np.ndarray
    rounds: int
    history: np.ndarray  # rounds x models


def glorot(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(sizes):
        bound = np.sqrt(6 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


class Shards:
    """The states of all models while they go through some shards side by side: first all models of the first shard, and so on."""

    def __init__(self, many: int, state: np.ndarray, moments: np.ndarray, sizes: Sequence[int], loss: Loss, steps: Steps, rate: float, done: np.ndarray):
        self.many, self.models = many, len(state)
        self.state, self.first, self.second = (np.tile(v, (many, 1)) for v in (state, *moments))
        self.rows, self.average, self.moved = np.zeros(len(self.state)), np.zeros_like(self.state), np.zeros(len(self.state))
        self._sizes, self._loss, self._steps, self._rate, self._done = sizes, loss, steps, rate, np.tile(done, many)
        self._decay = np.concatenate([np.append(np.ones(a * b), np.zeros(b)) for a, b in shapes(sizes)])
        self._into = [np.ones((len(self.state), units + 1, steps.batch)) for units in sizes[1:-1]]
        self._room = np.empty_like(self.state), np.empty_like(self.state)

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: Scaling, rngs: Sequence[np.random.Generator], times: int) -> None:
        """``times`` passes in mini-batches over rows of each shard (shards x rows x features; rows that are filled up last).

        ``weight`` (shards x models x rows) is 1 where a model may learn, 0 in rows that are filled up.
        """
        many, n, size = *y.shape, self._steps.batch
        full = weight.any(axis=1).sum(axis=1)
        at_once = max(size, SCALED // size * size)
        center, spread = scale.center[:, :, None], scale.spread[:, :, None]
        label_center, label_spread = scale.label_center[:, None], scale.label_spread[:, None]
        scaled = np.ones((many, self.models, x.shape[2] + 1, min(n, at_once)))
        for _ in range(times):
            order = np.tile(np.arange(n), (many, 1))
            for s, rng in enumerate(rngs):
                order[s, : full[s]] = rng.permutation(full[s])
            own = np.arange(many)[:, None]
            dealt, label, may = x[own, order].swapaxes(1, 2).copy(), y[own, order], np.take_along_axis(weight, order[:, None], axis=2)
            for start in range(0, n, at_once):
                part = slice(start, start + at_once)
                target = ((label[:, None, part] - label_center) / label_spread).reshape(many * self.models, -1)
                w = may[:, :, part].reshape(many * self.models, -1)
                z = scaled[..., : w.shape[1]]
                np.subtract(dealt[:, None, :, part], center, out=z[:, :, :-1])
                z[:, :, :-1] /= spread
                z = z.reshape(many * self.models, x.shape[2] + 1, -1)
                for at in range(0, z.shape[2], size):
                    self._move(z[:, :, at : at + size], target[:, at : at + size], w[:, at : at + size])
        self.rows += weight.sum(axis=2).reshape(-1)

    def _move(self, z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        n = weight.sum(axis=1)
        passed = through(self.state, self._sizes, z, self._into)
        slope = slope_only(self._loss, passed[-1].swapaxes(1, 2), target) * (weight / np.maximum(n, 1)[:, None])[..., None]
        slope = back(self.state, self._sizes, passed, slope.swapaxes(1, 2))
        if self._steps.penalty:
            slope += self._steps.penalty * self._decay * self.state
        going = (n > 0)[:, None]
        self._done += going[:, 0]
        steps = np.maximum(self._done, 1)[:, None]
        if self._steps.kind == "adam":
            root, change = self._room
            for moment, value, share in ((self.first, slope, 0.1), (self.second, np.square(slope, out=root), 0.001)):
                np.subtract(value, moment, out=change)
                change *= going * share
                moment += change
            np.divide(self.second, 1 - 0.999**steps, out=root)
            np.sqrt(root, out=root)
            root += 1e-8
            np.multiply(self.first, going * self._rate / (1 - 0.9**steps), out=change)
            change /= root
            self.state -= change
        else:
            self.state -= (going * self._rate / np.sqrt(steps)) * slope
            self.moved += going[:, 0]
            self.average += (self.state - self.average) * (going / np.maximum(self.moved, 1)[:, None])

    def result(self) -> np.ndarray:
        """Per model: rows, then state and moments times rows, summed over the shards: sums give weighted means."""
        state = self.state if self._steps.kind == "adam" else np.where(self.moved[:, None] > 0, self.average, self.state)
        whole = np.concatenate([state, self.first, self.second, self._done[:, None]], axis=1)
        return np.concatenate([self.rows[:, None], whole * self.rows[:, None]], axis=1).reshape(self.many, self.models, -1).sum(axis=0)


def train_by_fold(
    rows: DataFrame,
    scale: Scaling,
    hidden: Sequence[int],
    key: Sequence[str],
    *,
    classes: int | None = None,
    steps: Steps = Steps(),
    rounds: int = 12,
    patience: int = 4,
    held_share: int = 10,
    shard_rows: int = 50_000,
    most_shards: int = 4096,
    seed: int = 1,
) -> Trained:
    """Train one network for every model of ``scale``: squared error on scaled labels, or cross-entropy of ``classes`` classes.

    ``rows``: ``key`` (identifies a row), features, ``label``, ``fold``. Two classes have one output. One row in ``held_share``
    moves no model (0: none is held out). After ``patience`` rounds without a better held-out loss a model is done; each keeps
    its best state. Adam's rate falls to a twentieth by the last round. A table has a shard for ``shard_rows`` rows, ``most_shards`` at most.
    """
    outputs = 1 if classes in (None, 2) else classes
    sizes = [len(scale.features), *hidden, outputs]
    loss = squared if classes is None else cross_entropy
    models, many, numbers = np.array(scale.models), len(scale.models), count(sizes)
    features = list(scale.features)
    total_rows = rows.count()
    shards = max(1, min(most_shards, total_rows // shard_rows))
    times = max(1, round(steps.round_rows * shards / max(1, total_rows)))
    dealt = rows.select(
        *key, *features, "label", "fold", hash_bucket(key, seed, shards).cast("int").alias("shard"),
        (hash_bucket(key, seed + 1, held_share) == 0 if held_share else F.lit(False)).alias("held"),
    )
    # as many shards in each file, which a task reads, and as many files for each core
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = min(shards, cores * -(-shards // (cores * FILE_SHARDS)))
    placed = dealt.repartitionById(files, F.floor(F.col("shard") * files / shards).cast("int"))
    stored = written(placed.sortWithinPartitions("shard", *key).drop(*key))
    width = 1 + 3 * numbers + 1  # rows, state, two moments, steps
    size = many * (width + 2)  # and held-out loss and rows

    side = max(1, min(SIDE, HELD_ROWS * shards // max(1, total_rows)))

    def one_round(state: np.ndarray, moments: np.ndarray, done: np.ndarray, rate: float, number: int, learns: np.ndarray) -> np.ndarray:
        def begin(many_shards: int) -> Shards:
            return Shards(many_shards, state, moments, sizes, loss, steps, rate, done)

        def step(moved: Shards, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rngs: list[np.random.Generator]) -> None:
            """Rows of each shard, dealt in turn."""
            for start in range(0, max(len(p[1]) for p in parts), DEALT):
                own = [tuple(v[start : start + DEALT] for v in p) for p in parts]
                n = max(len(p[1]) for p in own)
                x, y, weight = np.zeros((len(own), n, len(features))), np.zeros((len(own), n)), np.zeros((len(own), many, n))
                for s, (xs, ys, folds) in enumerate(own):
                    x[s, : len(ys)], y[s, : len(ys)] = xs, ys
                    weight[s, :, : len(ys)] = (folds != models[:, None]) * learns[:, None]
                moved.learn(x, y, weight, scale, rngs, times)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((many, width + 2))
            alone, of, waiting = None, None, {}

            def together(ended: bool) -> None:
                """Step the waiting shards; the last may have more rows to come unless all have ended."""
                own = [v for v in waiting if ended or v != of]
                if len(own) >= (1 if ended else side):
                    moved = begin(len(own))
                    step(moved, [tuple(np.concatenate(c) for c in zip(*waiting.pop(v))) for v in own], [np.random.default_rng([seed, number, v]) for v in own])
                    out[:, :width] += moved.result()

            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
                y, fold, which, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold", "shard", "held"))
                if held.any():
                    z = np.stack([scale.inputs(g, x[held]) for g in range(many)])
                    target = np.stack([scale.targets(g, y[held].astype(float)) for g in range(many)])
                    kept = (fold[held] != models[:, None]).astype(float)
                    lost, _ = loss(forward(state, sizes, z)[-1], target)
                    out[:, width] += (lost * kept).sum(axis=1)
                    out[:, width + 1] += kept.sum(axis=1)
                if not learns.any():
                    continue
                for value in map(int, np.unique(which)):  # a record batch may hold the end of one shard and the next
                    own = (which == value) & ~held
                    rows_of = x[own], y[own].astype(float), fold[own]
                    if side > 1:
                        of = value
                        together(False)
                        waiting.setdefault(value, []).append(rows_of)
                        continue
                    if value != of:
                        if alone is not None:
                            out[:, :width] += alone.result()
                        alone, of, rng = begin(1), value, [np.random.default_rng([seed, number, value])]
                    step(alone, [rows_of], rng)
            if alone is not None:
                out[:, :width] += alone.result()
            together(True)
            flat = out.reshape(-1)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["at", "value"])

        summed = stored.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        found = np.zeros(size)
        found[summed["at"].to_numpy()] = summed["value"].to_numpy()
        return found.reshape(many, width + 2)

    state = np.tile(glorot(sizes, seed), (many, 1)) if hidden else np.zeros((many, numbers))
    moments, done = np.zeros((2, many, numbers)), np.zeros(many)
    best, lowest, since, history = state.copy(), np.full(many, np.inf), np.zeros(many), []
    for number in range(rounds + 1):
        learns = (since <= patience) & (number < rounds)
        rate = steps.rate * (0.05 + 0.95 * (1 + np.cos(np.pi * number / rounds)) / 2) if steps.kind == "adam" else steps.rate
        found = one_round(state, moments, done, rate, number, learns.astype(float))
        now = found[:, width] / np.maximum(found[:, width + 1], 1)
        history.append(now)
        better = (now < lowest * (1 - 1e-5)) | (found[:, width + 1] == 0)  # without held-out rows the last state counts
        best[better], lowest[better] = state[better], now[better]
        since = np.where(better, 0, since + 1)
        if not learns.any():
            break
        n = found[:, 0]
        moved = (n > 0) & learns
        mean = found[:, 1:width] / np.maximum(n, 1)[:, None]
        state = np.where(moved[:, None], mean[:, :numbers], state)
        for k in (0, 1):
            moments[k] = np.where(moved[:, None], mean[:, (k + 1) * numbers : (k + 2) * numbers], moments[k])
        done = np.where(moved, mean[:, -1], done)
    remove(stored)
    return Trained(best, number, np.array(history))
