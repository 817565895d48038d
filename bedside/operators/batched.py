"""Sums over all rows for many models at once: the one Spark job behind a step of an iterative fit.

A step sends the current coefficients of every fold's model to the tasks. Each task adds up, with numpy on record
batches, what its rows contribute to every model and returns numbers that do not grow with the rows; Spark adds the
tasks' numbers by place. So a fit of ten folds costs as many jobs as it takes steps, not ten times as many.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .folds import Moments, fold_moments

#: Tasks whose numbers are added up by the driver where a fit takes very many short passes.
FEW_TASKS = 256
#: The fold number of a model that learns from all rows.
ALL = -1


@dataclass(frozen=True)
class Scaling:
    """Centre and spread of the inputs for each model, learned from its own training rows; ``models`` are the folds they leave out."""

    features: tuple[str, ...]
    models: tuple[int, ...]
    center: np.ndarray  # models x features
    spread: np.ndarray
    rows: np.ndarray  # training rows of each model
    label_center: np.ndarray
    label_spread: np.ndarray

    def inputs(self, g: int, x: np.ndarray) -> np.ndarray:
        return (x - self.center[g]) / self.spread[g]

    def targets(self, g: int, y: np.ndarray) -> np.ndarray:
        return (y - self.label_center[g]) / self.label_spread[g]

    def only(self, g: int) -> Scaling:
        """The same for model g alone."""
        own = slice(g, g + 1)
        return Scaling(
            self.features, self.models[own], self.center[own], self.spread[own], self.rows[own], self.label_center[own], self.label_spread[own]
        )


def scaling(
    rows: DataFrame, features: Sequence[str], label: str | None = None, passthrough: Sequence[str] = (), *, by_fold: bool = True
) -> Scaling:
    """Moments of the rows outside each fold (or, with ``by_fold`` off, of all rows); without ``label`` targets stay as they are."""
    columns = [*features, *([label] if label else [])]
    if by_fold:
        _, parts = fold_moments(rows, columns)
    else:
        whole, _ = fold_moments(rows.withColumn("fold", F.lit(0)), columns)
        parts = {ALL: whole}
    return scaling_from(parts, features, label, passthrough)


def scaling_from(
    parts: dict[int, Moments], features: Sequence[str], label: str | None = None, passthrough: Sequence[str] = ()
) -> Scaling:
    own = [parts[g] for g in sorted(parts)]

    def values(name: str, columns: Sequence[str], plain: float) -> np.ndarray:
        return np.array([[plain if c in passthrough else getattr(m, name)(c) for c in columns] for m in own], dtype=float)

    labels = [label] if label else []
    return Scaling(
        tuple(features), tuple(sorted(parts)), values("center", features, 0.0), values("spread", features, 1.0),
        np.array([m.n for m in own]), *(v[:, 0] if label else plain for v, plain in (
            (values("center", labels, 0.0), np.zeros(len(own))), (values("spread", labels, 1.0), np.ones(len(own))))),
    )


Batch = tuple[np.ndarray, np.ndarray, np.ndarray]


def _read(batch: pa.RecordBatch, features: Sequence[str]) -> Batch:
    """Inputs, labels and folds of a record batch."""
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
    return x, batch.column("label").to_numpy(zero_copy_only=False).astype(float), batch.column("fold").to_numpy(zero_copy_only=False)


def spread(rows: DataFrame) -> DataFrame:
    """Rows that come in fewer partitions than there are cores, as from one small file, are dealt out; others stay."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def total(rows: DataFrame, features: Sequence[str], add: Callable[[Batch], np.ndarray], size: int, *, few: bool = False) -> np.ndarray:
    """Sum over the record batches of ``rows`` (columns ``features``, ``label``, ``fold``) of the ``size`` numbers ``add`` returns.

    Each task returns one row per place, and places are added by a shuffle; the driver gets ``size`` numbers. With ``few``
    (at most ``FEW_TASKS`` tasks) it gets those of each task and adds them, which spares a pass its shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                value += add(_read(batch, features))
        at = np.flatnonzero(value)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(value[at])], ["at", "value"])

    summed = rows.select(*features, "label", "fold").mapInArrow(run, "at int, value double")
    if few:
        table = summed.toArrow()
        return np.bincount(table["at"].to_numpy(), table["value"].to_numpy(), minlength=size)
    table = summed.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[table["at"].to_numpy()] = table["value"].to_numpy()
    return out


def share(rows: DataFrame, scale: Scaling, many: int) -> tuple[DataFrame, Scaling]:
    """One row in ``many``, chosen by hash, with ``scale`` for so many rows: fits start there before they go over all rows."""
    part = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(many)) == 0)
    return part, replace(scale, rows=np.maximum(scale.rows // many, 1))


def apart(part: DataFrame, scale: Scaling, fit: Callable[[int, Batch], np.ndarray]) -> dict[int, np.ndarray]:
    """What ``fit`` (model, its training rows) returns, by model: a task of one job holds a model's rows, which must be few.

    A model without rows is left out.
    """
    features, many = list(scale.features), len(scale.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Batch]] = defaultdict(list)
        for batch in batches:
            which = batch.column("__model").to_numpy()
            for g in np.unique(which):
                held[int(g)].append(tuple(v[which == g] for v in _read(batch, features)))
        for g, parts in held.items():
            flat = fit(g, tuple(np.concatenate(v) for v in zip(*parts)))
            columns = np.full(len(flat), g, np.int32), np.arange(len(flat), dtype=np.int32), flat
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["model", "at", "value"])

    left_out = F.array(*[F.lit(m) for m in scale.models])
    each = part.select(*features, "label", "fold", F.explode(F.array(*[F.lit(g) for g in range(many)])).alias("__model"))
    dealt = each.where(F.col("fold") != left_out[F.col("__model")]).repartitionById(many, "__model")
    table = dealt.mapInArrow(run, "model int, at int, value double").toArrow()
    model, at, value = (table[c].to_numpy() for c in ("model", "at", "value"))
    return {int(g): value[model == g][np.argsort(at[model == g])] for g in np.unique(model)}


def with_predictions(
    rows: DataFrame, features: Sequence[str], models: Sequence[int], predict: Callable[[int, np.ndarray], np.ndarray], names: Sequence[str]
) -> DataFrame:
    """``rows`` with double columns ``names``: what ``predict`` (model, inputs) returns for the model that left the row's fold out.

    One pass without a shuffle; a row whose fold has no model of its own gets nulls.
    """
    rest = [c for c in rows.columns if c not in names]
    number = {out: g for g, out in enumerate(models)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            values = np.full((len(x), len(names)), np.nan)
            for out in np.unique(fold):
                if (g := number.get(int(out))) is not None:
                    values[fold == out] = predict(g, x[fold == out]).reshape(-1, len(names))
            told = [pa.array(v, mask=np.isnan(v)) for v in values.T]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *told], [*rest, *names])

    given = rows.select(*rest)
    doubles = ", ".join(f"`{n}` double" for n in names)
    return given.mapInArrow(run, f"{given._jdf.schema().toDDL()}, {doubles}")


def hash_bucket(key: Sequence[str], seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(buckets))
