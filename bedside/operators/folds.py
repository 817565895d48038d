"""Fold assignment, train-only scaling and linear models of all folds from one aggregation.

What a fold's training set needs (means, spreads, cross products) are sums, and the sums of "all rows
but this fold" are the sums of all rows minus those of the fold. So one grouped aggregation with one
row per fold serves every training set; the data is not read again per fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .running import position, running


def assign_folds(
    df: DataFrame,
    key: Sequence[str],
    k: int = 10,
    seed: int = 1,
    *,
    hashed: Column | None = None,
    name: str = "fold",
) -> DataFrame:
    """Pseudo-random fold 0..k-1 as a function of the row's key: no shuffle, same on every run."""
    value = F.xxhash64(*key, F.lit(seed)) if hashed is None else hashed
    return df.withColumn(name, F.pmod(value, F.lit(k)).cast("int"))


def train_test(
    df: DataFrame,
    key: Sequence[str],
    test_share: float = 0.3,
    seed: int = 1,
    *,
    hashed: Column | None = None,
    name: str = "is_test",
) -> DataFrame:
    """Mark about ``test_share`` of the rows as test rows, by the hash of their key."""
    value = F.xxhash64(*key, F.lit(seed)) if hashed is None else hashed
    return df.withColumn(name, F.pmod(value, F.lit(10_000)) < round(test_share * 10_000))


@dataclass(frozen=True)
class Moments:
    """Count, means and population covariance of some columns (one small matrix)."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def spread(self, column: str) -> float:
        """Population standard deviation; 1 for a constant column, as a divisor."""
        i = self.columns.index(column)
        return float(np.sqrt(max(self.cov[i, i], 0.0))) or 1.0

    def center(self, column: str) -> float:
        return float(self.mean[self.columns.index(column)])


def fold_moments(
    df: DataFrame, columns: Sequence[str], fold: str = "fold"
) -> tuple[Moments, dict[int, Moments]]:
    """Moments of all rows, and per fold those of the rows outside of it.

    Columns are shifted and scaled by their overall mean and spread before they are multiplied, which
    keeps the differences of sums accurate. What reaches the driver is one row per fold.
    """
    p = len(columns)
    overall = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    shift = np.array([overall[f"m{i}"] for i in range(p)], dtype=float)
    scale = np.array([overall[f"s{i}"] or 1.0 for i in range(p)], dtype=float)
    u = [(F.col(c) - float(shift[i])) / float(scale[i]) for i, c in enumerate(columns)]
    rows = (
        df.groupBy(fold)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(u[i]).alias(f"s{i}") for i in range(p)],
            *[F.sum(u[i] * u[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)],
        )
        .collect()
    )
    sums = {}
    for row in rows:
        cross = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cross[i, j] = cross[j, i] = row[f"s{i}_{j}"]
        sums[int(row[fold])] = (row["n"], np.array([row[f"s{i}"] for i in range(p)]), cross)

    def moments(n: int, first: np.ndarray, second: np.ndarray) -> Moments:
        mean_u = first / n
        cov_u = second / n - np.outer(mean_u, mean_u)
        return Moments(tuple(columns), n, shift + scale * mean_u, cov_u * np.outer(scale, scale))

    everything = [sum(part[i] for part in sums.values()) for i in range(3)]
    outside = {
        f: moments(*[everything[i] - part[i] for i in range(3)])
        for f, part in sums.items()
        if everything[0] > part[0]
    }
    return moments(*everything), outside


def zscore_exprs(
    moments: Moments, columns: Sequence[str], passthrough: Sequence[str] = ()
) -> dict[str, Column]:
    """Columns scaled with given moments; ``passthrough`` columns stay as they are."""
    return {
        c: F.col(c)
        if c in passthrough
        else (F.col(c) - moments.center(c)) / moments.spread(c)
        for c in columns
    }


def by_fold(values: Mapping[int, float], fold: str = "fold") -> Column:
    """The value of the row's own fold."""
    top = max(values)
    return F.element_at(
        F.array(*[F.lit(float(values.get(f, float("nan")))) for f in range(top + 1)]), F.col(fold) + 1
    )


def zscore_by_fold(
    df: DataFrame,
    columns: Sequence[str],
    passthrough: Sequence[str] = (),
    fold: str = "fold",
    prefix: str = "z_",
) -> DataFrame:
    """Scale every row with the moments of the rows outside its fold (train-only statistics)."""
    scaled = [c for c in columns if c not in passthrough]
    _, outside = fold_moments(df, scaled, fold)
    exprs = {f"{prefix}{c}": F.col(c) for c in passthrough}
    for c in scaled:
        center = by_fold({f: m.center(c) for f, m in outside.items()}, fold)
        spread = by_fold({f: m.spread(c) for f, m in outside.items()}, fold)
        exprs[f"{prefix}{c}"] = (F.col(c) - center) / spread
    return df.withColumns(exprs)


def solve_linear(
    moments: Moments,
    features: Sequence[str],
    label: str,
    alpha: float = 0.0,
    passthrough: Sequence[str] = (),
    scale_label: bool = True,
    per_row: bool = False,
) -> tuple[dict[str, float], float]:
    """Least squares (``alpha`` 0) or ridge coefficients on the original scale, and the intercept.

    The penalty applies to scaled features and label, as when both are z-scored before the fit;
    ``per_row`` weighs it against the mean instead of the sum of the squared errors.
    """
    alpha = alpha * moments.n if per_row else alpha
    at = [moments.columns.index(c) for c in features]
    y = moments.columns.index(label)
    sd = np.array([1.0 if c in passthrough else moments.spread(c) for c in features])
    sd_y = moments.spread(label) if scale_label else 1.0
    gram = moments.n * moments.cov[np.ix_(at, at)] / np.outer(sd, sd)
    target = moments.n * moments.cov[at, y] / (sd * sd_y)
    if alpha:
        weights = np.linalg.solve(gram + alpha * np.eye(len(at)), target)
    else:
        weights = np.linalg.lstsq(gram, target, rcond=None)[0]
    raw = weights * sd_y / sd
    intercept = float(moments.mean[y] - raw @ moments.mean[at])
    return dict(zip(features, map(float, raw))), intercept


def cross_validated_linear(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    alpha: float = 0.0,
    passthrough: Sequence[str] = (),
    scale_label: bool = True,
    per_row: bool = False,
    fold: str = "fold",
    name: str = "predicted",
) -> DataFrame:
    """Out-of-fold predictions of a linear or ridge model: two aggregations and one projection."""
    _, outside = fold_moments(df, [*features, label], fold)
    solved = {
        f: solve_linear(m, features, label, alpha, passthrough, scale_label, per_row)
        for f, m in outside.items()
    }
    predicted = by_fold({f: s[1] for f, s in solved.items()}, fold)
    for c in features:
        predicted = predicted + by_fold({f: s[0][c] for f, s in solved.items()}, fold) * F.col(c)
    return df.withColumn(name, predicted)


def exact_folds(
    df: DataFrame, key: Sequence[str], k: int = 10, seed: int = 1, name: str = "fold"
) -> DataFrame:
    """Folds whose sizes differ by at most one: rows are dealt out in turn, in the order of their key's hash.

    The order covers the whole table, so it is always numbered in slices of the (evenly spread) hash, of about a
    million rows each.
    """
    bits = max(12, (df.count() // 1_000_000).bit_length())
    hashed = df.withColumns({"__all": F.lit(1), "__hash": F.xxhash64(*key, F.lit(seed))})
    dealt = running(
        hashed,
        ["__all"],
        "__hash",
        {"__nth": position()},
        ties=list(key),
        slices=F.shiftright("__hash", 64 - bits),
    )
    return dealt.withColumn(name, F.pmod(F.col("__nth") - 1, F.lit(k)).cast("int")).select(
        *df.columns, name
    )
