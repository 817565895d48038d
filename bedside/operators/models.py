"""Estimators as Spark ML pipelines that carry their scaling with them.

A fitted pipeline takes raw feature columns: its first stage scales them with the training moments,
so saving the pipeline saves the scalers too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..sources.lineage import remove, written
from .folds import Moments, fold_moments

REGRESSORS = ("linear", "ridge", "sgd", "kernel_huber", "gbt")
CLASSIFIERS = ("logistic", "sgd", "ridge", "kernel_svc", "mlp", "multi")

# Default penalties and layer sizes the models are compared under.
RIDGE_ALPHA = 1.0
SGD_PENALTY = 1e-4
INVERSE_PENALTY = 1.0
HIDDEN_LAYERS = {3: (6, 3), 7: (12, 8, 6, 4, 4)}
KERNEL_FEATURES = 64
#: Bins of a feature in boosted trees, as Spark ML cuts them.
TREE_BINS = 32

_TARGET = "__target"


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _scaling(moments: Moments, features: Sequence[str], passthrough: Sequence[str]) -> SQLTransformer:
    terms = [
        f"CAST({c} AS DOUBLE) AS __z_{c}"
        if c in passthrough
        else f"({c} - {_number(moments.center(c))}) / {_number(moments.spread(c))} AS __z_{c}"
        for c in features
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def _kernel_map(features: Sequence[str], seed: int, size: int = KERNEL_FEATURES) -> SQLTransformer:
    """Random Fourier features of an RBF kernel with gamma 1 / number of features."""
    rng = np.random.default_rng(seed)
    p = len(features)
    weights = rng.normal(0.0, np.sqrt(2.0 / p), (size, p))
    phases = rng.uniform(0.0, 2 * np.pi, size)
    terms = []
    for j in range(size):
        dot = " + ".join(f"{_number(weights[j, i])} * __z_{c}" for i, c in enumerate(features))
        terms.append(f"{_number(np.sqrt(2.0 / size))} * cos({dot} + {_number(phases[j])}) AS __k_{j}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def _inputs(
    moments: Moments, features: Sequence[str], passthrough: Sequence[str], kernel: bool, seed: int
) -> list:
    stages = [_scaling(moments, features, passthrough)]
    columns = [f"__z_{c}" for c in features]
    if kernel:
        stages.append(_kernel_map(features, seed))
        columns = [f"__k_{j}" for j in range(KERNEL_FEATURES)]
    return [*stages, VectorAssembler(inputCols=columns, outputCol="__features")]


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = TREE_BINS) -> list[list[float]]:
    """Ascending edges that cut each column into ``bins`` bins at most: midpoints of its values if these are few, else quantiles."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    told = df.agg(
        *[F.percentile_approx(c, shares).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    edges = []
    for i, c in enumerate(columns):
        own = sorted(set(told[f"q{i}"] or []))
        if told[f"n{i}"] <= 2 * bins:
            values = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
            if len(values) <= bins:
                own = [a + (b - a) / 2 for a, b in zip(values, values[1:])]
        edges.append(own)
    return edges


def _binned(columns: Sequence[str], edges: Sequence[Sequence[float]]) -> SQLTransformer:
    """Number of each column's bin as ``__b_0``, ``__b_1``, ...; a value on an edge is in the bin below."""
    terms = []
    for i, (c, own) in enumerate(zip(columns, edges)):
        cases = "".join(f" WHEN {c} <= {_number(e)} THEN {k}D" for k, e in enumerate(own))
        terms.append(f"CASE WHEN {c} IS NULL THEN NULL{cases} ELSE {len(own)}D END AS __b_{i}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def _boosted(df: DataFrame, scaling: SQLTransformer, features: Sequence[str], estimator: GBTRegressor) -> list:
    """Stages of trees that are grown on cells instead of rows.

    A tree sees of a row only the bins of its features, so rows with the same bins get the same prediction in every round,
    and what a split gains depends on their number and the sum of their targets alone. Rows become one weighted row a cell:
    at most ``TREE_BINS`` to the power of the number of features, however many rows there are.
    """
    columns = [f"__z_{c}" for c in features]
    scaled = scaling.transform(df)
    binned = _binned(columns, bin_edges(scaled, columns))
    names = [f"__b_{i}" for i in range(len(columns))]
    assembler = VectorAssembler(inputCols=names, outputCol="__features")
    cells = written(
        binned.transform(scaled).groupBy(*names).agg(F.avg(_TARGET).alias(_TARGET), F.count(F.lit(1)).cast("double").alias("__rows"))
    )
    grown = estimator.setWeightCol("__rows").fit(assembler.transform(cells))
    remove(cells)
    return [scaling, binned, assembler, grown]


def _moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    return fold_moments(df.withColumn("__all", F.lit(0)), columns, "__all")[0]


def fit_regressor(
    df: DataFrame,
    kind: str,
    features: Sequence[str],
    label: str = "Pao2",
    passthrough: Sequence[str] = (),
    seed: int = 1,
    moments: Moments | None = None,
) -> PipelineModel:
    """Fitted pipeline from raw features to ``predicted`` on the label's own scale."""
    m = moments or _moments(df, [*features, label])
    mu, sd, n = m.center(label), m.spread(label), m.n
    common = {"featuresCol": "__features", "labelCol": _TARGET, "predictionCol": "__scaled"}
    if kind == "linear":
        estimator = LinearRegression(regParam=0.0, solver="normal", **common)
    elif kind == "ridge":
        estimator = LinearRegression(
            regParam=RIDGE_ALPHA / n, elasticNetParam=0.0, standardization=False, solver="normal", **common
        )
    elif kind == "sgd":
        estimator = LinearRegression(
            regParam=SGD_PENALTY, elasticNetParam=0.0, standardization=False, solver="normal", **common
        )
    elif kind == "kernel_huber":
        estimator = LinearRegression(
            loss="huber", regParam=1.0 / (INVERSE_PENALTY * n), standardization=False, **common
        )
    elif kind == "gbt":
        estimator = GBTRegressor(maxIter=20, maxDepth=5, maxBins=TREE_BINS, seed=seed, **common)
    else:
        raise ValueError(f"unknown regressor {kind!r}, one of {REGRESSORS}")
    back = SQLTransformer(
        statement=f"SELECT *, __scaled * {_number(sd)} + {_number(mu)} AS predicted FROM __THIS__"
    )
    rows = df.withColumn(_TARGET, (F.col(label) - mu) / sd)
    if kind == "gbt":
        return PipelineModel([*_boosted(rows, _scaling(m, features, passthrough), features, estimator), back])
    stages = [*_inputs(m, features, passthrough, kind == "kernel_huber", seed), estimator, back]
    return Pipeline(stages=stages).fit(rows)


def fit_classifier(
    df: DataFrame,
    kind: str,
    features: Sequence[str],
    label: str = "label",
    passthrough: Sequence[str] = (),
    seed: int = 1,
    moments: Moments | None = None,
) -> PipelineModel:
    """Fitted pipeline from raw features to ``predicted`` and, for most kinds, ``probability``."""
    m = moments or _moments(df, features)
    n, p = m.n, len(features)
    common = {"featuresCol": "__features", "labelCol": _TARGET, "predictionCol": "predicted"}
    target = F.col(label).cast("double")
    if kind in ("logistic", "multi"):
        stages = [
            LogisticRegression(
                regParam=1.0 / (INVERSE_PENALTY * n), elasticNetParam=0.0, standardization=False,
                maxIter=100, tol=1e-8 if kind == "multi" else 1e-10,
                family="multinomial" if kind == "multi" else "binomial", **common,
            )
        ]
    elif kind == "sgd":
        stages = [
            LogisticRegression(
                regParam=SGD_PENALTY, elasticNetParam=0.0, standardization=False, maxIter=100, **common
            )
        ]
    elif kind == "ridge":
        target = target * 2 - 1
        ridge = LinearRegression(
            regParam=RIDGE_ALPHA / n, elasticNetParam=0.0, standardization=False, solver="normal",
            **{**common, "predictionCol": "margin"},
        )
        # The ridge estimator divides the penalty by the label's spread, which is not 1 here.
        spread = df.agg(F.stddev_pop(target)).first()[0] or 1.0
        ridge.setRegParam(RIDGE_ALPHA * spread / n)
        sign = "SELECT *, CASE WHEN margin > 0 THEN 1D ELSE 0D END AS predicted FROM __THIS__"
        stages = [ridge, SQLTransformer(statement=sign)]
    elif kind == "kernel_svc":
        stages = [
            LinearSVC(
                regParam=1.0 / (INVERSE_PENALTY * n), standardization=False, maxIter=100,
                rawPredictionCol="__margin", **common,
            ),
            LogisticRegression(
                featuresCol="__margin", labelCol=_TARGET, predictionCol="__calibrated",
                rawPredictionCol="__calibrated_raw", maxIter=50,
            ),
        ]
    elif kind == "mlp":
        hidden = HIDDEN_LAYERS.get(p, (2 * p, p))
        stages = [
            MultilayerPerceptronClassifier(layers=[p, *hidden, 2], maxIter=200, seed=seed, **common)
        ]
    else:
        raise ValueError(f"unknown classifier {kind!r}, one of {CLASSIFIERS}")
    stages = [*_inputs(m, features, passthrough, kind == "kernel_svc", seed), *stages]
    return Pipeline(stages=stages).fit(df.withColumn(_TARGET, target))


def apply_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input columns plus ``predicted`` and, for classifiers, ``score`` (probability or margin of class 1); columns of these names are replaced."""
    rest = [c for c in df.columns if c not in ("predicted", "score")]
    out = model.transform(df.select(*rest))
    if "score" in out.columns:
        score = F.col("score")
    elif "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "margin" in out.columns:
        score = F.col("margin")
    else:
        return out.select(*rest, "predicted")
    return out.select(*rest, "predicted", score.alias("score"))
