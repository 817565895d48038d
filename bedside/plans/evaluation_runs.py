"""Cross-validated runs over samples: regression of Pao2 and classification of the P/F class."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import round_half_even
from ..operators.cleaning import clean_cohort, feature_columns, with_label
from ..operators.batched import spread
from ..operators.evaluation import (
    bic_classification, binary_rates, class_metrics, fold_summary, ranking_metrics, regression_metrics,
)
from ..operators.fold_models import FOLD_CLASSIFIERS, FOLD_REGRESSORS, fit_folds
from ..operators.folds import assign_folds, cross_validated_linear, fold_moments
from ..operators.models import (
    RIDGE_ALPHA, SGD_PENALTY, apply_model, fit_classifier, fit_regressor,
)
from ..sources.lineage import written
from ..sources.models import Variant, load_model, save_model

# With seven features the last one, a flag, is not scaled.
_FLAG = ("vaso",)
# Penalty of the models with a closed form, and whether it is per row. The stochastic solver is
# replaced by the optimum it approaches.
_LINEAR = {"linear": (0.0, False), "ridge": (RIDGE_ALPHA, False), "sgd": (SGD_PENALTY, True)}
# Models whose folds are fitted together, step by step.
_TOGETHER = {"regression": FOLD_REGRESSORS, "classification": FOLD_CLASSIFIERS}


def prepare(
    samples: DataFrame, key: Sequence[str], variant: Variant, *, k: int = 10, seed: int = 1, clean: bool = True
) -> DataFrame:
    """Clean samples reduced to key, features, label and fold."""
    rows = samples
    if clean:
        rows = clean_cohort(
            samples, filter_spo2=variant.filter_spo2, seven_features=variant.seven_features
        )
    kind = "pao2" if variant.task == "regression" else "class4" if variant.model == "multi" else "class2"
    labelled = with_label(rows, kind).select(*key, *feature_columns(variant.seven_features), "label")
    return assign_folds(labelled, key, k, seed)


def _passthrough(variant: Variant) -> tuple[str, ...]:
    return _FLAG if variant.seven_features else ()


def cross_validate(
    samples: DataFrame,
    key: Sequence[str],
    variant: Variant,
    *,
    k: int = 10,
    seed: int = 1,
    parallelism: int = 4,
    clean: bool = True,
) -> DataFrame:
    """Out-of-fold predictions, each row with its key, fold, label and ``predicted`` (and ``score``).

    Linear models of all folds come out of one aggregation, and the models of ``fold_models`` out of one aggregation
    a step. Spark ML's estimators are fitted once per fold, ``parallelism`` fits at a time. All read rows
    that were written once.
    """
    rows = prepare(samples, key, variant, k=k, seed=seed, clean=clean)
    rows = written(spread(rows) if variant.model in _TOGETHER[variant.task] else rows)
    return cross_validate_rows(rows, variant, seed=seed, parallelism=parallelism)


def cross_validate_rows(
    rows: DataFrame, variant: Variant, *, seed: int = 1, parallelism: int = 4
) -> DataFrame:
    """``cross_validate`` on prepared rows."""
    features, flags = feature_columns(variant.seven_features), _passthrough(variant)
    if variant.task == "regression" and variant.model in _LINEAR:
        alpha, per_row = _LINEAR[variant.model]
        return cross_validated_linear(rows, features, "label", alpha, flags, per_row=per_row)
    if variant.model == "ridge":
        signed = rows.withColumn("__sign", F.col("label") * 2 - 1)
        scored = cross_validated_linear(
            signed, features, "__sign", RIDGE_ALPHA, flags, scale_label=False, name="score"
        )
        return scored.drop("__sign").withColumn("predicted", (F.col("score") > 0).cast("double"))
    if variant.model in _TOGETHER[variant.task]:
        key = [c for c in rows.columns if c not in (*features, "label", "fold")]
        return fit_folds(rows, key, variant.task, variant.model, features, flags, seed=seed).predict(rows)

    _, outside = fold_moments(rows, [*features, "label"])
    fit = fit_regressor if variant.task == "regression" else fit_classifier

    def one(i: int) -> DataFrame:
        model = fit(
            rows.where(F.col("fold") != i), variant.model, features, "label", flags, seed, outside[i]
        )
        return apply_model(model, rows.where(F.col("fold") == i))

    with ThreadPool(max(1, min(parallelism, len(outside)))) as pool:
        parts = pool.map(one, sorted(outside))
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(predictions: DataFrame, variant: Variant) -> DataFrame:
    """Metrics per fold as a long table."""
    k = len(feature_columns(variant.seven_features))
    if variant.task == "regression":
        wide = regression_metrics(predictions, ["fold"], "label", "predicted", k)
        names = ["rmse", "bic"]
    elif variant.model == "multi":
        wide = class_metrics(predictions, ["fold"], "label", "predicted").groupBy("fold").agg(
            F.max("accuracy").alias("accuracy"), F.avg("f1").alias("macro_f1")
        )
        names = ["accuracy", "macro_f1"]
    else:
        rates = binary_rates(predictions, ["fold"], "label", "predicted")
        bic = predictions.groupBy("fold").agg(
            bic_classification(F.col("label"), F.col("score"), k).alias("bic")
        )
        ranking = ranking_metrics(predictions, ["fold"], "label", "score")
        wide = rates.join(ranking, "fold").join(bic, "fold")
        names = [
            "ppv", "sensitivity", "specificity", "npv", "pos_lr", "neg_lr", "f1", "accuracy",
            "roc_auc", "average_precision", "bic",
        ]
    long = wide.select("fold", *names).unpivot("fold", names, "metric", "value")
    return long.select(
        F.lit(variant.model).alias("model"),
        F.lit(7 if variant.seven_features else 3).alias("features"),
        F.lit(variant.filter_spo2).alias("filtered"),
        "fold",
        "metric",
        "value",
    )


def run_grid(
    samples: DataFrame,
    key: Sequence[str],
    task: str,
    models: Iterable[str],
    feature_sets: Iterable[bool] = (False, True),
    filters: Iterable[bool] = (False, True),
    *,
    k: int = 10,
    seed: int = 1,
    parallelism: int = 4,
) -> DataFrame:
    """Fold metrics of every combination of model, feature set and saturation filter.

    The samples are prepared once per feature set, filter and kind of label.
    """
    parts, prepared = [], {}
    for seven, filtered, model in product(feature_sets, filters, models):
        variant = Variant(task, model, seven, filtered)
        subset = (seven, filtered, model == "multi")
        if subset not in prepared:
            prepared[subset] = written(spread(prepare(samples, key, variant, k=k, seed=seed)))
        predictions = cross_validate_rows(
            prepared[subset], variant, seed=seed, parallelism=parallelism
        )
        parts.append(fold_metrics(predictions, variant))
    return reduce(DataFrame.unionByName, parts)


def summarize(metrics: DataFrame) -> DataFrame:
    return fold_summary(metrics, ["model", "features", "filtered", "metric"])


def fit_final(
    samples: DataFrame, key: Sequence[str], variant: Variant, root: str | None = None, *, seed: int = 1, clean: bool = True
) -> PipelineModel:
    """Fit on all rows; saved under ``root`` if given."""
    rows = written(spread(prepare(samples, key, variant, seed=seed, clean=clean)))
    features = feature_columns(variant.seven_features)
    if variant.model in _TOGETHER[variant.task]:
        together = fit_folds(rows, key, variant.task, variant.model, features, _passthrough(variant), by_fold=False, seed=seed)
        model = together.pipeline()
    else:
        fit = fit_regressor if variant.task == "regression" else fit_classifier
        model = fit(rows.drop("fold"), variant.model, features, "label", _passthrough(variant), seed)
    if root is not None:
        save_model(model, root, variant)
    return model


def score(df: DataFrame, root: str, variant: Variant) -> DataFrame:
    """Apply a saved variant to new rows; regression results are rounded to two digits."""
    out = apply_model(load_model(root, variant), df)
    if variant.task == "regression":
        out = out.withColumn("predicted", round_half_even("predicted", 2))
    return out
