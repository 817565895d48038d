"""Exact evaluation of scores and predictions, per group (model, variant, fold, ...).

Curves and areas first reduce to one row per distinct score. What is left is put in order with the
running results of ``running.py``, so a single group with very many scores is cut into score slices
and no task or driver sees a whole curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ratio
from ..sources.lineage import cut
from .running import choose_slices, following, group_total, previous, running, total

# Score slices to choose from, coarsest first.
SLICES_PER_UNIT = (2**10, 2**20, 2**30)
AGREEMENT_LIMIT = 400
LIMITS_OF_AGREEMENT = 1.96


# --- errors and information criteria ---------------------------------------------------------


def rmse(y: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - y, F.lit(2.0))))


def bic_regression(y: Column, predicted: Column, k: int) -> Column:
    """``n ln(rmse^2) + k ln n`` as an aggregate."""
    n = F.count(y)
    return n * F.ln(F.avg(F.pow(predicted - y, F.lit(2.0)))) + F.lit(k) * F.ln(n)


def bic_classification(label: Column, probability: Column, k: int) -> Column:
    """``n ln(SSE / n) + k ln n`` on probabilities."""
    return bic_regression(label, probability, k)


def regression_metrics(df: DataFrame, by: Sequence[str], y: str, predicted: str, k: int) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(y).alias("n"),
        rmse(F.col(y), F.col(predicted)).alias("rmse"),
        bic_regression(F.col(y), F.col(predicted), k).alias("bic"),
    )


# --- confusion matrix ------------------------------------------------------------------------


def confusion(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def binary_rates(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Rates of the confusion matrix; NULL where a denominator is zero."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return confusion(df, by, label, predicted).select(
        *by,
        "tn",
        "fp",
        "fn",
        "tp",
        ratio(tp, tp + fp).alias("ppv"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        ratio(tn, tn + fn).alias("npv"),
        ratio(sensitivity, 1 - specificity).alias("pos_lr"),
        ratio(1 - sensitivity, specificity).alias("neg_lr"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )


def confusion_table(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Rows of each pair of true and predicted class, for any number of classes; pairs without rows are left out."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Per class that occurs as truth or prediction: ``support``, ``precision``, ``recall``, ``f1``, and the ``accuracy`` over all classes.

    NULL where a denominator is zero. One row per class pair is left after the first aggregation.
    """
    pairs = confusion_table(df, by, label, predicted)
    both = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("true"), F.lit(0).cast("long").alias("found")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("true"), F.col("n").alias("found")),
        )
    )
    hit = F.when(F.col("label") == F.col("predicted"), F.col("true")).otherwise(0)
    counted = (
        pairs.select(*by, "label", "predicted", both.alias("c"))
        .select(*by, "label", "predicted", "c.*")
        .groupBy(*by, "class")
        .agg(F.sum("true").alias("support"), F.sum("found").alias("found"), F.sum(hit).alias("hits"))
    )
    whole = Window.partitionBy(*by)  # a row per class
    return counted.select(
        *by,
        "class",
        "support",
        ratio(F.col("hits"), F.col("found")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("found")).alias("f1"),
        ratio(F.sum("hits").over(whole), F.sum("support").over(whole)).alias("accuracy"),
    )


# --- ranking -------------------------------------------------------------------------------


def _score_slices(score: str) -> list[Column]:
    return [F.floor(F.col(score) * n) for n in SLICES_PER_UNIT]


def _ranked(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    score: str,
    hot_rows: int | None,
    neighbours: bool = False,
) -> DataFrame:
    """Per distinct score, from the highest down: counts of both classes and their running sums."""
    counts = cut(
        df.groupBy(*by, score).agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n0"),
        )
    )
    states = {
        "tps": total(F.col("n1")),
        "fps": total(F.col("n0")),
        "positives": group_total(F.col("n1")),
        "negatives": group_total(F.col("n0")),
    }
    if neighbours:
        pair = F.struct("n1", "n0")
        states |= {"above": previous(pair), "below": following(pair)}
    return running(
        counts,
        by,
        score,
        states,
        slices=choose_slices(counts, by, score, hot_rows, _score_slices(score)),
        descending=True,
    )


def ranking_metrics(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    score: str,
    *,
    hot_rows: int | None = None,
) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision (step sum), in one pass."""
    ranked = _ranked(df, by, label, score, hot_rows)
    n1, n0, tps, fps = (F.col(c) for c in ("n1", "n0", "tps", "fps"))
    wins = F.sum(n0 * (tps - n1 / 2))
    steps = F.sum(n1 * ratio(tps, tps + fps))
    return ranked.groupBy(*by).agg(
        ratio(wins, F.sum(n1) * F.sum(n0)).alias("roc_auc"),
        ratio(steps, F.sum(n1)).alias("average_precision"),
    )


def roc_auc(df: DataFrame, by: Sequence[str], label: str, score: str, **options) -> DataFrame:
    return ranking_metrics(df, by, label, score, **options).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: Sequence[str], label: str, score: str, **options) -> DataFrame:
    return ranking_metrics(df, by, label, score, **options).select(*by, "average_precision")


def _with_start(rows: DataFrame, first: Column, start: Column, point: Column, by: Sequence[str]) -> DataFrame:
    """Put the start point of a curve before its first row."""
    points = F.when(first, F.array(start, point)).otherwise(F.array(point))
    return rows.select(*by, F.inline(points))


def roc_curve(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    score: str,
    *,
    drop_intermediate: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Points ``(threshold, fpr, tpr)``, one per distinct score, from (0, 0) with a NULL threshold.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours of equal step.
    """
    ranked = _ranked(df, by, label, score, hot_rows, neighbours=True)
    first, final = F.col("above").isNull(), F.col("below").isNull()
    if drop_intermediate:
        turns = (F.col("below.n1") != F.col("n1")) | (F.col("below.n0") != F.col("n0"))
        ranked = ranked.where(first | final | turns)
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(none.alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    point = F.struct(
        F.col(score).cast("double").alias("threshold"),
        ratio("fps", "negatives").alias("fpr"),
        ratio("tps", "positives").alias("tpr"),
    )
    return _with_start(ranked, first, start, point, by)


def pr_curve(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    score: str,
    *,
    hot_rows: int | None = None,
) -> DataFrame:
    """Points ``(threshold, precision, recall)`` down to the first one of full recall.

    The curve also has its end at recall 0 and precision 1, with a NULL threshold.
    """
    ranked = _ranked(df, by, label, score, hot_rows, neighbours=True)
    kept = ranked.where(F.col("tps") - F.col("n1") < F.col("positives"))
    none = F.lit(None).cast("double")
    end = F.struct(none.alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    point = F.struct(
        F.col(score).cast("double").alias("threshold"),
        ratio("tps", F.col("tps") + F.col("fps")).alias("precision"),
        ratio("tps", "positives").alias("recall"),
    )
    return _with_start(kept, F.col("above").isNull(), end, point, by)


def interp_curve(
    curve: DataFrame,
    by: Sequence[str],
    x: str = "fpr",
    y: str = "tpr",
    n: int = 100,
    *,
    hot_rows: int | None = None,
) -> DataFrame:
    """Piecewise linear values of a rising curve on ``n`` equally spaced points from 0 to 1.

    Each segment between two neighbouring x values emits the grid points that lie on it (its right
    end belongs to the next segment), so nothing is joined with the grid. Where x repeats, the curve
    is vertical: a segment starts at the top of it and ends at the bottom of it.
    """
    steps = cut(
        curve.groupBy(*by, F.col(x).alias("x")).agg(F.min(y).alias("low"), F.max(y).alias("high"))
    )
    seen = running(
        steps,
        by,
        "x",
        {
            "left": previous(F.struct("x", "high")),
            "right": following(F.col("x")),
        },
        slices=choose_slices(steps, by, "x", hot_rows, _score_slices("x")),
    )
    last = n - 1
    nothing = F.lit(None).cast("double")
    segment = F.when(
        F.col("left").isNotNull(),
        F.struct(
            F.col("left.x").alias("x0"), F.col("left.high").alias("y0"),
            F.col("x").alias("x1"), F.col("low").alias("y1"),
        ),
    )
    tail = F.when(
        F.col("right").isNull(),
        F.struct(
            F.col("x").alias("x0"), F.col("high").alias("y0"), nothing.alias("x1"), F.col("high").alias("y1")
        ),
    )
    pieces = seen.select(*by, F.inline(F.filter(F.array(segment, tail), lambda s: s.isNotNull())))
    until = F.coalesce(F.col("x1"), F.lit(1.0))
    grid = pieces.withColumn(
        "i",
        F.explode(
            F.sequence(
                F.greatest(F.floor(F.col("x0") * last), F.lit(0)).cast("int"),
                F.least(F.ceil(until * last), F.lit(last)).cast("int"),
            )
        ),
    ).withColumn("g", F.col("i") / F.lit(float(last)))
    on_it = (F.col("g") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("g") < F.col("x1")))
    slope = ratio(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    value = F.col("y0") + F.coalesce(slope, F.lit(0.0)) * (F.col("g") - F.col("x0"))
    return grid.where(on_it).select(*by, "i", F.col("g").alias(x), value.alias(y))


# --- agreement -----------------------------------------------------------------------------


def agreement(
    df: DataFrame, by: Sequence[str], measured: str, imputed: str, limit: float | None = AGREEMENT_LIMIT
) -> DataFrame:
    """Bias, spread and 95 % limits of ``measured - imputed``, with its trend over ``measured``."""
    rows = df if limit is None else df.where(F.col(measured) <= limit)
    diff = F.col(measured) - F.col(imputed)
    mean, sd = F.avg(diff), F.stddev_pop(diff)
    return rows.groupBy(*by).agg(
        F.count(diff).alias("n"),
        mean.alias("mean_diff"),
        sd.alias("sd_diff"),
        (mean - LIMITS_OF_AGREEMENT * sd).alias("lower"),
        (mean + LIMITS_OF_AGREEMENT * sd).alias("upper"),
        F.regr_slope(diff, F.col(measured)).alias("slope"),
        F.regr_intercept(diff, F.col(measured)).alias("intercept"),
    )


def ols(df: DataFrame, by: Sequence[str], y: Column, x: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def fold_summary(metrics: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean of a metric over its folds."""
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("folds"))
