"""Ranking metrics from a sketch of the scores: class counts in bins of about equal mass, which add up.

A sketch has one row per group and bin, whatever the number of scores. Counts up to a bin's edge are exact, so the
points of the curves at the edges are exact too, and what is unknown, the order inside a bin, bounds the error: every
result comes with that bound. Sketches over the same edges are added, across folds, runs and days, without the scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import ratio


def score_edges(df: DataFrame, score: str, bins: int = 256, accuracy: int = 10_000) -> list[float]:
    """At most ``bins`` - 1 scores that part the rows into about equal shares; frequent scores take one edge. One pass, ``bins`` numbers."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(F.percentile_approx(F.col(score).cast("double"), shares, accuracy).alias("edges")).first()
    return sorted(set(row["edges"] or []))


def score_sketch(df: DataFrame, by: Sequence[str], label: str, score: str, edges: Sequence[float]) -> DataFrame:
    """``by``, ``bin`` (0 is the lowest), ``n1``, ``n0``: one aggregation that leaves a row per group and bin. Null and NaN scores are left out."""
    value = F.col(score).cast("double")
    rows = df.select(*by, F.col(label).alias("__label"), value.alias("__score")).where(value.isNotNull() & ~F.isnan(value))
    if edges:
        cuts = Bucketizer(splits=[float("-inf"), *map(float, edges), float("inf")], inputCol="__score", outputCol="__bin")
        rows = cuts.transform(rows)
    else:
        rows = rows.withColumn("__bin", F.lit(0))
    positive = F.when(F.col("__label") == 1, 1).otherwise(0)
    return rows.groupBy(*by, F.col("__bin").cast("int").alias("bin")).agg(F.sum(positive).alias("n1"), F.sum(1 - positive).alias("n0"))


def merge_sketches(sketches: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Sum of sketches over the same edges; ``by`` may name fewer columns than they were made with, to pool groups."""
    same = [s.select(*by, "bin", "n1", "n0") for s in sketches]
    return reduce(DataFrame.unionByName, same).groupBy(*by, "bin").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _ranked(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bins from the highest down, with counts of both classes above each; a group has as many rows as bins."""
    above = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    return sketch.withColumns({f"{c}_above": F.coalesce(F.sum(n).over(above), F.lit(0)) for c, n in (("tp", "n1"), ("fp", "n0"))})


def sketch_metrics(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """``positives``, ``negatives``, ``roc_auc``, ``average_precision``, and bounds of their errors (``roc_auc_error``, ``average_precision_error``).

    Pairs inside a bin count half; the area can be wrong by half their share at most. NULL where a class is missing.
    """
    n1, n0, tp, fp = (F.col(c) for c in ("n1", "n0", "tp_above", "fp_above"))
    some = n1 > 0
    # inside a bin precision is highest if all positives come first, lowest if all negatives do
    high = F.when(some, n1 * (tp + n1) / (tp + fp + n1)).otherwise(0.0)
    low = F.when(some, n1 * (tp + 1) / (tp + fp + n0 + 1)).otherwise(0.0)
    p, n = F.sum(n1), F.sum(n0)
    return _ranked(sketch, by).groupBy(*by).agg(
        p.alias("positives"),
        n.alias("negatives"),
        ratio(F.sum(n0 * (tp + n1 / 2)), p * n).alias("roc_auc"),
        ratio(F.sum(n1 * n0) / 2, p * n).alias("roc_auc_error"),
        ratio(F.sum(high + low) / 2, p).alias("average_precision"),
        ratio(F.sum(high - low) / 2, p).alias("average_precision_error"),
    )


def sketch_curve(sketch: DataFrame, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Exact points (``threshold``, ``fpr``, ``recall``, ``precision``) at the bins' lower edges, the lowest bin's being minus infinity."""
    n1, n0, tp, fp = (F.col(c) for c in ("n1", "n0", "tp_above", "fp_above"))
    whole = Window.partitionBy(*by)
    lower = F.array(F.lit(float("-inf")), *[F.lit(float(e)) for e in edges])
    return _ranked(sketch, by).select(
        *by,
        F.element_at(lower, F.col("bin") + 1).alias("threshold"),
        ratio(fp + n0, F.sum(n0).over(whole)).alias("fpr"),
        ratio(tp + n1, F.sum(n1).over(whole)).alias("recall"),
        ratio(tp + n1, tp + fp + n1 + n0).alias("precision"),
    )
