"""Descriptive statistics. Each function is one aggregation pass, partially aggregated before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.oxygen import pf_ratio, sf_ratio


def _long(row: DataFrame, names: Sequence[str], fields: Sequence[str], key: str) -> DataFrame:
    """One wide row with ``field__name`` columns to one row per name."""
    items = [
        F.struct(F.lit(n).alias(key), *[F.col(f"{f}__{n}").alias(f) for f in fields]) for n in names
    ]
    return row.select(F.inline(F.array(*items)))


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation and non-null count per column."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"mean__{c}"),
            F.stddev_pop(c).alias(f"std__{c}"),
            F.count(c).alias(f"n__{c}"),
        ]
    return _long(df.agg(*aggs), columns, ["mean", "std", "n"], "column")


def profile(df: DataFrame) -> DataFrame:
    """Type and non-null count per column, over the row count."""
    kinds = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(f"n__{c}") for c in df.columns]
    )
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("type"),
            F.col(f"n__{c}").alias("non_null"),
            F.col("__rows").alias("rows"),
        )
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*items)))


def log_ratio_r2(df: DataFrame) -> DataFrame:
    """Correlation of log10 S/F with log10 P/F and its square, with mean and spread of P/F."""
    sf, pf = sf_ratio("Spo2", "Fio2"), pf_ratio("Pao2", "Fio2")
    r = F.corr(F.log10(sf), F.log10(pf))
    return df.agg(
        r.alias("r"),
        (r * r).alias("r2"),
        F.avg(pf).alias("pf_mean"),
        F.stddev_pop(pf).alias("pf_std"),
        F.count(pf).alias("n"),
    )


def corr_with(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of every column with one target."""
    row = df.agg(*[F.corr(c, target).alias(f"corr__{c}") for c in columns])
    return _long(row, columns, ["corr"], "column")


def freq_of_freq(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, ..."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
    return per_key.groupBy("occurrences").agg(F.count(F.lit(1)).alias("keys"))


def class_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("label_sum", F.col(label) * F.col("n"))


def share(df: DataFrame, flag: str, name: str = "share") -> DataFrame:
    """Share of rows whose 0/1 flag is 0 (with 1 for male, the female share)."""
    return df.agg((1 - F.avg(flag)).alias(name), F.count(flag).alias("n"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum of each column; the maximum is in the last bin.

    Two passes: the bounds (two numbers per column), then all counts of all columns in one row.
    """
    bounds = df.agg(
        *[F.min(c).cast("double").alias(f"lo__{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi__{c}") for c in columns],
    ).first()
    aggs: list[Column] = []
    items: list[Column] = []
    for c in columns:
        lo, hi = bounds[f"lo__{c}"], bounds[f"hi__{c}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        # least() skips NULLs, so a missing value has to be kept out of the last bin
        bin_no = F.when(F.col(c).isNotNull(), F.least(F.floor((F.col(c) - lo) / width), F.lit(bins - 1)))
        for b in range(bins):
            aggs.append(F.count(F.when(bin_no == b, 1)).alias(f"b{b}__{c}"))
            items.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(b).alias("bin"),
                    F.lit(lo + b * width).alias("from"),
                    F.lit(lo + (b + 1) * width).alias("to"),
                    F.col(f"b{b}__{c}").alias("n"),
                )
            )
    return df.agg(*aggs).select(F.inline(F.array(*items)))
