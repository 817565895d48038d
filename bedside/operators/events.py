"""Filters, code labels and flag tables over long event tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import code_category


def filter_codes(df: DataFrame, column: str, codes: Iterable[int]) -> DataFrame:
    """Rows whose code is in a fixed code set; reaches the scan as a pushed IN filter."""
    return df.where(F.col(column).isin(list(codes)))


def filter_code_table(df: DataFrame, column: str, codes: DataFrame, code_column: str) -> DataFrame:
    """Same for a code set that is itself a table; Spark broadcasts it only while it is small."""
    return df.join(codes.select(F.col(code_column).alias(column)).distinct(), column, "left_semi")


def require_not_null(df: DataFrame, *columns: str) -> DataFrame:
    condition = F.lit(True)
    types = dict(df.dtypes)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
        if types[name] in ("double", "float"):
            condition = condition & ~F.isnan(F.col(name))
    return df.where(condition)


def swap_if(df: DataFrame, condition: Column, a: str, b: str) -> DataFrame:
    """Exchange two columns where ``condition`` holds."""
    return df.withColumns(
        {
            a: F.when(condition, F.col(b)).otherwise(F.col(a)),
            b: F.when(condition, F.col(a)).otherwise(F.col(b)),
        }
    )


def categorize(
    df: DataFrame, column: str, mapping: Mapping[str, Iterable[int]], name: str = "category"
) -> DataFrame:
    return df.withColumn(name, code_category(column, mapping))


def filter_by_category(df: DataFrame, column: str, rules: Mapping[str, Column], default: Column) -> DataFrame:
    """Keep rows by a condition that depends on their category; rows without a category go."""
    named = F.lit(False)
    for name, rule in rules.items():
        named = named | ((F.col(column) == name) & rule)
    other = ~F.col(column).isin(list(rules)) & default
    return df.where(named | other)


def flag_events(df: DataFrame, by: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per ``by`` with a 0/1 flag per rule: 1 if any row of the group satisfies it."""
    flags = [F.max(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in rules.items()]
    return df.groupBy(*by).agg(*flags)


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION by position: duplicates go, also those inside one input."""
    result = first
    for other in others:
        result = result.union(other)
    return result.distinct()
