"""Formula baselines and the tables behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.oxygen import pao2_log_linear, pao2_non_linear, pf_class2, pf_ratio, sf_ratio
from ..operators.evaluation import AGREEMENT_LIMIT, binary_rates, rmse


def by_formula(df: DataFrame) -> DataFrame:
    """Each sample once per formula, with the imputed value in ``imputed``."""
    return df.withColumn(
        "__both",
        F.explode(
            F.array(
                F.struct(F.lit("log_linear").alias("formula"), pao2_log_linear("Spo2", "Fio2").alias("imputed")),
                F.struct(F.lit("non_linear").alias("formula"), pao2_non_linear("Spo2").alias("imputed")),
            )
        ),
    ).select(*df.columns, "__both.formula", "__both.imputed")


def baseline_regression(clean: DataFrame) -> DataFrame:
    return by_formula(clean).groupBy("formula").agg(
        F.count(F.lit(1)).alias("n"), rmse(F.col("Pao2"), F.col("imputed")).alias("rmse")
    )


def baseline_classification(clean: DataFrame) -> DataFrame:
    rows = by_formula(clean).select(
        "formula",
        pf_class2(pf_ratio("Pao2", "Fio2")).alias("label"),
        pf_class2(pf_ratio("imputed", "Fio2")).alias("predicted"),
    )
    return binary_rates(rows, ["formula"], "label", "predicted")


def scatter_table(clean: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log ratios with every column they are coloured by."""
    return clean.select(
        *keys,
        F.log10(sf_ratio("Spo2", "Fio2")).alias("log_sf"),
        F.log10(pf_ratio("Pao2", "Fio2")).alias("log_pf"),
        "Spo2", "Pao2", "Sao2", "Vt", "Peep", "Map", "Temperature", "vaso", "Paco2",
    )


def agreement_table(clean: DataFrame, keys: Sequence[str], limit: float = AGREEMENT_LIMIT) -> DataFrame:
    """Measured ratio against its difference from the imputed one, per formula."""
    measured = pf_ratio("Pao2", "Fio2")
    return by_formula(clean).where(measured <= limit).select(
        *keys,
        "formula",
        measured.alias("measured"),
        (measured - pf_ratio("imputed", "Fio2")).alias("difference"),
    )
