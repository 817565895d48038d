"""From wide samples to a clean feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import nan_to_null, to_double
from ..functions.oxygen import pf_class2, pf_class4, pf_ratio

# Plausibility limits and feature sets; results depend on every one of them.
MAX_SAO2 = 800
MIN_SPO2 = 60
SPO2_LIMIT = 97
MAX_PEEP = 40
MAX_VT = 4000
FAHRENHEIT_FROM = 50
PERCENT_FROM = 1
FEATURES_3 = ("Spo2", "Fio2", "Peep")
FEATURES_7 = ("Spo2", "Fio2", "Peep", "Vt", "Map", "Temperature", "vaso")
CATEGORIES = (
    "Spo2", "Fio2", "Peep", "Vt", "Map", "Temperature", "Mv",
    "Pao2", "Paco2", "Sao2", "Ph", "Hemoglobin", "Co2",
)


def missing_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({n: nan_to_null(n) for n, t in df.dtypes if t in ("double", "float")})


def normalize_units(df: DataFrame) -> DataFrame:
    """Temperatures to Celsius, oxygen shares to fractions."""
    t, f = F.col("Temperature"), F.col("Fio2")
    return df.withColumns(
        {
            "Temperature": F.when(t > FAHRENHEIT_FROM, (t - 32) / 1.8).otherwise(t),
            "Fio2": F.when(f > PERCENT_FROM, f / 100).otherwise(f),
        }
    )


def _known(name: str):
    return F.col(name).isNotNull() & ~F.isnan(name)


def clean_cohort(
    df: DataFrame, *, filter_spo2: bool = False, seven_features: bool = False
) -> DataFrame:
    """Plausible samples in common units.

    A missing Sao2 stays, any other missing value that a rule looks at drops the sample. Changing the
    units makes no value missing or zero, so all rules look at the stored columns and reach the
    scan; NaN is above every number in Spark, so only lower bounds have to exclude it.
    """
    rule = (
        (F.col("Sao2").isNull() | F.isnan("Sao2") | (F.col("Sao2") <= MAX_SAO2))
        & _known("Pao2")
        & (F.col("Fio2") != 0)
        & ~F.isnan("Fio2")
        & (F.col("Spo2") >= MIN_SPO2)
        & ~F.isnan("Spo2")
        & (F.col("Peep") <= MAX_PEEP)
    )
    if filter_spo2:
        rule = rule & (F.col("Spo2") < SPO2_LIMIT)
    if seven_features:
        rule = rule & _known("Map") & _known("Temperature") & (F.col("Vt") <= MAX_VT)
    return normalize_units(missing_to_null(df.where(rule)))


def feature_columns(seven_features: bool) -> list[str]:
    return list(FEATURES_7 if seven_features else FEATURES_3)


def with_label(df: DataFrame, kind: str, name: str = "label") -> DataFrame:
    """``pao2`` (measured value), ``class2`` or ``class4`` (severity of the measured ratio)."""
    pf = pf_ratio("Pao2", "Fio2")
    label = {"pao2": F.col("Pao2"), "class2": pf_class2(pf), "class4": pf_class4(pf)}[kind]
    return df.withColumn(name, label.cast("double"))


def to_wide(
    long: DataFrame,
    demographics: DataFrame,
    key: Sequence[str] = ("subject_id", "starttime"),
    categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """One row per ``key`` (by default an episode of a patient: a patient may have several samples) with a numeric column per category, plus age, gender and vasopressor flag.

    ``demographics`` has ``gender``, ``age`` and optionally ``vaso``, several rows per key allowed. An unknown gender stays NULL.
    The category list is fixed, so the pivot needs no pass of its own.
    """
    wide = (
        long.groupBy(*key).pivot("category", list(categories)).agg(F.min(to_double("value")))
    )
    vaso = F.max("vaso") if "vaso" in demographics.columns else F.lit(0)
    people = demographics.groupBy(*key).agg(
        F.max(F.when(F.col("gender") == "M", 1).when(F.col("gender") == "F", 0)).alias("gender"),
        F.min("age").alias("age"),
        vaso.alias("vaso"),
    )
    return wide.join(people, list(key), "left").withColumn(
        "vaso", F.coalesce(F.col("vaso"), F.lit(0)).cast("double")
    )
