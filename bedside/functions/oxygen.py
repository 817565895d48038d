"""Closed-form oxygenation formulas and severity classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import _col, ratio

# Published coefficients and class limits; results depend on every one of them.
LOG_INTERCEPT = 0.48
LOG_SLOPE = 0.78
DISSOCIATION_SCALE = 11700.0
DISSOCIATION_CUBE = 125000.0
SATURATION_LIMIT = 99.9
SATURATION_CLAMP = 99.6
BINARY_LIMIT = 150
CLASS_LIMITS = (100, 200, 300)


def sf_ratio(spo2: Column | str, fio2: Column | str) -> Column:
    return ratio(spo2, fio2)


def pf_ratio(pao2: Column | str, fio2: Column | str) -> Column:
    return ratio(pao2, fio2)


def pao2_log_linear(spo2: Column | str, fio2: Column | str) -> Column:
    log_pf = F.lit(LOG_INTERCEPT) + F.lit(LOG_SLOPE) * F.log10(sf_ratio(spo2, fio2))
    return _col(fio2) * F.pow(F.lit(10.0), log_pf)


def clamp_spo2(spo2: Column | str) -> Column:
    spo2 = _col(spo2)
    return F.when(spo2 > SATURATION_LIMIT, F.lit(SATURATION_CLAMP)).otherwise(spo2)


def pao2_non_linear(spo2: Column | str) -> Column:
    """Root of the cubic dissociation curve; full saturation has none, so clamp first."""
    share = clamp_spo2(spo2) / F.lit(100.0)
    q = F.try_divide(F.lit(DISSOCIATION_SCALE), F.try_divide(F.lit(1.0), share) - F.lit(1.0))
    root = F.sqrt(F.lit(DISSOCIATION_CUBE) + q * q)
    # q - root is negative: cbrt takes it, pow(x, 1/3) would not.
    return F.cbrt(q + root) + F.cbrt(q - root)


def pf_class2(pf: Column | str) -> Column:
    pf = _col(pf)
    return F.when(pf.isNotNull(), F.when(pf <= BINARY_LIMIT, 0).otherwise(1))


def pf_class4(pf: Column | str) -> Column:
    pf = _col(pf)
    low, mid, high = CLASS_LIMITS
    return F.when(
        pf.isNotNull(), F.when(pf > high, 3).when(pf > mid, 2).when(pf > low, 1).otherwise(0)
    )
