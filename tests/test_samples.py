"""Cleaning rules, formulas and evaluation on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedside.functions.columns import linspace, parse_float_array, round_half_even
from bedside.functions.oxygen import clamp_spo2, pao2_log_linear, pao2_non_linear, pf_class2, pf_class4
from bedside.operators.cleaning import clean_cohort, normalize_units, to_wide
from bedside.operators.evaluation import (
    agreement, average_precision, binary_rates, interp_curve, pr_curve, roc_auc, roc_curve,
)
from bedside.operators.stats import freq_of_freq, histogram, profile
from helpers import rows

COLUMNS = ["Spo2", "Fio2", "Peep", "Vt", "Map", "Temperature", "Pao2", "Sao2"]
GOOD = dict(Spo2=90.0, Fio2=0.5, Peep=5.0, Vt=400.0, Map=70.0, Temperature=37.0, Pao2=80.0, Sao2=95.0)


def keeps(spark, seven=True, filtered=False, **change):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row[c] for c in COLUMNS)], ", ".join(f"{c} double" for c in COLUMNS))
    return clean_cohort(df, seven_features=seven, filter_spo2=filtered).count() == 1


@pytest.mark.parametrize(
    "change, kept",
    [
        ({}, True), ({"Spo2": 59.0}, False), ({"Spo2": 60.0}, True), ({"Peep": 40.0}, True), ({"Peep": 40.1}, False),
        ({"Vt": 4000.0}, True), ({"Vt": 4001.0}, False), ({"Sao2": None}, True), ({"Sao2": 800.0}, True),
        ({"Sao2": 801.0}, False), ({"Fio2": 0.0}, False), ({"Fio2": None}, False), ({"Pao2": None}, False),
        ({"Map": None}, False), ({"Temperature": None}, False), ({"Peep": None}, False), ({"Spo2": None}, False),
        ({"Vt": None}, False),
    ]
    + [({c: math.nan}, c == "Sao2") for c in COLUMNS],
)
def test_truth_table(spark, change, kept):
    assert keeps(spark, **change) is kept


def test_optional_rules(spark):
    assert keeps(spark, filtered=True, Spo2=96.9) and not keeps(spark, filtered=True, Spo2=97.0)
    assert keeps(spark, seven=False, Vt=9000.0, Map=None, Temperature=None)


def test_units(spark):
    df = spark.createDataFrame([(50.0, 1.0), (98.6, 21.0), (37.0, 0.4)], "Temperature double, Fio2 double")
    got = [tuple(round(x, 9) for x in r) for r in normalize_units(df).collect()]
    assert got == [(50.0, 1.0), (37.0, 0.21), (37.0, 0.4)]


def test_formulas(spark):
    df = spark.createDataFrame([(90.0, 0.5), (100.0, 0.5), (99.9, 0.5)], "s double, f double")
    out = df.select(pao2_log_linear("s", "f").alias("l"), pao2_non_linear("s").alias("n"), clamp_spo2("s").alias("c")).collect()
    for (s, f), r in zip([(90.0, 0.5), (100.0, 0.5), (99.9, 0.5)], out):
        assert r["l"] == pytest.approx(f * 10 ** (0.48 + 0.78 * math.log10(s / f)))
        c = 99.6 if s > 99.9 else s
        q = 11700 / (1 / (c / 100) - 1)
        root = math.sqrt(50**3 + q * q)
        assert r["c"] == c
        assert r["n"] == pytest.approx(np.cbrt(q + root) + np.cbrt(q - root))


def test_classes(spark):
    df = spark.createDataFrame([(x,) for x in (100.0, 100.1, 150.0, 150.1, 200.0, 300.0, 300.1, None)], "pf double")
    out = df.select(pf_class2("pf"), pf_class4("pf")).collect()
    assert [tuple(r) for r in out] == [(0, 0), (0, 1), (0, 1), (1, 1), (1, 1), (1, 2), (1, 3), (None, None)]


def test_text_arrays_and_grid(spark):
    df = spark.createDataFrame([("[0.1  0.25\n 1.]",), ("[]",), ("[1e-3, x]",)], "t string")
    assert [r[0] for r in df.select(parse_float_array("t")).collect()] == [[0.1, 0.25, 1.0], [], [0.001, None]]
    assert df.select(linspace(100)).first()[0] == pytest.approx(list(np.linspace(0, 1, 100)))
    assert spark.range(1).select(round_half_even(F.lit(0.125), 2)).first()[0] == 0.12


SCORES = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 1)]


@pytest.fixture(params=[None, 1], ids=["plain", "sliced"])
def hot_rows(request):
    return request.param


@pytest.fixture()
def scored(spark):
    return spark.createDataFrame([("m", s, y) for s, y in SCORES], "model string, score double, label int")


def test_ranking(scored, hot_rows):
    assert roc_auc(scored, ["model"], "label", "score", hot_rows=hot_rows).first()["roc_auc"] == pytest.approx(2.5 / 6)
    ap = average_precision(scored, ["model"], "label", "score", hot_rows=hot_rows).first()
    assert ap["average_precision"] == pytest.approx(0.7)


def test_curves(scored, hot_rows):
    roc = roc_curve(scored, ["model"], "label", "score", drop_intermediate=False, hot_rows=hot_rows)
    points = sorted((r["fpr"], r["tpr"]) for r in roc.collect())
    assert np.array(points) == pytest.approx(np.array([(0, 0), (0, 1 / 3), (0.5, 1 / 3), (1, 2 / 3), (1, 1)]))
    grid = interp_curve(roc, ["model"], n=5, hot_rows=hot_rows).orderBy("i").collect()
    # like numpy: at a repeated x the last value counts
    assert [r["tpr"] for r in grid] == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0.5, 1.0])
    pr = pr_curve(scored, ["model"], "label", "score", hot_rows=hot_rows).collect()
    assert np.array(sorted((r["recall"], r["precision"]) for r in pr)) == pytest.approx(
        np.array([(0.0, 1.0), (1 / 3, 0.5), (1 / 3, 1.0), (2 / 3, 0.5), (1.0, 0.6)])
    )


def test_straight_points_are_left_out(spark):
    df = spark.createDataFrame([("m", s / 10, int(s > 5)) for s in range(1, 11)], "model string, score double, label int")
    full = roc_curve(df, ["model"], "label", "score", drop_intermediate=False)
    short = roc_curve(df, ["model"], "label", "score")
    assert full.count() == 11 and sorted((r["fpr"], r["tpr"]) for r in short.collect()) == [(0, 0), (0, 0.2), (0, 1), (1, 1)]


def test_pr_curve_stops_at_full_recall(spark):
    df = spark.createDataFrame([("m", 0.9, 1), ("m", 0.5, 0), ("m", 0.1, 0)], "model string, score double, label int")
    assert sorted((r["recall"], r["precision"]) for r in pr_curve(df, ["model"], "label", "score").collect()) == [(0.0, 1.0), (1.0, 1.0)]


def test_rates_without_denominator_are_null(spark):
    df = spark.createDataFrame([("m", 1, 1), ("m", 1, 1)], "model string, label int, predicted int")
    r = binary_rates(df, ["model"], "label", "predicted").first()
    assert (r["ppv"], r["sensitivity"], r["f1"], r["accuracy"]) == (1.0, 1.0, 1.0, 1.0)
    assert (r["specificity"], r["npv"], r["pos_lr"], r["neg_lr"]) == (None, None, None, None)


def test_agreement_limit(spark):
    df = spark.createDataFrame([("m", 100.0, 90.0), ("m", 400.0, 380.0), ("m", 401.0, 0.0)], "model string, y double, p double")
    r = agreement(df, ["model"], "y", "p").first()
    assert (r["n"], r["mean_diff"], r["sd_diff"]) == (2, 15.0, 5.0)
    assert r["lower"] == pytest.approx(15 - 1.96 * 5) and r["slope"] == pytest.approx(10 / 300)


def test_statistics(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 10.0), (3, None)], "k int, v double")
    assert rows(freq_of_freq(df, "k")) == [(1, 2), (2, 1)]
    counts = [r["n"] for r in histogram(df, ["v"], 10).orderBy("bin").collect()]
    assert counts == list(np.histogram([0.0, 1.0, 10.0], 10)[0])
    assert rows(profile(df), "column", "type", "non_null", "rows") == [("k", "int", 4, 4), ("v", "double", 3, 4)]


def test_wide_form(spark):
    long = spark.createDataFrame(
        [(1, 10, "Spo2", "95"), (1, 10, "Spo2", "94"), (1, 10, "Peep", "n/a"), (1, 20, "Spo2", "88"), (2, 10, "Fio2", "0.4")],
        "subject_id long, starttime long, category string, value string",
    )
    people = spark.createDataFrame(
        [(1, 10, "M", 60.0, 1), (1, 10, "M", 60.0, 0), (1, 20, None, 61.0, 0)],
        "subject_id long, starttime long, gender string, age double, vaso int",
    )
    out = to_wide(long, people)
    assert rows(out, "subject_id", "starttime", "Spo2", "Peep", "Fio2", "gender", "age", "vaso") == [
        (1, 10, 94.0, None, None, 1, 60.0, 1.0), (1, 20, 88.0, None, None, None, 61.0, 0.0), (2, 10, None, None, 0.4, None, None, 0.0),
    ]
