"""Queries for cleaning, formulas, statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.functions import oxygen as O
from bedside.functions.columns import linspace, round_half_even
from bedside.operators import cleaning as C, evaluation as X, score_sketch as K, stats as S
from bedside.plans import baselines as B
from bedside.sources.lineage import scratch_folder
from bedside.sources.tables import SAMPLE_SCHEMA, read_samples

from .registry import VIEWS, query
from .temporal import _cohort

VIEWS["in_units"] = """
SELECT * REPLACE (
  CASE WHEN Temperature > 50 THEN (Temperature - 32) / 1.8 ELSE Temperature END AS Temperature,
  CASE WHEN Fio2 > 1 THEN Fio2 / 100 ELSE Fio2 END AS Fio2)
FROM samples"""
VIEWS["clean3"] = """
SELECT * FROM in_units WHERE coalesce(Sao2, 0) <= 800 AND Fio2 IS NOT NULL AND Pao2 IS NOT NULL
  AND Fio2 <> 0 AND Spo2 >= 60 AND Peep <= 40"""
VIEWS["clean7"] = "SELECT * FROM clean3 WHERE Map IS NOT NULL AND Temperature IS NOT NULL AND Vt <= 4000"
VIEWS["imputed"] = """
SELECT *, Pao2 / Fio2 AS pf, Fio2 * pow(10, 0.48 + 0.78 * log10(Spo2 / Fio2)) AS pao2_log,
  cbrt(q + sqrt(125000 + q * q)) + cbrt(q - sqrt(125000 + q * q)) AS pao2_non
FROM (SELECT *, 11700 / (100 / (CASE WHEN Spo2 > 99.9 THEN 99.6 ELSE Spo2 END) - 1) AS q FROM clean3)"""
VIEWS["scored"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS fold,
  CASE WHEN pf <= 150 THEN 0e0 ELSE 1e0 END AS label,
  round(0.48 + 0.78 * log10(Spo2 / Fio2), 6) AS score,
  CASE WHEN pao2_log / Fio2 <= 150 THEN 0e0 ELSE 1e0 END AS predicted, pf, pao2_log / Fio2 AS imputed, Pao2, pao2_log, pao2_non
FROM imputed"""
VIEWS["steps"] = """
SELECT *, sum(n1) OVER w AS tps, sum(n0) OVER w AS fps, sum(n1) OVER (PARTITION BY fold) AS p, sum(n0) OVER (PARTITION BY fold) AS n,
  lead(n1) OVER w AS next1, lead(n0) OVER w AS next0, row_number() OVER w AS nth
FROM (SELECT fold, score, sum(label) AS n1, sum(1 - label) AS n0 FROM scored GROUP BY fold, score)
WINDOW w AS (PARTITION BY fold ORDER BY score DESC)"""
VIEWS["roc_points"] = """
SELECT fold, score AS threshold, fps / n AS fpr, tps / p AS tpr FROM steps
UNION ALL SELECT fold, NULL, 0, 0 FROM steps WHERE nth = 1"""

_ID = "l_orderkey l_linenumber l_partkey l_suppkey".split()
_KEYS = ", ".join(_ID)


def _clean(t, **options):
    return C.clean_cohort(t.samples, **options)


def _scored(t):
    pf, log_pao2 = O.pf_ratio("Pao2", "Fio2"), O.pao2_log_linear("Spo2", "Fio2")
    return _clean(t).select(
        *_ID,
        F.col("l_linenumber").alias("fold"),
        O.pf_class2(pf).cast("double").alias("label"),
        F.round(F.lit(0.48) + 0.78 * F.log10(O.sf_ratio("Spo2", "Fio2")), 6).alias("score"),
        O.pf_class2(log_pao2 / F.col("Fio2")).cast("double").alias("predicted"),
        pf.alias("pf"),
        (log_pao2 / F.col("Fio2")).alias("imputed"),
        "Pao2",
        log_pao2.alias("pao2_log"),
        O.pao2_non_linear("Spo2").alias("pao2_non"),
    )


@query(
    "s2_read_samples",
    "SELECT subject_id, gender, age, Spo2, Fio2, Peep, Vt, Map, Temperature, vaso, Pao2, Sao2, Paco2 FROM samples",
    "age Spo2 Fio2 Peep Vt Map Temperature vaso Pao2 Sao2 Paco2",
)
def _(t):
    path = scratch_folder(t.spark)
    wanted = SAMPLE_SCHEMA.names
    t.samples.select("visit", *reversed(wanted)).write.option("header", True).csv(path)
    return read_samples(t.spark, path)


# --- cleaning --------------------------------------------------------------------------------

_WIDE = "Spo2 Fio2 Peep Vt Map Temperature vaso Pao2 Sao2"


@query("p14_clean_three", f"SELECT {_KEYS}, {_WIDE.replace(' ', ', ')} FROM clean3", _WIDE)
def _(t):
    return _clean(t).select(*_ID, *_WIDE.split())


@query("p14_clean_three_filtered", f"SELECT {_KEYS}, Spo2, Fio2, Pao2 FROM clean3 WHERE Spo2 < 97", "Spo2 Fio2 Pao2")
def _(t):
    return _clean(t, filter_spo2=True).select(*_ID, "Spo2", "Fio2", "Pao2")


@query("p14_clean_seven", f"SELECT {_KEYS}, {_WIDE.replace(' ', ', ')} FROM clean7", _WIDE)
def _(t):
    return _clean(t, seven_features=True).select(*_ID, *_WIDE.split())


@query("p15_normalize_units", f"SELECT {_KEYS}, Temperature, Fio2 FROM in_units", "Temperature Fio2")
def _(t):
    return C.normalize_units(t.samples).select(*_ID, "Temperature", "Fio2")


@query(
    "p16_features_and_label",
    f"SELECT {_KEYS}, Spo2, Fio2, Peep, Vt, Map, Temperature, vaso, Pao2 / Fio2 AS pf, CASE WHEN Pao2 / Fio2 <= 150 THEN 0e0 ELSE 1e0 END AS label FROM clean7",
    "Spo2 Fio2 Peep Vt Map Temperature vaso pf",
)
def _(t):
    return C.with_label(_clean(t, seven_features=True), "class2").select(
        *_ID, *C.feature_columns(True), O.pf_ratio("Pao2", "Fio2").alias("pf"), "label"
    )


_CATS = ", ".join(f"min(TRY_CAST(value AS DOUBLE)) FILTER (category = '{c}') AS {c}" for c in C.CATEGORIES)


@query(
    "b1_to_wide",
    f"""SELECT w.*, d.gender, d.age, coalesce(v.vaso, 0e0) AS vaso FROM (SELECT subject_id, starttime, {_CATS} FROM long_rows GROUP BY ALL) w
    LEFT JOIN (SELECT subject_id, starttime, CAST(max(CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 0 END) AS INT) AS gender, min(age) AS age
               FROM demographics GROUP BY ALL) d USING (subject_id, starttime)
    LEFT JOIN (SELECT DISTINCT m.subject_id, m.starttime, 1e0 AS vaso FROM demographics m
               JOIN durations u ON m.icustay_id = u.icustay_id AND m.charttime BETWEEN u.starttime AND u.endtime) v USING (subject_id, starttime)""",
    "age vaso " + " ".join(C.CATEGORIES),
)
def _(t):
    from bedside.plans.cohort import wide_samples

    return wide_samples(_cohort(t))


# --- formulas --------------------------------------------------------------------------------


@query("f7_pao2_log_linear", f"SELECT {_KEYS}, pao2_log FROM imputed", "pao2_log")
def _(t):
    return _clean(t).select(*_ID, O.pao2_log_linear("Spo2", "Fio2").alias("pao2_log"))


@query("f8_pao2_non_linear", f"SELECT {_KEYS}, pao2_non FROM imputed", "pao2_non")
def _(t):
    return _clean(t).select(*_ID, O.pao2_non_linear("Spo2").alias("pao2_non"))


@query("f9_clamp_spo2", f"SELECT {_KEYS}, CASE WHEN Spo2 > 99.9 THEN 99.6 ELSE Spo2 END AS clamped FROM samples", "clamped")
def _(t):
    return t.samples.select(*_ID, O.clamp_spo2("Spo2").alias("clamped"))


@query(
    "f10_ratios",
    f"SELECT {_KEYS}, Spo2 / nullif(Fio2, 0) AS sf, Pao2 / nullif(Fio2, 0) AS pf FROM samples",
    "sf pf",
)
def _(t):
    return t.samples.select(*_ID, O.sf_ratio("Spo2", "Fio2").alias("sf"), O.pf_ratio("Pao2", "Fio2").alias("pf"))


@query("f11_pf_class2", f"SELECT {_KEYS}, CASE WHEN pf <= 150 THEN 0 ELSE 1 END AS class FROM imputed")
def _(t):
    return _clean(t).select(*_ID, O.pf_class2(O.pf_ratio("Pao2", "Fio2")).alias("class"))


_CLASS4 = "CASE WHEN pf > 300 THEN 3 WHEN pf > 200 THEN 2 WHEN pf > 100 THEN 1 ELSE 0 END"


@query("f12_pf_class4", f"SELECT {_KEYS}, {_CLASS4} AS class FROM imputed")
def _(t):
    return _clean(t).select(*_ID, O.pf_class4(O.pf_ratio("Pao2", "Fio2")).alias("class"))


@query(
    "f13_math",
    f"""SELECT {_KEYS}, log10(Pao2) AS lg, ln(Pao2) AS nl, pow(Spo2, 1.5) AS pw, sqrt(Spo2) AS sq, cbrt(20 - Spo2) AS cb,
        round_even(Pao2 * 100, 0) / 100 AS r2 FROM samples""",
    "lg nl pw sq cb r2",
)
def _(t):
    return t.samples.select(
        *_ID, F.log10("Pao2").alias("lg"), F.ln("Pao2").alias("nl"), F.pow("Spo2", F.lit(1.5)).alias("pw"),
        F.sqrt("Spo2").alias("sq"), F.cbrt(20 - F.col("Spo2")).alias("cb"), round_half_even("Pao2", 2).alias("r2"),
    )


@query(
    "f15_linspace",
    "SELECT c_nationkey, i, i / 9e0 AS g, count(*) AS n FROM customer, range(10) r(i) WHERE c_acctbal / 1e4 >= i / 9e0 GROUP BY ALL",
    "g",
)
def _(t):
    grid = t.customer.select("c_nationkey", "c_acctbal", F.posexplode(linspace(10)).alias("i", "g"))
    return grid.where(F.col("c_acctbal") / 1e4 >= F.col("g")).groupBy(
        "c_nationkey", F.col("i").cast("long").alias("i"), "g"
    ).agg(F.count(F.lit(1)).alias("n"))


# --- statistics ------------------------------------------------------------------------------

_DESCRIBED = ["age", "Spo2", "Fio2", "Peep", "Map"]


@query(
    "a9_describe_columns",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS std, count({c}) AS n FROM clean3" for c in _DESCRIBED
    ),
    "mean std",
)
def _(t):
    return S.describe_columns(_clean(t), _DESCRIBED)


@query(
    "a10_log_ratio_r2",
    """SELECT corr(log10(Spo2 / Fio2), log10(pf)) AS r, pow(corr(log10(Spo2 / Fio2), log10(pf)), 2) AS r2,
       avg(pf) AS pf_mean, stddev_pop(pf) AS pf_std, count(pf) AS n FROM imputed""",
    "r r2 pf_mean pf_std",
)
def _(t):
    return S.log_ratio_r2(_clean(t))


_CORR = ["Spo2", "Fio2", "Peep", "Vt", "Map", "Temperature", "vaso", "Pao2", "sf_ratio", "pf_ratio"]


@query(
    "a11_corr_with",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", corr({c}, pf_ratio) AS corr FROM (SELECT *, Spo2 / Fio2 AS sf_ratio, Pao2 / Fio2 AS pf_ratio FROM clean7)"
        for c in _CORR
    ),
    "corr",
)
def _(t):
    df = _clean(t, seven_features=True).withColumns(
        {"sf_ratio": O.sf_ratio("Spo2", "Fio2"), "pf_ratio": O.pf_ratio("Pao2", "Fio2")}
    )
    return S.corr_with(df, _CORR, "pf_ratio")


@query(
    "a12_freq_of_freq",
    "SELECT occurrences, count(*) AS keys FROM (SELECT subject_id, count(*) AS occurrences FROM clean3 GROUP BY 1) GROUP BY 1",
)
def _(t):
    return S.freq_of_freq(_clean(t), "subject_id")


@query(
    "a13_class_stats",
    f"SELECT {_CLASS4} AS class, avg(pf) AS mean, stddev_pop(pf) AS std, count(pf) AS n FROM imputed GROUP BY 1",
    "mean std",
)
def _(t):
    pf = O.pf_ratio("Pao2", "Fio2")
    return S.class_stats(_clean(t).select(pf.alias("pf"), O.pf_class4(pf).alias("class")), "class", "pf")


@query("a14_class_counts", "SELECT label, count(*) AS n, label * count(*) AS label_sum FROM scored GROUP BY label")
def _(t):
    return S.class_counts(_scored(t), "label")


@query("a15_share", "SELECT 1 - avg(gender) AS female, count(gender) AS n FROM clean3", "female")
def _(t):
    return S.share(_clean(t), "gender", "female")


_PROFILED = {"subject_id": "bigint", "gender": "int", "age": "double", "Map": "double", "Sao2": "double"}


@query(
    "a16_profile",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS non_null, count(*) AS rows FROM samples"
        for c, k in _PROFILED.items()
    ),
)
def _(t):
    return S.profile(t.samples.select(*_PROFILED))


_HIST = ["Spo2", "Peep", "Vt", "Sao2"]


def _hist_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(b AS INT) AS bin, lo + b * (hi - lo) / 10 AS "from", lo + (b + 1) * (hi - lo) / 10 AS "to",
  count({c}) FILTER (least(floor(({c} - lo) / ((hi - lo) / 10)), 9) = b) AS n
FROM clean3, (SELECT min({c}) AS lo, max({c}) AS hi FROM clean3), range(10) r(b) GROUP BY b, lo, hi"""


@query("a17_histogram", "\nUNION ALL ".join(map(_hist_sql, _HIST)), '"from" "to"')
def _(t):
    return S.histogram(_clean(t), _HIST)


# --- evaluation ------------------------------------------------------------------------------


@query(
    "a18_rmse",
    "SELECT fold, count(*) AS n, sqrt(avg((pao2_log - Pao2) ** 2)) AS rmse FROM scored GROUP BY fold",
    "rmse",
)
def _(t):
    return X.regression_metrics(_scored(t), ["fold"], "Pao2", "pao2_log", 3).drop("bic")


@query(
    "a19_bic_regression",
    "SELECT fold, count(*) * ln(avg((pao2_log - Pao2) ** 2)) + 3 * ln(count(*)) AS bic FROM scored GROUP BY fold",
    "bic",
)
def _(t):
    return X.regression_metrics(_scored(t), ["fold"], "Pao2", "pao2_log", 3).select("fold", "bic")


@query(
    "a20_bic_classification",
    "SELECT fold, count(*) * ln(sum((score / 4 - label) ** 2) / count(*)) + 7 * ln(count(*)) AS bic FROM scored GROUP BY fold",
    "bic",
)
def _(t):
    bic = X.bic_classification(F.col("label"), F.col("score") / 4, 7)
    return _scored(t).groupBy("fold").agg(bic.alias("bic"))


VIEWS["cm"] = """
SELECT fold, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp
FROM scored GROUP BY fold"""


VIEWS["exact_auc"] = """
SELECT fold, sum(n0 * (tps - n1 / 2)) / (max(p) * max(n)) AS auc, sum(n1 * tps / (tps + fps)) / max(p) AS ap, max(p) AS positives, max(n) AS negatives FROM steps GROUP BY fold"""


@query(
    "a23_auc_sketch",
    "SELECT fold, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, auc, ap, true AS auc_within, true AS ap_within, true AS few_rows FROM exact_auc",
    "auc ap",
)
def _(t):
    """Exact areas beside those of a sketch of 64 bins, and whether these are as near as the sketch says."""
    scored = _scored(t)
    edges = K.score_edges(scored, "score", 64)
    sketch = K.score_sketch(scored, ["fold"], "label", "score", edges)
    exact = X.ranking_metrics(scored, ["fold"], "label", "score").withColumnsRenamed({"roc_auc": "auc", "average_precision": "ap"})
    both = K.sketch_metrics(sketch, ["fold"]).join(exact, "fold").join(sketch.groupBy("fold").count(), "fold")
    return both.select(
        "fold", "positives", "negatives", "auc", "ap",
        (F.abs(F.col("auc") - F.col("roc_auc")) <= F.col("roc_auc_error") + 1e-12).alias("auc_within"),
        (F.abs(F.col("ap") - F.col("average_precision")) <= F.col("average_precision_error") + 1e-12).alias("ap_within"),
        (F.col("count") <= 64).alias("few_rows"),
    )


@query("a21_confusion", "SELECT * FROM cm")
def _(t):
    return X.confusion(_scored(t), ["fold"], "label", "predicted")


@query(
    "a22_binary_rates",
    """SELECT fold, tn, fp, fn, tp, tp / nullif(tp + fp, 0) AS ppv, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity,
      tn / nullif(tn + fn, 0) AS npv, (tp / nullif(tp + fn, 0)) / nullif(1 - tn / nullif(tn + fp, 0), 0) AS pos_lr,
      (1 - tp / nullif(tp + fn, 0)) / nullif(tn / nullif(tn + fp, 0), 0) AS neg_lr,
      2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM cm""",
    "ppv sensitivity specificity npv pos_lr neg_lr f1 accuracy",
)
def _(t):
    return X.binary_rates(_scored(t), ["fold"], "label", "predicted")


_AUC = """SELECT fold, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS roc_auc
FROM (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY score)
        + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS r FROM scored) GROUP BY fold"""


@query("a23_roc_auc", _AUC, "roc_auc")
def _(t):
    return X.roc_auc(_scored(t), ["fold"], "label", "score")


@query("a23_roc_auc_sliced", _AUC, "roc_auc")
def _(t):
    return X.roc_auc(_scored(t), ["fold"], "label", "score", hot_rows=50)


@query("a24_average_precision", "SELECT fold, sum(n1 / p * tps / (tps + fps)) AS average_precision FROM steps GROUP BY fold", "average_precision")
def _(t):
    return X.average_precision(_scored(t), ["fold"], "label", "score")


_ROC = """SELECT fold, score AS threshold, fps / n AS fpr, tps / p AS tpr FROM steps
  WHERE nth = 1 OR next1 IS NULL OR next1 <> n1 OR next0 <> n0
UNION ALL SELECT fold, NULL, 0, 0 FROM steps WHERE nth = 1"""


@query("a25_roc_curve", _ROC, "threshold fpr tpr")
def _(t):
    return X.roc_curve(_scored(t), ["fold"], "label", "score")


@query("a25_roc_curve_sliced", _ROC, "threshold fpr tpr")
def _(t):
    return X.roc_curve(_scored(t), ["fold"], "label", "score", hot_rows=50)


_INTERP = """
SELECT fold, CAST(i AS INT) AS i, i / 99e0 AS fpr, y0 + CASE WHEN x1 IS NULL THEN 0 ELSE (y1 - y0) / (x1 - x0) * (i / 99e0 - x0) END AS tpr
FROM range(100) g(i) JOIN (
  SELECT fold, fpr AS x0, max(tpr) AS y0, lead(fpr) OVER w AS x1, lead(min(tpr)) OVER w AS y1
  FROM roc_points GROUP BY fold, fpr WINDOW w AS (PARTITION BY fold ORDER BY fpr)) ON x0 <= i / 99e0 AND (x1 IS NULL OR i / 99e0 < x1)"""


@query("a26_interp_curve", _INTERP, "fpr tpr")
def _(t):
    return X.interp_curve(X.roc_curve(_scored(t), ["fold"], "label", "score"), ["fold"])


@query("a26_interp_curve_sliced", _INTERP, "fpr tpr")
def _(t):
    return X.interp_curve(X.roc_curve(_scored(t), ["fold"], "label", "score"), ["fold"], hot_rows=50)


_PR = """SELECT fold, score AS threshold, tps / (tps + fps) AS precision, tps / p AS recall FROM steps WHERE tps - n1 < p
UNION ALL SELECT fold, NULL, 1, 0 FROM steps WHERE nth = 1"""


@query("a27_pr_curve", _PR, "threshold precision recall")
def _(t):
    return X.pr_curve(_scored(t), ["fold"], "label", "score")


_AGREE = """SELECT fold, count(*) AS n, avg(d) AS mean_diff, stddev_pop(d) AS sd_diff, avg(d) - 1.96 * stddev_pop(d) AS lower,
  avg(d) + 1.96 * stddev_pop(d) AS upper, regr_slope(d, pf) AS slope, regr_intercept(d, pf) AS intercept
FROM (SELECT *, pf - imputed AS d FROM scored WHERE pf <= 400) GROUP BY fold"""


@query("a28_agreement", _AGREE, "mean_diff sd_diff lower upper slope intercept")
def _(t):
    return X.agreement(_scored(t), ["fold"], "pf", "imputed")


@query("a29_ols", "SELECT fold, regr_slope(pf - imputed, pf) AS slope, regr_intercept(pf - imputed, pf) AS intercept FROM scored GROUP BY fold", "slope intercept")
def _(t):
    return X.ols(_scored(t), ["fold"], F.col("pf") - F.col("imputed"), F.col("pf"))


@query(
    "a30_fold_summary",
    "SELECT avg(accuracy) AS mean, count(accuracy) AS folds, 'log_linear' AS model FROM (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM cm)",
    "mean",
)
def _(t):
    rates = X.binary_rates(_scored(t), ["fold"], "label", "predicted").withColumn("model", F.lit("log_linear"))
    return X.fold_summary(rates, ["model"], "accuracy")


# --- baselines and figure tables -------------------------------------------------------------


@query(
    "m19_baseline_regression",
    """SELECT 'log_linear' AS formula, count(*) AS n, sqrt(avg((pao2_log - Pao2) ** 2)) AS rmse FROM scored
       UNION ALL SELECT 'non_linear', count(*), sqrt(avg((pao2_non - Pao2) ** 2)) FROM scored""",
    "rmse",
)
def _(t):
    return B.baseline_regression(_clean(t))


VIEWS["formula_cm"] = """
SELECT formula, count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 0 AND h = 1) AS fp,
  count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 1 AND h = 1) AS tp
FROM (SELECT 'log_linear' AS formula, CASE WHEN pf <= 150 THEN 0 ELSE 1 END AS y, CASE WHEN pao2_log / Fio2 <= 150 THEN 0 ELSE 1 END AS h FROM imputed
      UNION ALL SELECT 'non_linear', CASE WHEN pf <= 150 THEN 0 ELSE 1 END, CASE WHEN pao2_non / Fio2 <= 150 THEN 0 ELSE 1 END FROM imputed)
GROUP BY formula"""


@query(
    "m19_baseline_classification",
    """SELECT formula, tn, fp, fn, tp, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity,
      2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM formula_cm""",
    "sensitivity specificity f1 accuracy",
)
def _(t):
    return B.baseline_classification(_clean(t)).select(
        "formula", "tn", "fp", "fn", "tp", "sensitivity", "specificity", "f1", "accuracy"
    )


@query(
    "m21_scatter_table",
    f"SELECT {_KEYS}, log10(Spo2 / Fio2) AS log_sf, log10(pf) AS log_pf, Spo2, Pao2, Sao2, Vt, Peep, Map, Temperature, vaso, Paco2 FROM imputed",
    "log_sf log_pf Spo2 Pao2 Sao2 Vt Peep Map Temperature vaso Paco2",
)
def _(t):
    return B.scatter_table(_clean(t), _ID)


@query(
    "m21_agreement_table",
    f"""SELECT {_KEYS}, 'log_linear' AS formula, pf AS measured, pf - pao2_log / Fio2 AS difference FROM imputed WHERE pf <= 400
    UNION ALL SELECT {_KEYS}, 'non_linear', pf, pf - pao2_non / Fio2 FROM imputed WHERE pf <= 400""",
    "measured difference",
)
def _(t):
    return B.agreement_table(_clean(t), _ID)


@query(
    "m21_pr_curves_by_subset",
    """SELECT subset, score AS threshold, tps / (tps + fps) AS precision, tps / p AS recall FROM (
         SELECT *, sum(n1) OVER w AS tps, sum(n0) OVER w AS fps, sum(n1) OVER (PARTITION BY subset) AS p
         FROM (SELECT subset, score, sum(label) AS n1, sum(1 - label) AS n0
               FROM (SELECT 'whole' AS subset, pf, Spo2, Fio2 FROM imputed UNION ALL SELECT 'filtered', pf, Spo2, Fio2 FROM imputed WHERE Spo2 < 97),
                 LATERAL (SELECT CASE WHEN pf <= 150 THEN 0e0 ELSE 1e0 END AS label, round(0.48 + 0.78 * log10(Spo2 / Fio2), 6) AS score)
               GROUP BY subset, score)
         WINDOW w AS (PARTITION BY subset ORDER BY score DESC)) WHERE tps - n1 < p
       UNION ALL SELECT DISTINCT subset, NULL, 1, 0 FROM (VALUES ('whole'), ('filtered')) v(subset)""",
    "threshold precision recall",
)
def _(t):
    rows = _clean(t).select(
        F.explode(
            F.when(F.col("Spo2") < C.SPO2_LIMIT, F.array(F.lit("whole"), F.lit("filtered"))).otherwise(F.array(F.lit("whole")))
        ).alias("subset"),
        O.pf_class2(O.pf_ratio("Pao2", "Fio2")).alias("label"),
        F.round(F.lit(0.48) + 0.78 * F.log10(O.sf_ratio("Spo2", "Fio2")), 6).alias("score"),
    )
    return X.pr_curve(rows, ["subset"], "label", "score")
