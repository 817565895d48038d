"""Queries for scaling, folds, models and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bedside.functions import oxygen as O
from bedside.operators import cleaning as C, evaluation as X, folds as D, models as L
from bedside.operators.batched import spread
from bedside.operators.fold_models import fit_folds
from bedside.plans import evaluation_runs as R, predictions as P
from bedside.sources.lineage import scratch_folder, written
from bedside.sources.models import Variant, load_model

from .registry import VIEWS, query
from .samples import _ID, _KEYS, _clean, _scored

_HASH = "l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber"
_F3 = list(C.FEATURES_3)

VIEWS["folded"] = f"SELECT *, CAST(({_HASH}) % 10 AS INT) AS fold FROM clean3"
# All rows outside a fold, with the fold they are the training set of.
VIEWS["train"] = "SELECT g.held_out, s.* FROM folded s JOIN (SELECT DISTINCT fold AS held_out FROM folded) g ON s.fold <> g.held_out"


def _folded(t):
    return D.assign_folds(_clean(t), _ID, 10, hashed=F.expr(_HASH))


@query(
    "m1_zscore_train_only",
    f"""SELECT {_KEYS}, fold, (Spo2 - m1) / s1 AS z_Spo2, (Fio2 - m2) / s2 AS z_Fio2, vaso AS z_vaso FROM folded
    JOIN (SELECT held_out, avg(Spo2) AS m1, stddev_pop(Spo2) AS s1, avg(Fio2) AS m2, stddev_pop(Fio2) AS s2 FROM train GROUP BY held_out) ON fold = held_out""",
    "z_Spo2 z_Fio2 z_vaso",
)
def _(t):
    scaled = D.zscore_by_fold(_folded(t), ["Spo2", "Fio2", "vaso"], passthrough=["vaso"])
    return scaled.select(*_ID, "fold", "z_Spo2", "z_Fio2", "z_vaso")


@query(
    "m2_label_scale_and_back",
    f"SELECT {_KEYS}, (Pao2 - (SELECT avg(Pao2) FROM clean3)) / (SELECT stddev_pop(Pao2) FROM clean3) AS scaled, Pao2 AS back FROM clean3",
    "scaled back",
)
def _(t):
    rows = _clean(t)
    m, _ = D.fold_moments(rows.withColumn("fold", F.lit(0)), ["Pao2"])
    scaled = rows.withColumn("scaled", D.zscore_exprs(m, ["Pao2"])["Pao2"])
    back = F.col("scaled") * m.spread("Pao2") + m.center("Pao2")
    return scaled.select(*_ID, "scaled", back.alias("back"))


@query("m3_assign_folds", f"SELECT {_KEYS}, fold FROM folded")
def _(t):
    return _folded(t).select(*_ID, "fold")


@query(
    "m3_exact_folds_sizes",
    "SELECT CAST(i AS INT) AS fold, (SELECT count(*) FROM clean3) // 10 + CASE WHEN i < (SELECT count(*) FROM clean3) % 10 THEN 1 ELSE 0 END AS n FROM range(10) r(i)",
)
def _(t):
    return D.exact_folds(_clean(t), _ID).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("m4_train_test", f"SELECT {_KEYS}, ({_HASH}) % 10000 < 3000 AS is_test FROM clean3")
def _(t):
    return D.train_test(_clean(t), _ID, 0.3, hashed=F.expr(_HASH)).select(*_ID, "is_test")


def _solve_sql(alpha: str, train: str = "train", y: str = "Pao2", sy: str = "stddev_pop(Pao2)") -> str:
    """Three-feature least squares or ridge per training set: normal equations with Cramer's rule."""
    names = {"a": "Spo2", "b": "Fio2", "c": "Peep"}
    cov = ", ".join(
        f"count(*) * covar_pop({names[i]}, {names[j]}) / (stddev_pop({names[i]}) * stddev_pop({names[j]})) AS {i}{j}"
        for i, j in ("aa", "ab", "ac", "bb", "bc", "cc")
    )
    tgt = ", ".join(
        f"count(*) * covar_pop({v}, {y}) / (stddev_pop({v}) * {sy}) AS t{k}, avg({v}) AS m{k}, stddev_pop({v}) AS s{k}"
        for k, v in names.items()
    )
    return f"""
SELECT held_out, wa * sy / sa AS b_Spo2, wb * sy / sb AS b_Fio2, wc * sy / sc AS b_Peep,
  my - wa * sy / sa * ma - wb * sy / sb * mb - wc * sy / sc * mc AS b_0
FROM (SELECT *,
    (ta * (bb * cc - bc * bc) - ab * (tb * cc - bc * tc) + ac * (tb * bc - bb * tc)) / det AS wa,
    (aa * (tb * cc - bc * tc) - ta * (ab * cc - bc * ac) + ac * (ab * tc - tb * ac)) / det AS wb,
    (aa * (bb * tc - tb * bc) - ab * (ab * tc - tb * ac) + ta * (ab * bc - bb * ac)) / det AS wc
  FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det
    FROM (SELECT * REPLACE (aa + {alpha} AS aa, bb + {alpha} AS bb, cc + {alpha} AS cc)
      FROM (SELECT held_out, {cov}, {tgt}, count(*) AS n, avg({y}) AS my, {sy} AS sy FROM {train} GROUP BY held_out))))"""


VIEWS["ols_fit"] = _solve_sql("0")
VIEWS["ridge_fit"] = _solve_sql("1")
VIEWS["sgd_fit"] = _solve_sql("0.0001 * n")
VIEWS["train_sign"] = "SELECT *, CASE WHEN Pao2 / Fio2 <= 150 THEN -1e0 ELSE 1e0 END AS side FROM train"
VIEWS["side_fit"] = _solve_sql("1", "train_sign", "side", "1e0")
VIEWS["everything"] = "SELECT -1 AS held_out, * FROM clean3"
VIEWS["whole_fit"] = _solve_sql("0", "everything")
VIEWS["filtered"] = "SELECT -1 AS held_out, * FROM clean3 WHERE Spo2 < 97"
VIEWS["filtered_fit"] = _solve_sql("0", "filtered")


def _predict_sql(view: str) -> str:
    return f"""SELECT {_KEYS}, fold, b_0 + b_Spo2 * Spo2 + b_Fio2 * Fio2 + b_Peep * Peep AS predicted
FROM folded JOIN {view} ON fold = held_out"""


@query("m5_linear_out_of_fold", _predict_sql("ols_fit"), "predicted")
def _(t):
    return D.cross_validated_linear(_folded(t), _F3, "Pao2").select(*_ID, "fold", "predicted")


@query("m6_ridge_out_of_fold", _predict_sql("ridge_fit"), "predicted")
def _(t):
    return D.cross_validated_linear(_folded(t), _F3, "Pao2", L.RIDGE_ALPHA).select(*_ID, "fold", "predicted")


@query("m7_sgd_out_of_fold", _predict_sql("sgd_fit"), "predicted")
def _(t):
    predicted = D.cross_validated_linear(_folded(t), _F3, "Pao2", L.SGD_PENALTY, per_row=True)
    return predicted.select(*_ID, "fold", "predicted")


@query("m12_ridge_margin_out_of_fold", _predict_sql("side_fit").replace("AS predicted", "AS margin"), "margin")
def _(t):
    sides = C.with_label(_folded(t), "class2").withColumn("side", F.col("label") * 2 - 1)
    scored = D.cross_validated_linear(
        sides, _F3, "side", L.RIDGE_ALPHA, scale_label=False, name="margin"
    )
    return scored.select(*_ID, "fold", "margin")


@query(
    "m16_linear_fold_metrics",
    f"""SELECT fold, count(*) AS n, sqrt(avg((predicted - Pao2) ** 2)) AS rmse,
        count(*) * ln(avg((predicted - Pao2) ** 2)) + 3 * ln(count(*)) AS bic
      FROM (SELECT fold, Pao2, b_0 + b_Spo2 * Spo2 + b_Fio2 * Fio2 + b_Peep * Peep AS predicted FROM folded JOIN ols_fit ON fold = held_out)
      GROUP BY fold""",
    "rmse bic",
)
def _(t):
    scored = D.cross_validated_linear(_folded(t), _F3, "Pao2")
    return X.regression_metrics(scored, ["fold"], "Pao2", "predicted", 3)


# --- fitted models: SQL cannot fit them, so what it can say about them is checked ---------------

VIEWS["folded7"] = f"SELECT *, CAST(({_HASH}) % 10 AS INT) AS fold FROM clean7"


def _prepared(t, variant: Variant):
    """Key, features, label and the fold that SQL can name."""
    rows = _clean(t, filter_spo2=variant.filter_spo2, seven_features=variant.seven_features)
    kind = "pao2" if variant.task == "regression" else "class4" if variant.model == "multi" else "class2"
    labelled = C.with_label(rows, kind).select(*_ID, *C.feature_columns(variant.seven_features), "label")
    return D.assign_folds(labelled, _ID, 10, hashed=F.expr(_HASH))


def _better(scored, variant: Variant):
    """Per fold: does the model explain most of the spread, or as much as a line does (regression); does it beat chance
    (two classes) or the most frequent class (four)?"""
    if variant.task == "regression":
        linear = D.cross_validated_linear(scored, C.feature_columns(variant.seven_features), "label", name="line")
        error, width = X.rmse(F.col("label"), F.col("predicted")), F.stddev_pop("label")
        explains = (error < 0.5 * width) | (error <= 1.02 * X.rmse(F.col("label"), F.col("line")))
        return linear.groupBy("fold").agg(explains.alias("better"))
    if variant.model == "multi":
        most = scored.groupBy("fold", "label").count().groupBy("fold").agg((F.max("count") / F.sum("count")).alias("share"))
        got = X.class_metrics(scored, ["fold"], "label", "predicted").groupBy("fold").agg(F.max("accuracy").alias("accuracy"))
        return got.join(most, "fold").select("fold", (F.col("accuracy") > F.col("share")).alias("better"))
    return X.roc_auc(scored, ["fold"], "label", "score").select("fold", (F.col("roc_auc") > 0.5).alias("better"))


def _verify(t, variant: Variant, settled: float | None = None):
    """Per fold: rows, sum of the labels, whether all rows have a prediction, and whether the model learned something."""
    together = settled is not None or variant.model in ("kernel_huber", "kernel_svc", "mlp")
    rows = written(spread(_prepared(t, variant)) if together else _prepared(t, variant))
    features, flags = C.feature_columns(variant.seven_features), ["vaso"] if variant.seven_features else []
    if settled is None:
        scored, closed = R.cross_validate_rows(rows, variant), {}
    else:
        models = fit_folds(rows, _ID, variant.task, variant.model, features, flags)
        scored = models.predict(rows)
        closed = {"settled": D.by_fold(dict(zip(models.scale.models, map(float, models.settled)))) < settled}
    scored = written(scored)
    each = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), (F.count("predicted") == F.count(F.lit(1))).alias("all_scored")
    )
    return each.join(_better(scored, variant), "fold").select("*", *[c.alias(k) for k, c in closed.items()])


def _register(name: str, variant: Variant, settled: float | None = None) -> None:
    label = {"regression": "Pao2", "classification": "CASE WHEN Pao2 / Fio2 <= 150 THEN 0e0 ELSE 1e0 END"}[variant.task]
    if variant.model == "multi":
        label = "CASE WHEN Pao2 / Fio2 > 300 THEN 3e0 WHEN Pao2 / Fio2 > 200 THEN 2e0 WHEN Pao2 / Fio2 > 100 THEN 1e0 ELSE 0e0 END"
    table, more = "folded7" if variant.seven_features else "folded", "" if settled is None else ", true AS settled"

    @query(name, f"SELECT fold, count(*) AS n, sum({label}) AS labels, true AS all_scored, true AS better{more} FROM {table} GROUP BY fold", "labels")
    def _(t):
        return _verify(t, variant, settled)


# Spark ML's estimators, a fit a fold
_register("m7_sgd_regression", Variant("regression", "sgd"))
_register("m9_boosted_trees", Variant("regression", "gbt"))
_register("m12_ridge_classifier", Variant("classification", "ridge"))
# all folds together, as runs fit them
_register("m8_kernel_huber", Variant("regression", "kernel_huber"))
_register("m13_kernel_svc", Variant("classification", "kernel_svc"))
_register("m14_perceptron", Variant("classification", "mlp"))
# all folds together: gradients of the Newton fits, or what is left of the first held-out loss
_register("m7_averaged_descent", Variant("regression", "descent"), 0.999)
_register("m8_kernel_svr", Variant("regression", "svr"), 1e-5)
_register("m9_tanh_network", Variant("regression", "network"), 0.999)
_register("m9_tanh_network_seven", Variant("regression", "network", True), 0.1)
_register("m10_logistic", Variant("classification", "logistic"), 1e-8)
_register("m11_sgd_classifier", Variant("classification", "sgd"), 1e-8)
_register("m11_averaged_descent", Variant("classification", "descent"), 0.999)
_register("m13_support_vectors", Variant("classification", "svc"), 1e-4)
_register("m14_tanh_network", Variant("classification", "network"), 0.999)
_register("m14_tanh_network_seven", Variant("classification", "network", True), 0.1)
_register("m15_four_classes", Variant("classification", "multi", True), 1e-8)


# Four classes of the log-linear formula against the measured ones: every number that SQL can give.
VIEWS["four"] = """
SELECT fold, CASE WHEN pf > 300 THEN 3 WHEN pf > 200 THEN 2 WHEN pf > 100 THEN 1 ELSE 0 END AS y,
  CASE WHEN h > 300 THEN 3 WHEN h > 200 THEN 2 WHEN h > 100 THEN 1 ELSE 0 END AS h
FROM (SELECT fold, pf, imputed AS h FROM scored)"""
VIEWS["of_class"] = """
SELECT fold, class, sum(CASE WHEN y = class THEN 1 ELSE 0 END) AS support, sum(CASE WHEN h = class THEN 1 ELSE 0 END) AS found,
  sum(CASE WHEN y = class AND h = class THEN 1 ELSE 0 END) AS hits, avg(CASE WHEN y = h THEN 1e0 ELSE 0e0 END) AS accuracy
FROM four, (VALUES (0), (1), (2), (3)) c(class) GROUP BY fold, class"""


def _four(t):
    return _scored(t).select("fold", O.pf_class4("pf").alias("y"), O.pf_class4("imputed").alias("h"))


@query("m15_confusion", "SELECT fold, y AS label, h AS predicted, count(*) AS n FROM four GROUP BY fold, y, h")
def _(t):
    return X.confusion_table(_four(t), ["fold"], "y", "h")


@query(
    "m15_class_metrics",
    """SELECT fold, class, CAST(support AS BIGINT) AS support, hits / nullif(found, 0) AS precision, hits / nullif(support, 0) AS recall,
      2 * hits / nullif(support + found, 0) AS f1, accuracy FROM of_class WHERE support + found > 0""",
    "precision recall f1 accuracy",
)
def _(t):
    return X.class_metrics(_four(t), ["fold"], "y", "h")


def _fitted_sql(view: str) -> str:
    return f"""SELECT {_KEYS}, b_0 + b_Spo2 * Spo2 + b_Fio2 * Fio2 + b_Peep * Peep AS predicted
FROM clean3 JOIN {view} ON held_out = -1"""


@query("m17_final_fit", _fitted_sql("whole_fit"), "predicted")
def _(t):
    model = R.fit_final(t.samples, _ID, Variant("regression", "linear"))
    return L.apply_model(model, _clean(t).select(*_ID, *C.FEATURES_3)).select(*_ID, "predicted")


VIEWS["ridge7_facts"] = "SELECT count(*) AS n, avg(Pao2) AS mean, stddev_pop(Pao2) AS spread FROM clean7"


@query("m17_final_fit_seven", "SELECT n, mean, true AS keeps_mean, true AS better FROM ridge7_facts", "mean")
def _(t):
    # ridge on centred columns predicts the mean on average, and narrower than the labels
    model = R.fit_final(t.samples, _ID, Variant("regression", "ridge", seven_features=True))
    scored = L.apply_model(model, _clean(t, seven_features=True).select(*_ID, *C.FEATURES_7, "Pao2"))
    return scored.agg(
        F.count("predicted").alias("n"),
        F.avg("Pao2").alias("mean"),
        (F.abs(F.avg("predicted") - F.avg("Pao2")) < 1e-6).alias("keeps_mean"),
        (X.rmse(F.col("Pao2"), F.col("predicted")) < 0.5 * F.stddev_pop("Pao2")).alias("better"),
    )


_GRID_ROWS = " UNION ALL ".join(
    f"SELECT {seven} AS features, {str(low).lower()} AS filtered, count(*) AS n FROM clean{seven}" + (" WHERE Spo2 < 97" if low else "")
    for seven in (3, 7) for low in (False, True)
)
_GRID_MODELS = ", ".join(f"('{task}', '{model}')" for task, models in P.MODELS.items() for model in models)


@query(
    "m18_variant_grid",
    f"""SELECT task, model, features, filtered, n, 10 AS folds, true AS all_scored, true AS finite,
      CASE WHEN task = 'regression' THEN 2 WHEN model = 'multi' THEN 2 ELSE 11 END AS metrics
    FROM (VALUES {_GRID_MODELS}) m(task, model), ({_GRID_ROWS}) g""",
)
def _(t):
    """All models, both tasks, both feature sets, with and without the filter: 44 variants from one table."""
    table = P.prediction_table(t.samples, _ID, P.all_variants())
    rows = table.groupBy(*P.VARIANT).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fold").cast("int").alias("folds"), (F.count("predicted") == F.count(F.lit(1))).alias("all_scored")
    )
    metrics = P.table_metrics(table).groupBy(*P.VARIANT).agg(
        F.countDistinct("metric").cast("int").alias("metrics"), F.max(F.isnan(F.coalesce("value", F.lit(0.0)))).alias("odd")
    )
    return rows.join(metrics, P.VARIANT).select(*P.VARIANT, "n", "folds", "all_scored", (~F.col("odd")).alias("finite"), "metrics")


_CURVES = [Variant("classification", m, True, low) for m in ("logistic", "network", "svc") for low in (False, True)]


@query(
    "m21_fitted_pr_curves",
    """SELECT model, filtered, count(*) AS n, sum(CASE WHEN Pao2 / Fio2 <= 150 THEN 0 ELSE 1 END) AS positives, 1e0 AS least_recall_at_end, true AS starts, true AS above_share
    FROM (VALUES ('logistic'), ('network'), ('svc')) m(model), (VALUES (true), (false)) f(filtered), clean7
    WHERE NOT filtered OR Spo2 < 97 GROUP BY model, filtered""",
    "least_recall_at_end",
)
def _(t):
    """Precision-recall curves of three fitted models on two subsets, all read from one prediction table."""
    table = P.prediction_table(t.samples, _ID, _CURVES)
    curves = written(P.table_pr_curves(table))
    ends = curves.groupBy("model", "filtered").agg(
        F.max("recall").alias("least_recall_at_end"),
        F.bool_or(F.expr("threshold IS NULL AND precision = 1 AND recall = 0")).alias("starts"),
        F.min(F.when(F.col("recall") > 0, F.col("precision"))).alias("lowest"),
    )
    rows = table.groupBy("model", "filtered").agg(F.count("score").alias("n"), F.sum("label").cast("long").alias("positives"))
    return rows.join(ends, ["model", "filtered"]).select(
        "model", "filtered", "n", "positives", "least_recall_at_end", "starts",
        (F.col("lowest") >= F.col("positives") / F.col("n") * 0.9).alias("above_share"),
    )


@query(
    "m21_fitted_agreement",
    """SELECT model, filtered, count(*) AS n, true AS centred, true AS ordered
    FROM (VALUES ('linear'), ('network')) m(model), (VALUES (true), (false)) f(filtered), clean7
    WHERE (NOT filtered OR Spo2 < 97) AND Pao2 / Fio2 <= 400 GROUP BY model, filtered""",
)
def _(t):
    """Agreement of measured P/F ratios with those of fitted models (all P/F ratios up to 400)."""
    variants = [Variant("regression", m, True, low) for m in ("linear", "network") for low in (False, True)]
    table = P.table_agreement(P.prediction_table(t.samples, _ID, variants), ["linear", "network"])
    return table.select(
        "model", "filtered", "n", (F.abs("mean_diff") < F.col("sd_diff")).alias("centred"),
        ((F.col("lower") < F.col("mean_diff")) & (F.col("mean_diff") < F.col("upper"))).alias("ordered"),
    )


@query(
    "m20_batch_scoring",
    f"""SELECT {_KEYS}, Spo2, Fio2, Peep,
      round_even((b_0 + b_Spo2 * Spo2 + b_Fio2 * Fio2 + b_Peep * Peep) * 100, 0) / 100 AS predicted
    FROM clean3 JOIN filtered_fit ON held_out = -1""",
    "Spo2 Fio2 Peep predicted",
)
def _(t):
    root = scratch_folder(t.spark)
    variant = Variant("regression", "linear", filter_spo2=True)
    R.fit_final(t.samples, _ID, variant, root)
    return R.score(_clean(t).select(*_ID, *C.FEATURES_3), root, variant)


def _facts(scored):
    """Of predictions of a saved model and of the model before it was saved, on the same rows."""
    return scored.agg(
        F.count("predicted").alias("n"),
        (F.max(F.abs(F.col("score") - F.col("before"))) < 1e-12).alias("same_scores"),
        F.min((F.col("predicted") == (F.col("score") > 0.5).cast("double"))).alias("same_classes"),
    )


def _saved(t, model: str):
    root = scratch_folder(t.spark)
    variant = Variant("classification", model, seven_features=True)
    fitted = R.fit_final(t.samples, _ID, variant, root)
    rows = L.apply_model(fitted, _clean(t, seven_features=True).select(*_ID, *C.FEATURES_7)).withColumnRenamed("score", "before")
    return R.score(rows.drop("predicted"), root, variant)


@query("s6_saved_classifier", "SELECT count(*) AS n, true AS same_scores, true AS same_classes FROM clean7")
def _(t):
    return _facts(_saved(t, "logistic"))


@query("s6_saved_network", "SELECT count(*) AS n, true AS same_scores, true AS same_classes FROM clean7")
def _(t):
    return _facts(_saved(t, "network"))


@query("s7_scalers_round_trip", f"SELECT {_KEYS}, (Spo2 - m1) / s1 AS z_0, (Fio2 - m2) / s2 AS z_1, (Peep - m3) / s3 AS z_2, Pao2 AS back FROM clean3, (SELECT avg(Spo2) AS m1, stddev_pop(Spo2) AS s1, avg(Fio2) AS m2, stddev_pop(Fio2) AS s2, avg(Peep) AS m3, stddev_pop(Peep) AS s3 FROM clean3)", "z_0 z_1 z_2 back")
def _(t):
    """Scalers are saved inside the model: its first stage, loaded again, scales raw features; label moments scale there and back."""
    root = scratch_folder(t.spark)
    variant = Variant("regression", "network")
    R.fit_final(t.samples, _ID, variant, root)
    rows = _clean(t)
    m, _ = D.fold_moments(rows.withColumn("fold", F.lit(0)), ["Pao2"])
    scaled = load_model(root, variant).stages[0].transform(rows.select(*_ID, *C.FEATURES_3, "Pao2"))
    back = D.zscore_exprs(m, ["Pao2"])["Pao2"] * m.spread("Pao2") + m.center("Pao2")
    return scaled.select(*_ID, F.col("__z_0").alias("z_0"), F.col("__z_1").alias("z_1"), F.col("__z_2").alias("z_2"), back.alias("back"))
