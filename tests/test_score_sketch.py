"""Score sketches against exact ranking metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedside.operators import evaluation as X, score_sketch as S


def scores(seed, n=3000):
    rng = np.random.default_rng(seed)
    kind = seed % 4
    label = (rng.random(n) < (0.5, 0.02, 0.5, 0.98)[kind]).astype(float)
    score = rng.normal(label, 1.5, n) if kind != 2 else np.round(rng.normal(label, 1.0, n), 1) * 1e6
    return [(int(i % 3), float(y), float(s)) for i, (y, s) in enumerate(zip(label, score))]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bins", [8, 256])
def test_errors_stay_within_their_bounds(spark, seed, bins):
    df = spark.createDataFrame(scores(seed), "fold int, label double, score double")
    edges = S.score_edges(df, "score", bins)
    sketch = S.score_sketch(df, ["fold"], "label", "score", edges)
    assert len(edges) < bins and sketch.count() <= 3 * bins
    got = {r.fold: r for r in S.sketch_metrics(sketch, ["fold"]).collect()}
    for r in X.ranking_metrics(df, ["fold"], "label", "score").collect():
        own = got[r.fold]
        assert abs(own.roc_auc - r.roc_auc) <= own.roc_auc_error + 1e-12
        assert abs(own.average_precision - r.average_precision) <= own.average_precision_error + 1e-12
        if bins == 256 and seed == 0:
            assert own.roc_auc_error < 0.01


def test_sketches_of_parts_add_up_and_pool(spark):
    parts = [spark.createDataFrame(scores(0)[i::2], "fold int, label double, score double") for i in (0, 1)]
    whole = parts[0].unionByName(parts[1])
    edges = S.score_edges(parts[0], "score", 64)  # edges of an earlier run
    merged = S.merge_sketches([S.score_sketch(p, ["fold"], "label", "score", edges) for p in parts], ["fold"])
    want = S.score_sketch(whole, ["fold"], "label", "score", edges)
    assert sorted(map(tuple, merged.select("fold", "bin", "n1", "n0").collect())) == sorted(map(tuple, want.select("fold", "bin", "n1", "n0").collect()))
    pooled = S.sketch_metrics(S.merge_sketches([merged], []), []).first()
    exact = X.ranking_metrics(whole.withColumn("all", F.lit(1)), ["all"], "label", "score").first()
    assert abs(pooled.roc_auc - exact.roc_auc) <= pooled.roc_auc_error


def test_points_at_the_edges_are_on_the_exact_curve(spark):
    rows = [r[1:] for r in scores(3)]
    df = spark.createDataFrame(rows, "label double, score double")
    edges = S.score_edges(df, "score", 16)
    for r in S.sketch_curve(S.score_sketch(df, [], "label", "score", edges), [], edges).collect():
        above = [y for y, s in rows if s >= r.threshold]
        assert r.recall == pytest.approx(sum(above) / sum(y for y, _ in rows))
        assert r.precision == pytest.approx(sum(above) / len(above))
        assert r.fpr == pytest.approx((len(above) - sum(above)) / sum(1 - y for y, _ in rows))


def test_odd_inputs(spark):
    schema = "label double, score double"
    one = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (1.0, None), (0.0, float("nan"))], schema)
    got = S.sketch_metrics(S.score_sketch(one, [], "label", "score", S.score_edges(one, "score")), []).first()
    assert (got.positives, got.negatives, got.roc_auc, got.roc_auc_error) == (1, 1, 0.5, 0.5)
    alone = spark.createDataFrame([(1.0, 0.1), (1.0, 0.2)], schema)
    assert S.sketch_metrics(S.score_sketch(alone, [], "label", "score", [0.15]), []).first().roc_auc is None
    empty = one.where("false")
    assert S.score_edges(empty, "score") == [] and S.score_sketch(empty, [], "label", "score", []).count() == 0
