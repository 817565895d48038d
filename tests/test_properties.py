"""Operators against brute force on random data, in the plain and in the sliced plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bedside.functions.temporal import gap_minutes
from bedside.operators.evaluation import ranking_metrics, roc_curve
from bedside.operators.folds import assign_folds, exact_folds
from bedside.operators.intervals import events_in_interval, flag_in_intervals, merge_intervals
from bedside.operators.nearest import argmin_rows, nearest_match
from bedside.operators.running import (
    choose_slices, fill, following, highest_before, highest_up_to, is_last, lowest_from, position, previous,
    running, total,
)
from helpers import at, rows

SEEDS = [1, 2, 3]


def instants(rng, n, days=6, step=900):
    return [at(seconds=step * rng.randrange(days * 86400 // step)) for _ in range(n)]


@pytest.mark.parametrize("seed", SEEDS)
def test_merge_equals_pairwise_rule(spark, seed):
    rng = random.Random(seed)
    data = []
    for k in range(4):
        for start in instants(rng, 40):
            data.append((k, start, start + dt.timedelta(seconds=900 * rng.randint(-4, 30))))
    expected = set()
    for k in range(4):
        mine = [(s, e) for kk, s, e in data if kk == k]
        opens = {s for s, _ in mine if not any(a < s <= b for a, b in mine)}
        closes = {e for _, e in mine if not any(a <= e < b for a, b in mine)}
        for s in opens:
            later = [e for e in closes if e >= s]
            if later:
                expected.add((k, s, min(later)))
    df = spark.createDataFrame(data, "k int, starttime timestamp_ntz, endtime timestamp_ntz")
    for hot in (None, 5):
        merged = merge_intervals(df, ["k"], hot_rows=hot)
        assert {tuple(r) for r in merged.collect()} == expected
    # Proper intervals merge into disjoint ones, which merge into themselves.
    proper = merge_intervals(df.where("starttime <= endtime"), ["k"])
    assert rows(merge_intervals(proper, ["k"])) == rows(proper)


@pytest.mark.parametrize("seed", SEEDS)
def test_nearest_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    left = [(k, t + dt.timedelta(seconds=rng.randrange(900)), i) for k in range(3) for i, t in enumerate(instants(rng, 25))]
    right = [(k, t + dt.timedelta(seconds=rng.randrange(900)), i) for k in range(3) for i, t in enumerate(instants(rng, 25))]
    left += left[:2]
    expected = []
    for k in range(3):
        pairs = [
            (k, l, r, int(abs((a - b).total_seconds()) // 60)) for kk, a, l in left if kk == k for k2, b, r in right if k2 == k
        ]
        best = min(p[3] for p in pairs)
        expected += [p for p in pairs if p[3] == best]
    a = spark.createDataFrame(left, "k int, lts timestamp_ntz, l int")
    b = spark.createDataFrame(right, "k int, rts timestamp_ntz, r int")
    for hot in (None, 5):
        got = nearest_match(a, b, ["k"], "lts", "rts", hot_rows=hot)
        assert rows(got, "k", "l", "r", "min_time_diff") == sorted(expected, key=lambda r: tuple((False, str(v)) for v in r))


@pytest.mark.parametrize("seed", SEEDS)
def test_events_in_intervals_equal_nested_loop(spark, seed):
    rng = random.Random(seed)
    events = [(rng.randrange(3), t, i) for i, t in enumerate(instants(rng, 120))]
    spans = [(rng.randrange(3), s, s + dt.timedelta(hours=rng.randint(-2, 60)), i) for i, s in enumerate(instants(rng, 20))]
    ev = spark.createDataFrame(events, "k int, ts timestamp_ntz, e int")
    iv = spark.createDataFrame(spans, "k int, starttime timestamp_ntz, endtime timestamp_ntz, i int")
    for cap, limit in ((None, dt.timedelta(days=999)), ("1 day", dt.timedelta(days=1))):
        want = sorted((e, i) for k, t, e in events for k2, s, u, i in spans if k == k2 and s <= t <= min(u, s + limit))
        assert sorted((r["e"], r["i"]) for r in events_in_interval(ev, iv, ["k"], "ts", cap=cap).collect()) == want
    inside = {e for k, t, e in events for k2, s, u, _ in spans if k == k2 and s <= t <= u}
    flags = flag_in_intervals(ev, iv, ["k"], "ts", how="left", collapse=True)
    assert {r["e"] for r in flags.where("inside = 1").collect()} == inside and flags.count() == len(events)


@pytest.mark.parametrize("seed", SEEDS)
def test_sliced_plan_equals_plain_window(spark, seed):
    rng = random.Random(seed)
    data = [
        (rng.choice([1, 2, None]), t, i, rng.choice([None, 0, 1, 2, 3])) for i, t in enumerate(instants(rng, 150, step=7200))
    ]
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz, id int, v int")
    v = F.col("v")
    states = {
        "prev": previous(v), "prev_odd": previous(F.col("id"), where=v % 2 == 1), "filled": fill(v), "sum": total(v),
        "nth": position(), "before": highest_before(v), "upto": highest_up_to(v), "from": lowest_from(v),
        "next": following(v), "last": is_last(),
    }
    slices = choose_slices(df, ["k"], "ts", hot_rows=20)
    assert slices is not None and choose_slices(df, ["k"], "ts", hot_rows=1000) is None
    plain = running(df, ["k"], "ts", states, slices=None, ties=["id"])
    sliced = running(df, ["k"], "ts", states, slices=slices, ties=["id"])
    assert rows(plain, *sorted(plain.columns)) == rows(sliced, *sorted(plain.columns))


def test_argmin_equals_min_join_back(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randrange(5), rng.randrange(4), i) for i in range(100)], "k int, v int, id int")
    low = df.groupBy("k").agg(F.min("v").alias("v"))
    assert rows(argmin_rows(df, ["k"], ["v"]), "id") == rows(df.join(low, ["k", "v"]), "id")


def test_gap_is_the_sum_of_its_parts(spark):
    rng = random.Random(7)
    pairs = [(at(seconds=rng.randrange(10**6)), at(seconds=rng.randrange(10**6))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    want = []
    for a, b in pairs:
        d = abs(a - b)
        want.append(d.days * 1440 + d.seconds // 3600 * 60 + d.seconds % 3600 // 60)
    assert [r[0] for r in df.select(gap_minutes("a", "b")).collect()] == want


@pytest.mark.parametrize("seed", SEEDS)
def test_auc_is_a_pair_count_and_ignores_scale(spark, seed):
    rng = random.Random(seed)
    data = [("m", rng.randrange(20) / 20, int(rng.random() < 0.4)) for _ in range(120)]
    df = spark.createDataFrame(data, "m string, s double, y int")
    pos = [s for _, s, y in data if y]
    neg = [s for _, s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for hot in (None, 3):
        assert ranking_metrics(df, ["m"], "y", "s", hot_rows=hot).first()["roc_auc"] == pytest.approx(want)
    bent = df.withColumn("s", F.exp("s") * 3 - 7)
    assert ranking_metrics(bent, ["m"], "y", "s").first()["roc_auc"] == pytest.approx(want)
    curve = sorted((r["fpr"], r["tpr"]) for r in roc_curve(df, ["m"], "y", "s", hot_rows=3).collect())
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(curve, curve[1:]))
    assert area == pytest.approx(want)


def test_folds_partition_the_rows(spark):
    df = spark.range(1003)
    folds = assign_folds(df, ["id"], 10)
    assert folds.count() == 1003 and {r[0] for r in folds.select("fold").distinct().collect()} == set(range(10))
    assert rows(folds) == rows(assign_folds(df.repartition(7), ["id"], 10))
    sizes = [r["count"] for r in exact_folds(df, ["id"], 10).groupBy("fold").count().collect()]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1


def test_only_groups_above_the_limit_are_cut(spark, monkeypatch):
    """F16: one large group had every timeline cut as finely as its own."""
    t0 = dt.datetime(2024, 1, 1)
    data = [(k, t0 + dt.timedelta(hours=h), h) for k, n in ((None, 90), (1, 60), (2, 20), (3, 5)) for h in range(n)]
    df = spark.createDataFrame(data, "k long, ts timestamp_ntz, v long")
    states = {"nth": position(), "sum": total(F.col("v")), "before": previous(F.col("v")), "final": is_last()}
    plain = rows(running(df, ["k"], "ts", states, slices=None))
    slices = choose_slices(df, ["k"], "ts", hot_rows=24)
    cut_groups = {r[0] for r in df.where(slices.where).select("k").distinct().collect()}
    assert cut_groups == {None, 1}
    assert rows(running(df, ["k"], "ts", states, slices=slices)) == plain
    monkeypatch.setattr("bedside.operators.running.NAMED_GROUPS", 1)  # too many to be named: all are cut
    slices = choose_slices(df, ["k"], "ts", hot_rows=24)
    assert df.where(~slices.where).count() == 0
    assert rows(running(df, ["k"], "ts", states, slices=slices)) == plain
