"""Hand-made cases for the temporal operators."""

import pytest
from pyspark.sql import functions as F

from bedside.functions.temporal import age_years, gap_minutes, within_first
from bedside.operators.episodes import first_episode, sessionize, vent_episodes
from bedside.operators.events import categorize, flag_events, swap_if, union_distinct
from bedside.operators.infusions import charted_infusions, mark_infusions, ordered_infusions
from bedside.operators.intervals import events_in_interval, flag_in_intervals, merge_intervals
from bedside.operators.nearest import argmin_rows, index_samples, nearest_match
from bedside.plans import codes
from helpers import at, rows

SETTING = "icustay_id long, charttime timestamp_ntz, MechVent int, OxygenTherapy int, Extubated int"
VENT, OXYGEN, EXTUBATED, NOTHING = (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)


def settings(spark, *events, stay=1):
    return spark.createDataFrame([(stay, t, *kind) for t, kind in events], SETTING)


def spans(df):
    return [(r[0], r[1]) for r in rows(df, "starttime", "endtime")]


@pytest.fixture(params=[None, 1], ids=["plain", "sliced"])
def hot_rows(request):
    return request.param


def test_gap_of_eight_hours_is_no_break(spark, hot_rows):
    df = settings(spark, (at(hours=0), VENT), (at(hours=8), VENT), (at(hours=16, seconds=1), VENT), (at(hours=17), VENT))
    assert spans(vent_episodes(df, hot_rows=hot_rows)) == [
        (at(hours=0), at(hours=8)), (at(hours=16, seconds=1), at(hours=17)),
    ]


def test_ventilation_after_extubation_is_new(spark, hot_rows):
    df = settings(spark, (at(hours=0), VENT), (at(hours=1), EXTUBATED), (at(hours=2), VENT), (at(hours=3), VENT))
    assert spans(vent_episodes(df, hot_rows=hot_rows)) == [
        (at(hours=0), at(hours=1)), (at(hours=2), at(hours=3)),
    ]


def test_late_extubation_belongs_to_the_episode(spark, hot_rows):
    df = settings(spark, (at(hours=0), VENT), (at(hours=60), EXTUBATED))
    assert spans(vent_episodes(df, hot_rows=hot_rows)) == [(at(hours=0), at(hours=60))]


def test_oxygen_opens_the_next_episode(spark, hot_rows):
    df = settings(
        spark, (at(hours=0), VENT), (at(hours=1), VENT), (at(hours=2), OXYGEN), (at(hours=3), VENT), (at(hours=4), VENT)
    )
    assert spans(vent_episodes(df, hot_rows=hot_rows)) == [
        (at(hours=0), at(hours=1)), (at(hours=3), at(hours=4)),
    ]


def test_single_instant_and_idle_rows_make_no_episode(spark, hot_rows):
    df = settings(spark, (at(hours=0), VENT), (at(hours=20), NOTHING), (at(hours=21), NOTHING))
    assert rows(vent_episodes(df, hot_rows=hot_rows)) == []


def test_numbers_are_sequential_and_null_stays_are_kept(spark, hot_rows):
    a = settings(spark, *[(at(hours=h), VENT) for h in (0, 1, 20, 21, 40, 41)])
    b = settings(spark, (at(hours=0), VENT), (at(hours=1), VENT), stay=None)
    episodes = vent_episodes(a.union(b), hot_rows=hot_rows)
    assert rows(episodes, "icustay_id", "ventnum", "duration_hours") == [
        (1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (None, 1, 1.0),
    ]
    assert rows(first_episode(episodes), "icustay_id", "ventnum") == [(1, 1)]


def test_rows_of_one_instant_share_the_session(spark, hot_rows):
    df = spark.createDataFrame(
        [(1, at(hours=0), 1), (1, at(hours=9), 2), (1, at(hours=9), 3), (1, at(hours=10), 4)],
        "k long, ts timestamp_ntz, id int",
    )
    out = sessionize(df, ["k"], "ts", "8 hours", ties=["id"], hot_rows=hot_rows)
    assert rows(out, "id", "session") == [(1, 0), (2, 1), (3, 1), (4, 1)]


def test_flags_and_set_union(spark):
    df = spark.createDataFrame([(1, at(), "a"), (1, at(), "b"), (2, at(), "c")], "k long, t timestamp_ntz, v string")
    flags = flag_events(df, ["k", "t"], {"a": F.col("v") == "a", "b": F.col("v") == "b"})
    assert rows(flags, "k", "a", "b") == [(1, 1, 1), (2, 0, 0)]
    assert union_distinct(flags, flags).count() == 2


INTERVAL = "k long, starttime timestamp_ntz, endtime timestamp_ntz"


def intervals(spark, *pairs, k=1):
    return spark.createDataFrame([(k, at(hours=s), at(hours=e)) for s, e in pairs], INTERVAL)


def hours(df):
    return [((s - at()).total_seconds() / 3600, (e - at()).total_seconds() / 3600) for s, e in spans(df)]


def test_touching_intervals_merge(spark, hot_rows):
    assert hours(merge_intervals(intervals(spark, (1, 3), (3, 5), (6, 7)), ["k"], hot_rows=hot_rows)) == [(1, 5), (6, 7)]


def test_malformed_interval_counts_by_its_bounds(spark, hot_rows):
    df = intervals(spark, (10, 5), (1, 3), (20, 30))
    assert hours(merge_intervals(df, ["k"], hot_rows=hot_rows)) == [(1, 3), (10, 30), (20, 30)]


def test_interval_with_one_bound_opens_or_closes(spark, hot_rows):
    df = spark.createDataFrame(
        [(1, at(hours=5), None), (1, at(hours=10), at(hours=12)), (1, None, at(hours=7)), (1, None, None), (None, at(), at(hours=1))], INTERVAL
    )
    assert hours(merge_intervals(df, ["k"], hot_rows=hot_rows)) == [(5, 7), (10, 12)]
    assert hours(merge_intervals(df.where("starttime IS NOT NULL"), ["k"], hot_rows=hot_rows)) == [(5, 12), (10, 12)]


def test_group_of_ties_keeps_all(spark):
    df = spark.createDataFrame([(1, 0, i) for i in range(50)] + [(2, 3, 0), (2, None, 1), (None, 0, 2)], "k int, v int, i int")
    assert argmin_rows(df, ["k"], ["v"]).count() == 51


def test_event_at_both_bounds_of_the_first_day(spark):
    long = spark.createDataFrame([(1, at(), at(days=3))], INTERVAL)
    short = spark.createDataFrame([(2, at(), at(hours=5))], INTERVAL)
    open_end = spark.createDataFrame([(3, at(), None)], INTERVAL)
    events = spark.createDataFrame(
        [(k, at(hours=h, seconds=s)) for k in (1, 2, 3) for h in (0, 5, 24) for s in (0, 1)], "k long, ts timestamp_ntz"
    )
    hits = events_in_interval(events, long.union(short).union(open_end), ["k"], "ts", cap="1 day")
    assert rows(hits, "k", "ts") == [
        (1, at()), (1, at(seconds=1)), (1, at(hours=5)), (1, at(hours=5, seconds=1)), (1, at(hours=24)),
        (2, at()), (2, at(seconds=1)), (2, at(hours=5)),
    ]
    check = open_end.select(within_first(F.col("starttime"), "starttime", "endtime").alias("x"))
    assert check.first()["x"] is None


def test_flag_forms(spark):
    events = spark.createDataFrame([(1, at(hours=2)), (1, at(hours=9)), (2, at(hours=2))], "k long, ts timestamp_ntz")
    iv = intervals(spark, (1, 3), (2, 4))
    assert rows(flag_in_intervals(events, iv, ["k"], "ts"), "ts", "inside") == [
        (at(hours=2), 1), (at(hours=2), 1), (at(hours=9), 0), (at(hours=9), 0),
    ]
    whole = flag_in_intervals(events, iv, ["k"], "ts", how="left", collapse=True)
    assert rows(whole, "k", "ts", "inside") == [(1, at(hours=2), 1), (1, at(hours=9), 0), (2, at(hours=2), 0)]
    assert flag_in_intervals(events, iv, ["k"], "ts", collapse=True).count() == 2


def test_whole_minutes(spark):
    df = spark.createDataFrame(
        [(at(), at(seconds=59)), (at(), at(minutes=30, seconds=59)), (at(days=2), at(hours=1))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r[0] for r in df.select(gap_minutes("a", "b")).collect()] == [0, 30, 2820]
    assert df.select(age_years(F.lit("2024-01-01").cast("date"), F.lit("1950-07-02").cast("date"))).first()[0] == 74.0


def matched(spark, left, right, hot_rows=None, **options):
    a = spark.createDataFrame([(1, t, i) for i, t in enumerate(left)], "k long, lts timestamp_ntz, l int")
    b = spark.createDataFrame([(1, t, i) for i, t in enumerate(right)], "k long, rts timestamp_ntz, r int")
    return rows(nearest_match(a, b, ["k"], "lts", "rts", hot_rows=hot_rows, **options), "l", "r", "min_time_diff")


def test_equal_distance_before_and_after_stays(spark, hot_rows):
    assert matched(spark, [at(minutes=60)], [at(minutes=50), at(minutes=70), at(minutes=80)], hot_rows) == [(0, 0, 10), (0, 1, 10)]


def test_first_of_tied_left_rows(spark):
    left, right = [at(minutes=100), at(minutes=10)], [at(minutes=15), at(minutes=105)]
    assert matched(spark, left, right) == [(0, 1, 5), (1, 0, 5)]
    assert matched(spark, left, right, first_only=True) == [(1, 0, 5)]


def test_limit_applies_to_the_winner(spark):
    assert matched(spark, [at()], [at(minutes=30, seconds=59)], max_gap=30) == [(0, 0, 30)]
    assert matched(spark, [at()], [at(minutes=31)], max_gap=30) == []


CHART = "subject_id long, icustay_id long, itemid int, charttime timestamp_ntz, value string, valueuom string"
LAB = "subject_id long, itemid int, charttime timestamp_ntz, value string, valueuom string"
EPISODE = "icustay_id long, ventnum long, starttime timestamp_ntz, endtime timestamp_ntz, duration_hours double"


def test_a_pick_without_value_has_no_second_choice(spark):
    chart = spark.createDataFrame(
        [(1, 10, 646, at(hours=1), None, "%"), (1, 10, 646, at(hours=5), "95", "%"), (2, 20, 646, at(hours=1), "96", "%")], CHART
    )
    labs = spark.createDataFrame(
        [(1, 490, at(hours=1, minutes=5), "80", ""), (1, 490, at(hours=5, minutes=5), "81", ""), (2, 490, at(hours=1), "90", "")], LAB
    )
    episodes = spark.createDataFrame([(k, 1, at(), at(hours=10), 10.0) for k in (10, 20)], EPISODE)
    assert rows(index_samples(chart, labs, episodes), "icustay_id", "value", "pao2_value", "min_time_diff") == [(20, "96", "90", 0)]


def test_argmin_keeps_ties_and_ignores_nulls(spark):
    df = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 1, 3), (1, None, 4), (None, 0, 5)], "k long, v int, id int")
    assert rows(argmin_rows(df, ["k"], ["v"]), "id") == [(2,), (3,)]


RATE = "icustay_id long, itemid int, charttime timestamp_ntz, vaso_stopped int, vaso_null int, vaso_rate double"


def test_start_and_stop_flags(spark, hot_rows):
    seq = [(0, None), (0, 0.0), (0, 0.0), (0, 2.0), (0, None), (1, 3.0), (0, 3.0), (0, 0.0), (0, None), (0, 4.0)]
    df = spark.createDataFrame(
        [(1, 30047, at(hours=i), s, int(r is not None), r) for i, (s, r) in enumerate(seq)], RATE
    )
    marked = mark_infusions(df, hot_rows).orderBy("charttime").collect()
    assert [r["vaso_start"] for r in marked] == [None, None, 0, 1, None, None, 1, None, 0, 1]
    assert [r["vaso_first"] for r in marked] == [None, None, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r["vaso_stop"] for r in marked] == [None, None, 0, None, None, 1, None, 2, None, 3]


INPUT = "icustay_id long, charttime timestamp_ntz, itemid int, stopped string, rate double, amount double"


def test_charted_infusions(spark, hot_rows):
    df = spark.createDataFrame(
        [
            (1, at(hours=0), 30047, None, 1.0, None), (1, at(hours=1), 30047, None, None, None),
            (1, at(hours=2), 30047, "D/C'd", 1.0, None), (1, at(hours=3), 30047, None, 2.0, None),
            (1, at(hours=4), 30047, None, 2.0, None),
            (2, at(hours=0), 42273, None, None, 5.0), (2, at(hours=3), 42273, None, None, 0.0),
            (None, at(hours=0), 30047, None, 1.0, None), (None, at(hours=1), 30047, None, 1.0, None),
        ],
        INPUT,
    )
    out = charted_infusions(df, codes.SWAPPED_RATE_AMOUNT, codes.STOP_WORDS, hot_rows=hot_rows)
    assert rows(out, "icustay_id", "starttime", "endtime") == [
        (1, at(hours=0), at(hours=2)), (1, at(hours=3), at(hours=4)), (2, at(hours=0), at(hours=3)),
    ]


def test_orders_without_status_do_not_count(spark):
    df = spark.createDataFrame(
        [(1, 7, at(), at(hours=1), "Done"), (1, 7, at(hours=2), at(hours=3), "Done"), (1, 8, at(), at(hours=1), None),
         (1, 9, at(), at(hours=1), "Rewritten")],
        "icustay_id long, linkorderid long, starttime timestamp_ntz, endtime timestamp_ntz, statusdescription string",
    )
    assert rows(ordered_infusions(df)) == [(1, 7, at(), at(hours=3))]


def test_swap_and_labels(spark):
    df = spark.createDataFrame([(42273, 1.0, 2.0), (1, 1.0, 2.0)], "itemid int, rate double, amount double")
    swapped = swap_if(df, F.col("itemid") == 42273, "rate", "amount")
    assert rows(swapped, "itemid", "rate", "amount") == [(1, 1.0, 2.0), (42273, 2.0, 1.0)]
    assert rows(categorize(df, "itemid", {"a": [1]}), "itemid", "category") == [(1, "a"), (42273, None)]
