"""Joins of instants with intervals, and interval merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.temporal import capped_end, time_slice
from .running import choose_slices, highest_before, highest_up_to, lowest_from, running, written_once


def events_in_interval(
    events: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    ts: str,
    start: str = "starttime",
    end: str = "endtime",
    cap: str | None = None,
    *,
    slice_seconds: int | None = 86_400,
) -> DataFrame:
    """Inner join of events with the intervals of the same ``on`` keys that contain them, bounds included.

    ``cap`` cuts each interval to its first part. Intervals are repeated for the time slices they
    touch (two for a one-day cap) and the join is an equi-join on keys and slice, so a key with very
    many events is spread over its slices and no event meets an interval from another time. With
    ``slice_seconds=None`` the keys alone are joined: for keys with few intervals and events that lie
    by these keys already, which then stay where they are.
    """
    piece = "__slice"
    spread = intervals.withColumn("__until", capped_end(start, end, cap)).where(F.col(start) <= F.col("__until"))
    if slice_seconds is None:
        hits = events.join(spread, list(on))
    else:
        slices = F.sequence(time_slice(start, slice_seconds), time_slice("__until", slice_seconds))
        spread = spread.withColumn(piece, F.explode(slices))
        hits = events.withColumn(piece, time_slice(ts, slice_seconds)).join(spread, [*on, piece])
    kept = [c for c in intervals.columns if c not in on]
    return hits.where(F.col(ts).between(F.col(start), F.col("__until"))).select(*events.columns, *kept)


def flag_in_intervals(
    df: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    ts: str,
    start: str = "starttime",
    end: str = "endtime",
    *,
    how: str = "inner",
    name: str = "inside",
    collapse: bool = False,
) -> DataFrame:
    """Pair every row with every interval of its keys and flag (1/0) whether its time lies inside.

    The inner form loses rows whose keys have no interval. ``collapse`` gives one row per input row
    with the maximum flag instead, and finds it without forming the pairs: only rows that really lie
    inside an interval are joined.
    """
    if not collapse:
        inside = F.when(F.col(ts).between(F.col(start), F.col(end)), 1).otherwise(0)
        return df.join(intervals, list(on), how).withColumn(name, inside)
    instants = df.select(*on, ts).distinct()
    hit = (
        events_in_interval(instants, intervals.select(*on, start, end), on, ts, start, end)
        .select(*on, ts)
        .distinct()
        .withColumn(name, F.lit(1))
    )
    flagged = df.join(hit, [*on, ts], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    if how == "inner":
        flagged = flagged.join(intervals.select(*on).distinct(), list(on), "left_semi")
    return flagged.select(*df.columns, name)


def span_by(df: DataFrame, keys: Sequence[str], start: str = "starttime", end: str = "endtime") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def merge_intervals(
    df: DataFrame,
    by: Sequence[str],
    start: str = "starttime",
    end: str = "endtime",
    *,
    hot_rows: int | None = None,
) -> DataFrame:
    """Union of overlapping or touching closed intervals per ``by``.

    A start opens a merged interval if no interval that began strictly earlier reaches it; an end
    closes one if no interval that began by then reaches beyond it; each opening start takes the
    next closing end. A malformed interval (start after end) covers nothing, but its two bounds
    still count, which is what the pairwise formulation of this rule gives. The same holds for an interval
    with one NULL bound: the bound it has opens or closes, and it covers nothing. A NULL key belongs to no timeline.
    """
    return merge_with_plan(df, by, start, end, hot_rows=hot_rows)[0]


def merge_with_plan(
    df: DataFrame,
    by: Sequence[str],
    start: str = "starttime",
    end: str = "endtime",
    *,
    hot_rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """``merge_intervals`` plus whether timelines had to be split, for running steps that follow."""
    usable = df.where(_all_not_null(by))
    reach = F.when(F.col(start) <= F.col(end), F.col(end))
    none = F.lit(None).cast(dict(df.dtypes)[end])
    opening = F.struct(F.col(start).alias("at"), reach.alias("reach"), F.lit(1).alias("opens"), F.lit(0).alias("closes"))
    closing = F.struct(F.col(end).alias("at"), none.alias("reach"), F.lit(0).alias("opens"), F.lit(1).alias("closes"))
    # Both bounds of a row in one pass: what stands behind ``df`` is computed once, and rows stay where they are.
    bounds = written_once(
        usable.select(*by, F.inline(F.array(opening, closing)))
        .where(F.col("at").isNotNull())
        .groupBy(*by, "at")
        .agg(F.max("reach").alias("reach"), F.max("opens").alias("opens"), F.max("closes").alias("closes")),
        hot_rows,
    )
    slices = choose_slices(bounds, by, "at", hot_rows)
    covered = running(
        bounds,
        by,
        "at",
        {"before": highest_before(F.col("reach")), "so_far": highest_up_to(F.col("reach"))},
        slices=slices,
    )
    is_open = (F.col("opens") == 1) & ~F.coalesce(F.col("before") >= F.col("at"), F.lit(False))
    is_close = (F.col("closes") == 1) & ~F.coalesce(F.col("so_far") > F.col("at"), F.lit(False))
    edges = covered.select(*by, "at", is_open.alias("is_open"), is_close.alias("is_close")).where(
        "is_open or is_close"
    )
    closed = running(
        edges,
        by,
        "at",
        {"until": lowest_from(F.when(F.col("is_close"), F.col("at")))},
        slices=slices,
    )
    merged = closed.where(F.col("is_open") & F.col("until").isNotNull()).select(
        *by, F.col("at").alias(start), F.col("until").alias(end)
    )
    return merged, slices is not None


def _all_not_null(columns: Sequence[str]):
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition
