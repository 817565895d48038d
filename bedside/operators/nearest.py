"""Nearest-in-time matching that keeps ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.temporal import MICROS_PER_MINUTE, gap_minutes
from .events import filter_by_category
from .intervals import events_in_interval
from ..sources.lineage import cut
from .running import choose_slices, highest_up_to, lowest_from, running, written_once


def argmin_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], in_place: bool = False) -> DataFrame:
    """All rows that attain the smallest ``order`` tuple of their group; NULL keys or values never do.

    The minimum is taken before the exchange and joined back by keys and values. A group with most of the rows, even
    one whose rows all tie, is one row on the one side of that join, so AQE can split the other.
    ``in_place`` takes the minimum in a window instead, for groups of bounded size whose rows lie together already.
    """
    usable = df
    for name in [*by, *order]:
        usable = usable.where(F.col(name).isNotNull())
    if in_place:
        tagged = usable.withColumns({"__own": F.struct(*order), "__least": F.min(F.struct(*order)).over(Window.partitionBy(*by))})
        return tagged.where(F.col("__own") == F.col("__least")).select(*df.columns)
    least = usable.groupBy(*by).agg(F.min(F.struct(*order)).alias("__least"))
    least = least.select(*by, *[F.col("__least")[o].alias(o) for o in order])
    return usable.join(least, [*by, *order], "left_semi").select(*df.columns)


def nearest_match(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    *,
    max_gap: int | None = None,
    first_only: bool = False,
    hot_rows: int | None = None,
    name: str = "min_time_diff",
) -> DataFrame:
    """Pairs of left and right rows of one group whose distance in whole minutes is the group's smallest.

    All tied pairs stay; ``first_only`` keeps those of the earliest left time. ``max_gap`` is applied
    to the winners, so a group whose best pair is too far apart has no result.

    The pairs of a group are never formed. The smallest distance of a left row is to the right row
    just before or just after it, which running results give; only the winning left rows are then
    joined to the right rows of the one or two minutes at that distance.
    """
    by = list(by)
    ends = dict(right.dtypes)[right_ts]
    for key in [*by, left_ts]:
        left = left.where(F.col(key).isNotNull())
    for key in [*by, right_ts]:
        right = right.where(F.col(key).isNotNull())

    points = written_once(
        left.select(*by, F.col(left_ts).alias("at"), F.lit(1).alias("is_left"), F.lit(0).alias("is_right"))
        .union(right.select(*by, F.col(right_ts), F.lit(0), F.lit(1)))
        .groupBy(*by, "at")
        .agg(F.max("is_left").alias("is_left"), F.max("is_right").alias("is_right")),
        hot_rows,
    )
    right_at = F.when(F.col("is_right") == 1, F.col("at")).cast(ends)
    near = running(
        points,
        by,
        "at",
        {"earlier": highest_up_to(right_at), "later": lowest_from(right_at)},
        slices=choose_slices(points, by, "at", hot_rows),
    )
    gaps = near.where(F.col("is_left") == 1).select(
        *by, "at", F.least(gap_minutes("at", "earlier"), gap_minutes("at", "later")).alias(name)
    )
    best = argmin_rows(gaps, by, [name, "at"] if first_only else [name])
    if max_gap is not None:
        best = best.where(F.col(name) <= max_gap)

    # A distance of m minutes means between m and m + 1 minutes, before or after.
    minute = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / F.lit(MICROS_PER_MINUTE))
    reach = F.col(name)
    wanted = best.withColumn(
        "__minute",
        F.explode(
            F.array_distinct(
                F.array(minute - reach - 1, minute - reach, minute + reach, minute + reach + 1)
            )
        ),
    )
    right_minute = F.floor(
        F.unix_micros(F.col(right_ts).cast("timestamp")) / F.lit(MICROS_PER_MINUTE)
    )
    found = (
        right.withColumn("__minute", right_minute)
        .join(wanted, [*by, "__minute"])
        .where(gap_minutes("at", right_ts) == F.col(name))
    )
    right_columns = [c for c in right.columns if c not in by]
    pairs = found.select(*by, F.col("at").alias(left_ts), *right_columns, name)
    return left.join(pairs, [*by, left_ts]).select(*left.columns, *right_columns, name)


def index_samples(
    chart: DataFrame,
    labs: DataFrame,
    episodes: DataFrame,
    *,
    cap: str = "1 day",
    max_gap: int = 30,
    hot_rows: int | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Per stay the earliest measurement that is closest to a lab, both in the first part of the episode.

    Labs carry no stay, so they are matched on the patient: a lab counts for every stay whose window
    contains it. The pick comes before the check of value and distance; a stay whose pick fails has
    no sample. ``in_place`` is for tables stored by stay and patient: the measurements and labs are not moved,
    only what lies in the episodes' first part is.
    """
    slicing = {"slice_seconds": None} if in_place else {}
    windows = episodes.select("icustay_id", "starttime", "endtime", "duration_hours", "ventnum")
    # Both sides are small parts of the base tables and are read several times below.
    measured = cut(events_in_interval(
        chart.select("subject_id", "icustay_id", "itemid", "value", "valueuom", "charttime"),
        windows,
        ["icustay_id"],
        "charttime",
        cap=cap,
        **slicing,
    ))
    stays = measured.select("subject_id", "icustay_id", "starttime", "endtime").distinct()
    lab_rows = cut(events_in_interval(
        labs.select(
            "subject_id",
            F.col("charttime").alias("labtime"),
            F.col("itemid").alias("pao2_id"),
            F.col("value").alias("pao2_value"),
            F.col("valueuom").alias("pao2_valueuom"),
        ),
        stays,
        ["subject_id"],
        "labtime",
        cap=cap,
        **slicing,
    ).drop("starttime", "endtime"))
    picked = nearest_match(
        measured,
        lab_rows,
        ["subject_id", "icustay_id"],
        "charttime",
        "labtime",
        max_gap=max_gap,
        first_only=True,
        hot_rows=hot_rows,
    )
    return picked.where(F.col("value").isNotNull())


def nearest_covariates(
    events: DataFrame,
    index: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    pick: str,
    *,
    first_only: bool,
    keep: Column | Mapping[str, Column],
    default: Column | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Per group and category the rows closest to the index time, within the index row's interval.

    ``events`` has ``category`` and ``charttime``; ``index`` one row per key with ``pick``,
    ``starttime`` and ``endtime``. ``first_only`` resolves ties by the earliest time. ``keep`` is
    applied to what was picked: one condition, or one per category with ``default`` for the others.
    ``in_place`` leaves events where they lie, for groups of bounded size that are stored by ``on``.
    """
    slicing = {"slice_seconds": None} if in_place else {}
    around = events_in_interval(events, index.distinct(), on, "charttime", **slicing)
    gaps = around.withColumn("min_time_diff", gap_minutes("charttime", pick))
    order = ["min_time_diff", "charttime"] if first_only else ["min_time_diff"]
    best = argmin_rows(gaps, [*by, "category"], order, in_place)
    if isinstance(keep, Mapping):
        kept = filter_by_category(best, "category", keep, default)
    else:
        kept = best.where(keep)
    return kept.distinct()
