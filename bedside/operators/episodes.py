"""From flagged instants to numbered episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temporal import hours_between, interval
from ..sources.lineage import cut
from .running import choose_slices, position, previous, running, total, written_once


def sessionize(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    gap: str,
    break_when: Column | None = None,
    *,
    ties: Sequence[str] = (),
    name: str = "session",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add a session number; a session starts after a pause longer than ``gap`` or where ``break_when`` holds."""
    slices = choose_slices(df, by, ts, hot_rows)
    seen = running(df, by, ts, {"__previous": previous(F.col(ts))}, slices=slices, ties=ties)
    starts = F.col(ts) - F.col("__previous") > interval(gap)
    if break_when is not None:
        starts = break_when | F.coalesce(starts, F.lit(False))
    marked = seen.withColumn("__starts", F.when(starts, 1).otherwise(0)).drop("__previous")
    numbered = running(marked, by, ts, {name: total(F.col("__starts"))}, slices=slices, ties=ties)
    return numbered.drop("__starts")


def number_episodes(
    settings: DataFrame,
    by: str = "icustay_id",
    ts: str = "charttime",
    *,
    vent: str = "MechVent",
    oxygen: str = "OxygenTherapy",
    extubated: str = "Extubated",
    gap: str = "8 hours",
    hot_rows: int | None = None,
) -> DataFrame:
    """Running episode number per settings row; NULL for rows that are neither ventilation nor extubation.

    A row opens an episode if the ventilation or extubation row before it was an extubation, if
    oxygen is given without ventilation, or if the last ventilation is longer ago than ``gap``.
    Rows of one instant share the number.
    """
    return _number_episodes(settings, by, ts, vent, oxygen, extubated, gap, hot_rows)[0]


def _number_episodes(
    settings: DataFrame,
    by: str,
    ts: str,
    vent: str,
    oxygen: str,
    extubated: str,
    gap: str,
    hot_rows: int | None,
) -> tuple[DataFrame, bool]:
    columns = [by, ts, vent, oxygen, extubated]
    relevant = (F.col(vent) == 1) | (F.col(extubated) == 1)
    ties = [vent, oxygen, extubated]
    # Grouping and set union stand behind this table: written once for the count and the windows.
    rows = written_once(settings.select(*columns), hot_rows)
    slices = choose_slices(rows, [by], ts, hot_rows)
    seen = running(
        rows,
        [by],
        ts,
        {
            "last_vent": previous(F.col(ts), where=F.col(vent) == 1),
            "last_extubated": previous(F.col(extubated), where=relevant),
        },
        slices=slices,
        ties=ties,
    )
    opens = (
        F.when(relevant & (F.col("last_extubated") == 1), 1)
        .when((F.col(vent) == 0) & (F.col(oxygen) == 1), 1)
        .when((F.col(vent) == 1) & (F.col(ts) - F.col("last_vent") > interval(gap)), 1)
        .otherwise(0)
    )
    marked = seen.select(*columns, opens.alias("newvent"))
    # Oxygen-only rows count towards the number, so they may only be set aside after the sum.
    counted = running(
        marked, [by], ts, {"ventnum": total(F.col("newvent"))}, slices=slices, ties=[*ties, "newvent"]
    )
    return counted.withColumn("ventnum", F.when(relevant, F.col("ventnum"))), slices is not None


def vent_episodes(
    settings: DataFrame,
    by: str = "icustay_id",
    ts: str = "charttime",
    *,
    vent: str = "MechVent",
    oxygen: str = "OxygenTherapy",
    extubated: str = "Extubated",
    gap: str = "8 hours",
    hot_rows: int | None = None,
) -> DataFrame:
    """Episodes with at least one ventilation row and more than one instant, numbered per entity."""
    numbered, split = _number_episodes(
        settings, by, ts, vent, oxygen, extubated, gap, hot_rows
    )
    spans = (
        numbered.where(F.col("ventnum").isNotNull())
        .groupBy(by, "ventnum")
        .agg(
            F.min(ts).alias("starttime"),
            F.max(ts).alias("endtime"),
            F.max(vent).alias("__vented"),
        )
        .where((F.col("starttime") != F.col("endtime")) & (F.col("__vented") == 1))
        .select(by, "starttime", "endtime")
    )
    # Episodes of one entity do not overlap, so their start orders them like the running number.
    if split:
        spans = cut(spans)
    ranked = running(
        spans,
        [by],
        "starttime",
        {"ventnum": position()},
        # No more episodes than rows: what fitted into one task still does.
        slices=choose_slices(spans, [by], "starttime", hot_rows) if split else None,
        ties=["endtime"],
    )
    return ranked.select(
        by,
        F.col("ventnum").cast("long").alias("ventnum"),
        "starttime",
        "endtime",
        hours_between("starttime", "endtime").alias("duration_hours"),
    )


def first_episode(episodes: DataFrame, by: str = "icustay_id", number: str = "ventnum") -> DataFrame:
    return episodes.where((F.col(number) == 1) & F.col(by).isNotNull())
