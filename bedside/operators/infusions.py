"""From charted infusion rates and orders to infusion intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.temporal import hours_between
from .events import swap_if, union_distinct
from .intervals import merge_with_plan, span_by
from ..sources.lineage import cut
from .running import choose_slices, fill, is_last, position, previous, running, total, written_once

_BY = ["icustay_id", "itemid"]


def charted_rates(
    df: DataFrame, swapped: Iterable[int] = (), stop_words: Iterable[str] = ()
) -> DataFrame:
    """One row per (stay, item, time): highest rate and amount, and whether the drug was stopped.

    ``swapped`` lists items that carry their rate in the amount column.
    """
    fixed = swap_if(
        df.select(*_BY, "charttime", "stopped", "rate", "amount"),
        F.col("itemid").isin(list(swapped)),
        "rate",
        "amount",
    )
    return fixed.groupBy(*_BY, "charttime").agg(
        F.max(F.when(F.col("stopped").isin(list(stop_words)), 1).otherwise(0)).alias("vaso_stopped"),
        F.max(F.when(F.col("rate").isNotNull(), 1).otherwise(0)).alias("vaso_null"),
        F.max("rate").alias("vaso_rate"),
        F.max("amount").alias("vaso_amount"),
    )


def mark_infusions(rates: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Add the start flag, the running infusion number and the stop marker to charted rates.

    ``vaso_rate`` is carried forward over NULLs. Since a row with a rate is its own fill, the rate
    carried by the row before and the last rate charted earlier are one value, so a single pass over
    the timeline gives everything the start rule compares.
    """
    rate, rest = F.col("vaso_rate"), ["vaso_stopped", "vaso_rate", "vaso_null"]
    rows = written_once(rates.select(*_BY, "charttime", *rest), hot_rows)
    slices = choose_slices(rows, _BY, "charttime", hot_rows)
    seen = running(
        rows,
        _BY,
        "charttime",
        {
            "vaso_prevrate_ifnull": fill(rate),
            "rate_before": previous(rate, where=rate.isNotNull()),
            "stopped_before": previous(F.col("vaso_stopped")),
            "is_final": is_last(),
        },
        slices=slices,
        ties=rest,
    )
    carried, before = F.col("vaso_prevrate_ifnull"), F.col("rate_before")
    start = (
        F.when((rate > 0) & before.isNull(), 1)  # first time the drug runs
        .when((rate == 0) & (before == 0), 0)  # a string of zeros starts nothing
        .when((carried == 0) & (before == 0), 0)  # nor do NULLs after a zero
        .when(before == 0, 1)  # running again after a zero
        .when(F.col("stopped_before") == 1, 1)  # running again after a disconnect
    )
    started = seen.select(
        *_BY, "charttime", *rest, "vaso_prevrate_ifnull", "is_final", start.alias("vaso_start")
    )
    numbered = running(
        started,
        _BY,
        "charttime",
        {"vaso_first": total(F.col("vaso_start"))},
        slices=slices,
        ties=[*rest, "vaso_prevrate_ifnull", "is_final", "vaso_start"],
    )
    ends = (F.col("vaso_stopped") == 1) | F.coalesce(rate == 0, F.lit(False)) | F.col("is_final")
    return numbered.withColumn("vaso_stop", F.when(ends, F.col("vaso_first")))


def charted_infusions(
    df: DataFrame,
    swapped: Iterable[int] = (),
    stop_words: Iterable[str] = (),
    *,
    hot_rows: int | None = None,
) -> DataFrame:
    """Infusions per (stay, item): from the first charted rate to the first stop marker of the same number."""
    # a stay is a timeline of its own, so rows without one can go before the windows
    known = df.where(F.col("icustay_id").isNotNull())
    marked = mark_infusions(charted_rates(known, swapped, stop_words), hot_rows)
    at_stop = F.when(F.col("vaso_first") == F.col("vaso_stop"), F.col("charttime"))
    return (
        marked.where(F.col("vaso_first") != 0)
        .groupBy(*_BY, "vaso_first")
        .agg(
            F.min(F.when(F.col("vaso_rate").isNotNull(), F.col("charttime"))).alias("starttime"),
            F.min(at_stop).alias("endtime"),
            F.min("charttime").alias("__first"),
            F.max("vaso_rate").alias("__peak"),
        )
        .where((F.col("__first") != F.col("endtime")) & (F.col("__peak") > 0))
        .select(*_BY, "starttime", "endtime")
    )


def ordered_infusions(df: DataFrame, void_status: str = "Rewritten") -> DataFrame:
    """Span of each linked order; void orders and orders without a status do not count."""
    valid = df.where(F.col("statusdescription") != void_status)
    return span_by(
        valid.select("icustay_id", "linkorderid", "starttime", "endtime"),
        ["icustay_id", "linkorderid"],
    )


def _merged_and_numbered(intervals: DataFrame, hot_rows: int | None) -> DataFrame:
    merged, split = merge_with_plan(intervals, ["icustay_id"], hot_rows=hot_rows)
    slices = None
    if split:
        merged = cut(merged)
        slices = choose_slices(merged, ["icustay_id"], "starttime", hot_rows)
    ranked = running(
        merged, ["icustay_id"], "starttime", {"vasonum": position()}, slices=slices, ties=["endtime"]
    )
    return ranked.select(
        "icustay_id",
        F.col("vasonum").cast("long").alias("vasonum"),
        "starttime",
        "endtime",
        hours_between("starttime", "endtime").alias("duration_hours"),
    )


def vasopressor_durations(
    charted: DataFrame, ordered: DataFrame, *, hot_rows: int | None = None
) -> DataFrame:
    """Merged infusion intervals of both source systems.

    Each system is merged and numbered by itself, so a stay found in both has each number twice.
    """
    return union_distinct(
        _merged_and_numbered(charted, hot_rows), _merged_and_numbered(ordered, hot_rows)
    )
