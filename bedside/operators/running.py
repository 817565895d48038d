"""Ordered per-entity window results that do not depend on how large an entity is.

``Window.partitionBy(entity)`` sends every row of an entity to one task. That is the cheapest plan
(one exchange, shared by all windows of an operator) as long as entities are of ordinary size, and
it stops the job once one entity owns a large part of the table. So the row counts are looked at
first (``choose_slices``: a count per entity, combined before the shuffle). If any entity exceeds the
limit, timelines are cut into slices just fine enough that no (entity, slice) exceeds it, the window
runs per (entity, slice), and each slice receives what the earlier (or later) slices of its entity
contribute:

    rows --exchange(entity, slice)--> local window ------------------------+--> combine
                                        `- last row of each slice          |
                                             --window(entity, by slice)----+

Only one row per slice takes part in the second window, so its size depends on the covered time
span and not on the number of rows. All results here are prefix results (last value, sum, max,
min), so they can be combined that way without loss: both plans give the same rows. Only entities above the limit
are cut as long as they are few enough to be named (``NAMED_GROUPS``): the others keep the plain window's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.temporal import time_slice
from ..sources.lineage import cut

# More rows of one entity than this are not left to one task.
HOT_ROWS = 5_000_000

# As ``hot_rows``: groups are known to be of bounded size, so nothing is counted and timelines stay whole.
UNBOUNDED = float("inf")

# Slice widths to choose from, coarsest first: a day, an hour, a minute, a second.
SLICE_SECONDS = (86_400, 3_600, 60, 1)

# So many groups above the limit are told apart from the others; with more of them, every timeline is cut.
NAMED_GROUPS = 100

_KEY = "__slice"
_START = Window.unboundedPreceding


@dataclass(frozen=True)
class Windows:
    """``rows``: ordered with tie-breakers. ``peers``: ordered by the sort column alone. ``back``: the
    same from the other end (a frame that ends at UNBOUNDED FOLLOWING is recomputed for every row,
    one that starts at UNBOUNDED PRECEDING is not). ``all``: unordered."""

    rows: WindowSpec
    peers: WindowSpec
    back: WindowSpec
    all: WindowSpec


@dataclass(frozen=True)
class State:
    local: Callable[[Windows], Column]  # value inside the slice
    summary: Callable[[Windows], Column]  # the slice as a whole, read off its last row
    carry: Callable[[Column, Windows], Column]  # over the slices of one entity
    combine: Callable[[Column, Column], Column]
    alone: Callable[[Column], Column] = lambda own: own  # the local value when nothing was cut


@dataclass(frozen=True)
class Slices:
    """``number`` of a row's slice, for the rows ``where`` the group is cut at all."""

    number: Column
    where: Column


def _unbox(own: Column) -> Column:
    return own["v"]


def _both(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def previous(value: Column, where: Column | None = None, inclusive: bool = False) -> State:
    """Value of the closest earlier row that satisfies ``where``; ``inclusive`` lets the row itself count."""
    boxed = F.struct(value.alias("v"))  # boxed so that a NULL value still counts as a row
    if where is not None:
        boxed = F.when(where, boxed)
    last = 0 if inclusive else -1
    return State(
        local=lambda w: F.last(boxed, ignorenulls=True).over(w.rows.rowsBetween(_START, last)),
        summary=lambda w: F.last(boxed, ignorenulls=True).over(w.rows.rowsBetween(_START, 0)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(w.rows.rowsBetween(_START, -1)),
        combine=lambda own, before: F.coalesce(own, before)["v"],
        alone=_unbox,
    )


def fill(value: Column) -> State:
    """Forward fill: the value itself, or else the last one that was not NULL."""
    return previous(value, where=value.isNotNull(), inclusive=True)


def total(value: Column) -> State:
    """Running sum; rows with the same sort value are peers and share it. NULL before the first value."""
    return State(
        local=lambda w: F.sum(value).over(w.peers),
        summary=lambda w: F.sum(value).over(w.all),
        carry=lambda s, w: F.sum(s).over(w.rows.rowsBetween(_START, -1)),
        combine=_both,
    )


def group_total(value: Column) -> State:
    """Sum over the whole group."""
    return State(
        local=lambda w: F.sum(value).over(w.all),
        summary=lambda w: F.sum(value).over(w.all),
        carry=lambda s, w: F.sum(s).over(w.all),
        combine=lambda own, everything: everything,
    )


def position() -> State:
    """1-based row number."""
    one = F.lit(1)
    return State(
        local=lambda w: F.sum(one).over(w.rows.rowsBetween(_START, 0)),
        summary=lambda w: F.sum(one).over(w.rows.rowsBetween(_START, 0)),
        carry=lambda s, w: F.sum(s).over(w.rows.rowsBetween(_START, -1)),
        combine=_both,
    )


def highest_before(value: Column) -> State:
    """Maximum over the strictly earlier rows."""
    return State(
        local=lambda w: F.max(value).over(w.rows.rowsBetween(_START, -1)),
        summary=lambda w: F.max(value).over(w.all),
        carry=lambda s, w: F.max(s).over(w.rows.rowsBetween(_START, -1)),
        combine=lambda own, before: F.greatest(own, before),
    )


def highest_up_to(value: Column) -> State:
    """Maximum over the earlier rows, the row itself and its peers."""
    return State(
        local=lambda w: F.max(value).over(w.peers),
        summary=lambda w: F.max(value).over(w.all),
        carry=lambda s, w: F.max(s).over(w.rows.rowsBetween(_START, -1)),
        combine=lambda own, before: F.greatest(own, before),
    )


def lowest_from(value: Column) -> State:
    """Minimum over the row itself, its peers and the later rows."""
    return State(
        local=lambda w: F.min(value).over(w.back),
        summary=lambda w: F.min(value).over(w.all),
        carry=lambda s, w: F.min(s).over(w.back.rowsBetween(_START, -1)),
        combine=lambda own, after: F.least(own, after),
    )


def following(value: Column) -> State:
    """Value of the next row."""
    boxed = F.struct(value.alias("v"))
    return State(
        local=lambda w: F.lead(boxed).over(w.rows),
        summary=lambda w: F.first(boxed).over(w.rows.rowsBetween(_START, 0)),
        carry=lambda s, w: F.lead(s).over(w.rows),
        combine=lambda own, after: F.coalesce(own, after)["v"],
        alone=_unbox,
    )


def is_last() -> State:
    """True for the last row of the entity."""
    one = F.lit(1)
    return State(
        local=lambda w: F.lead(one).over(w.rows),
        summary=lambda w: F.max(one).over(w.all),
        carry=lambda s, w: F.lead(s).over(w.rows),
        combine=lambda own, after: own.isNull() & after.isNull(),
        alone=lambda own: own.isNull(),
    )


def written_once(df: DataFrame, hot_rows: float | None) -> DataFrame:
    """``df`` for ``choose_slices`` and the windows after it: cut, as both read it, unless nothing is counted."""
    return df if hot_rows == UNBOUNDED else cut(df)


def choose_slices(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    hot_rows: float | None = None,
    candidates: Iterable[Column] | None = None,
) -> Slices | None:
    """How to number the slices of a timeline, or None if every group fits into one task.

    ``candidates`` are slice numbers from coarse to fine, each growing with ``order``; by default
    ``order`` is a timestamp. The coarsest one under which no (group, slice) has more than
    ``hot_rows`` rows is taken. Only counts are computed; their maximum reaches the driver, and hashes of up to
    ``NAMED_GROUPS`` groups that do not fit. A group that shares such a hash is cut too, which changes no result.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if limit == UNBOUNDED:
        return None

    groups = F.xxhash64(F.lit(0), *by)
    large = df.groupBy(*by).count().where(F.col("count") > limit).select(groups.alias("__group"))
    named = [row[0] for row in large.limit(NAMED_GROUPS + 1).collect()]
    if not named:
        return None
    where = groups.isin(sorted(set(named))) if len(named) <= NAMED_GROUPS else F.lit(True)
    rows = df.where(where)

    def largest(*keys: Column | str) -> int:
        return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0

    if candidates is None:
        candidates = [time_slice(order, seconds) for seconds in SLICE_SECONDS]
    slices = None
    for slices in candidates:
        if largest(*by, slices.alias("__n")) <= limit:
            break
    return None if slices is None else Slices(slices, where)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    states: Mapping[str, State],
    *,
    slices: Slices | Column | None,
    ties: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add one column per entry of ``states``, computed along ``order`` inside each ``by`` group.

    ``slices`` comes from ``choose_slices``; a column cuts all groups, None selects the plain window. ``ties`` makes row-based
    results reproducible among equal ``order`` values. NULL group keys form one group, as in any
    window.
    """

    def ordered(name: str, down: bool) -> Column:
        return F.col(name).desc_nulls_first() if down else F.col(name).asc_nulls_last()

    def windows(keys: Sequence[str], along: str, *ties: str) -> Windows:
        part = Window.partitionBy(*[F.col(k) for k in keys])
        return Windows(
            rows=part.orderBy(*[ordered(c, descending) for c in (along, *ties)]),
            peers=part.orderBy(ordered(along, descending)),
            back=part.orderBy(ordered(along, not descending)),
            all=part,
        )

    if slices is None:
        w = windows(by, order, *ties)
        return df.withColumns({name: s.alone(s.local(w)) for name, s in states.items()})

    # Both branches read the input, so it is written once.
    if isinstance(slices, Column):
        slices = Slices(slices, F.lit(True))
    keyed = cut(df).withColumns({_KEY: F.struct(*by, F.when(slices.where, slices.number).alias("n")), "__cut": slices.where})
    w = windows([_KEY], order, *ties)
    local = keyed.withColumns({name: s.local(w) for name, s in states.items()})

    last_rows = (
        keyed.where("__cut")
        .withColumns(
            {f"__s_{name}": s.summary(w) for name, s in states.items()}
            | {"__end": F.lead(F.lit(1)).over(w.rows).isNull()}
        )
        .where("__end")
        .select(_KEY, *[f"__s_{name}" for name in states])
    )
    across = windows([f"{_KEY}.{b}" for b in by], f"{_KEY}.n")
    carried = last_rows.select(
        F.col(_KEY).alias("__carry_key"),
        *[s.carry(F.col(f"__s_{name}"), across).alias(f"__c_{name}") for name, s in states.items()],
    )
    joined = local.join(carried, F.col(_KEY) == F.col("__carry_key"), "left")

    def whole(name: str, s: State) -> Column:
        own = F.col(name)
        return F.when(F.col("__cut"), s.combine(own, F.col(f"__c_{name}"))).otherwise(s.alone(own)).alias(name)

    return joined.select(*df.columns, *[whole(name, s) for name, s in states.items()])
