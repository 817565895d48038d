"""Time arithmetic as column expressions (the session time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000
DAYS_PER_YEAR = 365.242


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval(text: str) -> Column:
    """``interval('8 hours')`` as a literal."""
    return F.expr(f"INTERVAL {text}")


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def gap_minutes(a: Column | str, b: Column | str) -> Column:
    """Distance in whole minutes; a started minute does not count (59 s is 0)."""
    return F.floor(F.abs(micros_between(a, b)) / F.lit(MICROS_PER_MINUTE)).cast("long")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def age_years(at: Column | str, born: Column | str) -> Column:
    days = F.datediff(_col(at).cast("date"), _col(born).cast("date"))
    return F.round(days / F.lit(DAYS_PER_YEAR), 0).cast("double")


def capped_end(start: Column | str, end: Column | str, cap: str | None) -> Column:
    """End of an interval cut to ``cap`` after its start. A NULL end stays NULL (``least`` would skip it)."""
    start, end = _col(start), _col(end)
    if cap is None:
        return end
    return F.when(end.isNotNull(), F.least(end, start + interval(cap)))


def within_first(ts: Column | str, start: Column | str, end: Column | str, cap: str | None = "1 day") -> Column:
    """True inside ``[start, min(end, start + cap)]``, both bounds included."""
    return _col(ts).between(_col(start), capped_end(start, end, cap))


def time_slice(ts: Column | str, seconds: int = 86_400) -> Column:
    """Number of the ``seconds``-wide slice a timestamp or date falls in; grows with the timestamp."""
    ts = _col(ts)
    whole = F.unix_date(ts.cast("date")).cast("long") * 86_400
    if seconds % 86_400:
        whole = whole + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor(whole / F.lit(seconds)).cast("long")
