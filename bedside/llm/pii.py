"""Personal data by expressions alone: regular expressions propose spans, checksums confirm, context words score.

Kinds, in the order of results: email, ip, card (Luhn), phone (``+`` and 9 to 15 digits), and two that build on
the method: iban (mod 97 = 1) and local_phone (a number without ``+`` that a nearby word speaks of). Every span has
a score: what the pattern says by itself, raised by context words within ``CONTEXT`` characters before it. The first
four kinds stay whatever the score; the others need ``LEAST_SCORE``.

The patterns are written so that the regular-expression engine neither recurses nor goes back over long runs:
repeated groups are possessive, and a match that starts with a run may only start at the run's beginning or
where the last match ended. Both leave the leftmost matches as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT = 40
LEAST_SCORE = 0.6


class Kind(NamedTuple):
    name: str
    needs: str  # a cheap pattern that every text with a match contains
    pattern: str
    words: str  # context words
    base: float
    always: bool


# The first four patterns follow the contract of the personal-data query.
KINDS = [
    Kind(
        "email", "@",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"mail|contact|write|kontakt|correo|courriel", 0.9, True,
    ),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\bip\b|address|host|server|adresse", 0.7, True),
    Kind("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++", r"card|visa|credit|karte|carte|tarjeta", 0.7, True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"call|phone|tel|fax|mobil|llam", 0.7, True),
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        r"iban|account|konto|compte|cuenta|bank", 0.6, False,
    ),
    Kind(
        "local_phone", r"[0-9]{3}",
        r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])",
        r"call|phone|tel|fax|mobil|llam", 0.3, False,
    ),
]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(places, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1 once its head is moved to the end and letters are numbers."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(
        F.filter(values, lambda v: v.isNotNull()),
        F.lit(0),
        lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97,
    )
    return rest == 1


def _valid(kind: str, s: Column) -> Column:
    digits = _digits(s)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(s, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & mod97(compact)
    if kind == "local_phone":
        return F.length(digits).between(9, 12)
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """Array of (start, end, match) of all matches, in code points, then of those that the checks confirm.

    The gaps between matches and the matches themselves add up to positions.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern)
    # a match at the very start leaves an empty first gap, so there is one gap more than matches
    pairs = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), matches.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        keep = F.when(_valid(kind.name, pair["value"]), F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        return F.struct(end.alias("at"), F.concat(state["found"], keep).alias("found"))

    found = F.aggregate(pairs, start, add, lambda state: state["found"])
    scored = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.when(
                F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))).rlike(f"(?i){kind.words}"),
                min(1.0, kind.base + 0.3),
            ).otherwise(kind.base).alias("score"),
        ),
    )
    if not kind.always:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(kind.needs), scored).otherwise(empty)


def find_personal_data(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with one column ``pii_<kind>`` per kind: an array of (start, end, value, score) by start.

    Positions are code points, ends exclusive. A null text counts as empty. Rows stay one to one; columns of
    these names are replaced. Only expressions: no Python runs on the executors.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c not in {f"pii_{k.name}" for k in KINDS}]
    return docs.select(*rest, *[_spans(body, k).alias(f"pii_{k.name}") for k in KINDS])


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans of the kinds, in their order and by start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")
