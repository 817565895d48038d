"""Filter interaction audit: what each filter removes in every order, from counts of the documents' failure masks.

Four filters look at one text, the fifth at all: a copy of an earlier text fails. A counting Bloom filter over
hashes of the texts finds the rows that cannot have a copy. It is kept sparse, one row per counter that is not zero:
partial aggregates are the sketches of the tasks, their sum merges them, and its width follows the number of rows.
Only texts all of whose counters have reached two are shuffled, grouped as whole texts, for their least id.
The flags then join into one mask per document; masks are counted, and counts are all the orders need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.lineage import written

FILTERS = "ABCDE"
_BITS = 15  # a bitmap of Spark's bitmap functions has 2^15 bits
_COUNTERS = ["c1", "c2"]  # the counters that a text raises


def with_failures(rows: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with the words of ``text`` as ``_words``, and the filters that look at one text only, by letter."""
    # a blank at the start or the end leaves an empty word there, and nowhere else
    rows = rows.withColumn("_words", F.split(text, r"[\x20\x09-\x0D]+"))
    words, body = F.col("_words"), F.col(text)
    first, last = F.element_at("_words", 1) == "", F.element_at("_words", -1) == ""
    one = F.size(words) == 1
    n = F.size(words).cast("long") - first.cast("long") - (last & ~one).cast("long")
    distinct = F.size(F.array_distinct(words)).cast("long") - (first | last).cast("long")
    size, capitals = F.length(body).cast("long"), F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long")
    fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * size, "D": body.rlike(r"[#$%&*|]")}
    return rows, fails


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _hashes(width: int) -> list[Column]:
    """A hash to tell texts of one id apart, and the numbers of a text's counters."""
    counters = [F.shiftrightunsigned(F.xxhash64("body", F.lit(k)), 64 - width).alias(c) for k, c in enumerate(_COUNTERS, 1)]
    return [F.xxhash64("body").alias("same"), *counters]


def repeated_counters(rows: DataFrame) -> DataFrame:
    """Bitmaps (bucket, bits) of the counters that were raised twice or more; a row may raise one counter twice."""
    raised = rows.select(F.explode(F.array(*_COUNTERS)).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    often = raised.where("n >= 2")
    return often.groupBy(F.shiftright("counter", _BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("counter").bitwiseAND((1 << _BITS) - 1)).alias("bits")
    )


def with_possible(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``rows`` and whether all of their counters stand at two or more; if not, no other row has their text."""
    possible = F.lit(True)
    for c in _COUNTERS:
        own = F.broadcast(bitmaps.select(F.col("bucket").alias(f"at_{c}"), F.col("bits").alias(f"bits_{c}")))
        rows = rows.join(own, F.shiftright(c, _BITS) == F.col(f"at_{c}"), "left")
        byte = f"CAST(conv(hex(substring(bits_{c}, CAST(({c} & {(1 << _BITS) - 1}) >> 3 AS INT) + 1, 1)), 16, 10) AS INT)"
        possible &= F.expr(f"bits_{c} IS NOT NULL AND getbit({byte}, CAST({c} & 7 AS INT)) = 1")
    return rows.withColumn("possible", possible).drop(*[x + c for x in ("at_", "bits_") for c in _COUNTERS])


def failure_masks(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "lang", most_counters: int = 1 << 30
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``part``, ``mask`` with bit 0 for filter A to bit 4 for E.

    A row fails E if its text is also that of a smaller id; null texts are empty, and all empty texts are equal.
    Rows that repeat the least id of their text pass, and so do rows without an id.

    The filter has 16 to 32 counters a row, at least 32,768 and at most ``most_counters``: the bitmap that is broadcast
    has an eighth of that in bytes (128 MB). Beyond, fewer texts are cleared and more are compared; the result is the same.
    """
    width = min(max(_BITS, (16 * docs.count()).bit_length()), most_counters.bit_length() - 1)
    source = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body")
    )
    split, own = with_failures(source, "body")
    mask = sum((F.when(fails, _bit(k)).otherwise(0) for k, fails in own.items()), F.lit(0))
    flags = written(split.select("id", "part", mask.alias("mask"), *_hashes(width)))
    bitmaps = written(repeated_counters(flags))
    texts = with_possible(source.where("id IS NOT NULL").select("id", "body", *_hashes(width)), bitmaps)
    # The whole text is the key; copies of a task meet before the exchange.
    least = texts.where("possible").groupBy("body").agg(F.min("id").alias("id"))
    keys = ["id", "same", *_COUNTERS]
    first = least.select("id", *_hashes(width), F.lit(True).alias("is_first"))
    flags = with_possible(flags, bitmaps).withColumn("possible", F.col("possible") & F.col("id").isNotNull())
    compared = flags.where("possible").join(first, keys, "left")
    repeats = compared.select("id", "part", F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + _bit("E")).alias("mask"))
    return flags.where("NOT possible").select("id", "part", "mask").unionByName(repeats)


def mask_counts(masks: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good`` (quality 1) and ``toxic`` (1); of several labels of an id the larger counts."""
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max((F.col(quality) == 1).cast("long")).alias("good"), F.max((F.col(toxic) == 1).cast("long")).alias("toxic")
    )
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def filter_orders(counts: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the filter finds and removes there.

    A step depends only on its filter and on the set of filters before it, so each mask adds to 80 sums a part;
    these are then put into the 600 places of all orders.
    """
    spark = counts.sparkSession
    steps = [(k, before) for k in range(5) for before in range(32) if not before >> k & 1]
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("before")) for k, b in steps]))
    at = counts.select("*", step.alias("at")).select("*", "at.k", "at.before")
    own, removed = "mask & (1 << k) <> 0", "mask & (1 << k) <> 0 AND mask & before = 0"

    def total(value: str, where: str) -> Column:
        return F.sum(F.expr(f"CASE WHEN {where} THEN {value} ELSE 0 END"))

    sums = at.groupBy("part", "k", "before").agg(
        total("n", "mask & ((1 << k) | before) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", f"{own} AND mask & before <> 0").alias("redundant"),
        total("n", "mask = 1 << k").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    places = [
        ("".join(FILTERS[k] for k in order), n + 1, order[n], sum(1 << k for k in order[:n]))
        for order in permutations(range(5))
        for n in range(5)
    ]
    placed = sums.join(spark.createDataFrame(places, "filter_order string, step int, k int, before int"), ["k", "before"])
    return placed.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "k")).alias("shapley"),  # 120 rows each
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "lang", **options) -> DataFrame:
    """``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost``, ``shapley``: 600 rows for each value of ``part`` (null and empty: empty string).

    Every row of ``docs`` counts, repeated rows and rows without an id too (these have no labels and pass E).
    Labels of unknown ids are ignored. No documents give no rows. Other columns are not read.
    """
    masks = failure_masks(docs, text=text, doc_id=doc_id, part=part, **options)
    return filter_orders(mask_counts(masks, labels, doc_id=doc_id))
