"""Line dedup by site-relative frequency: lines that too large a share of a host's pages contain are boilerplate.

Only expressions: lines are counted per host once a page, divided by the host's pages, and dropped from every page of
that host above the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.lineage import written

RATIO = 0.05
LEAST_PAGES = 5
#: Line hashes of all hosts together that may be broadcast (8 bytes each).
BROADCAST_LINES = 500_000


def line_key(line: Column) -> Column:
    """What makes two lines the same: the text without blanks at its ends."""
    return F.trim(line)


def boilerplate_lines(
    pages: DataFrame, *, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """(host, line_hash): lines on more than ``ratio`` of a host's pages and on at least ``least_pages`` of them.

    Every row is a page, a repeated row another one. A page counts a line once, however often it repeats it. Blank lines are never boilerplate; a null host is a host
    of its own; null texts count as pages without lines. Lines are counted by a 64-bit hash and summed before
    the shuffle, so a host or a line with most of the rows costs one row a task.
    """
    site = F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("n"))
    rows = pages.select(site.alias("site"), F.col(text).alias("body"))
    total = rows.groupBy("site").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("body", "\n"), line_key), lambda l: l != ""), lambda l: F.xxhash64(l)))
    counted = (
        rows.select("site", F.explode(keys).alias("line_hash"))
        .groupBy("site", "line_hash")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_pages)
    )
    return counted.join(total, "site").where(F.col("n") > ratio * F.col("pages")).select("site", "line_hash")


def drop_boilerplate(
    pages: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    dropped: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """``pages`` with their texts without boilerplate lines; the other lines keep their order, and texts without any stay as they are.

    Rows stay one to one, a null text stays null and a text of boilerplate only becomes empty. ``dropped`` names a column for the number of lines dropped,
    ``size`` one that is set to the text's new length in characters where lines were dropped.

    The lines to drop are one array per host: each is on more than ``ratio`` of its pages, so a host has at most
    (mean lines of a page / ratio) of them, whatever its size. The arrays are counted: up to ``BROADCAST_LINES`` hashes
    are broadcast and no text is moved; beyond that the join moves pages by host, and as the other side has one row
    a host, AQE can split a host with a large share of the pages.
    """
    columns = [c for c in pages.columns if c != dropped]
    lists = (
        boilerplate_lines(pages, text=text, host=host, ratio=ratio, least_pages=least_pages)
        .groupBy("site")
        .agg(F.collect_set("line_hash").alias("_drop"))
        .withColumnRenamed("site", "_site")
    )
    lists = written(lists)
    entries = lists.agg(F.sum(F.size("_drop"))).first()[0] or 0
    if entries <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    site = F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("n"))
    joined = pages.select(*columns, site.alias("_site")).join(lists, "_site", "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda l: ~F.array_contains("_drop", F.xxhash64(line_key(l))) | (line_key(l) == ""))
    marked = joined.withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
    changed = F.col("_kept").isNotNull() & (F.size("_kept") < F.size(lines))
    shorter = F.array_join("_kept", "\n")
    new = {text: shorter, size: F.length(shorter).cast(dict(pages.dtypes).get(size, "long"))}
    out = [F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns]
    if dropped:
        out.append(F.when(changed, F.size(lines) - F.size("_kept")).otherwise(0).cast("long").alias(dropped))
    return marked.select(*out)
