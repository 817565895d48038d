"""Sessions of a stream of events: Spark's session windows with a watermark, fed from a folder of files.

Open sessions are state, kept per entity by Spark in the checkpoint; a session leaves the state, and is written, when
the watermark has passed its end by the gap. A run takes what files there are and ends; the next one goes on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.temporal import interval


def sessions_of(events: DataFrame, by: Sequence[str], ts: str, gap: str, late: str) -> DataFrame:
    """``by``, ``starttime``, ``endtime``, ``events`` of the closed sessions of a streaming (or whole) table.

    A session ends before a pause longer than ``gap``. Events that come more than ``late`` after a newer one may be dropped,
    if their session is closed. Rows without a time are left out; an entity of nulls has sessions of its own.
    """
    # windows that touch are one session, so a pause of exactly the gap does not end it
    timed = events.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.session_window(ts, gap)
    return timed.groupBy(*by, window).agg(
        F.min(ts).alias("starttime"), F.max(ts).alias("endtime"), F.count(F.lit(1)).alias("events")
    ).select(*by, "starttime", "endtime", "events")


def run_sessions(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    by: Sequence[str],
    ts: str,
    gap: str,
    *,
    late: str,
    target: str,
    checkpoint: str,
    files_per_batch: int = 100,
) -> int:
    """Take the new Parquet files of ``source``, append the sessions they close to ``target``, and end; returns the rows dropped as too late (in its last 100 batches).

    ``checkpoint`` keeps what was read and the open sessions: files are taken once, also after a failure.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    closed = sessions_of(events, by, ts, gap, late)
    query = (
        closed.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def close_sessions(spark: SparkSession, source: str, schema: StructType | str, by: Sequence[str], ts: str, gap: str, late: str) -> None:
    """Add a file to ``source`` whose one row, without an entity, lies so late that the next run closes all sessions.

    For the end of a stream: events that come later still are too late.
    """
    events = spark.read.schema(schema).parquet(source)
    after = F.max(F.col(ts).cast("timestamp")) + interval(gap) + interval(gap) + interval(late) + interval("1 second")
    kinds = dict(events.dtypes)
    last = events.agg(after.cast(kinds[ts]).alias(ts))
    row = last.select(*[F.col(c) if c == ts else F.lit(None).cast(kinds[c]).alias(c) for c in events.columns])
    row.coalesce(1).write.mode("append").parquet(source)


def read_sessions(spark: SparkSession, target: str, by: Sequence[str]) -> DataFrame:
    """The sessions written so far, without those of no entity (among them the closing row's)."""
    known = F.lit(False)
    for c in by:
        known |= F.col(c).isNotNull()
    return spark.read.parquet(target).where(known)


def sessions_of_folder(
    spark: SparkSession, source: str, schema: StructType | str, by: Sequence[str], ts: str, gap: str, *, late: str, scratch: str, files_per_batch: int = 100
) -> DataFrame:
    """All sessions of a folder that gets no more files: a run, the closing row, and a run that closes what is open."""
    place = f"{scratch}/{uuid.uuid4()}"
    options = {"late": late, "target": f"{place}/sessions", "checkpoint": f"{place}/state", "files_per_batch": files_per_batch}
    run_sessions(spark, source, schema, by, ts, gap, **options)
    close_sessions(spark, source, schema, by, ts, gap, late)
    run_sessions(spark, source, schema, by, ts, gap, **options)
    return read_sessions(spark, options["target"], by)
