"""Streamed sessions against the batch operator, in and out of order, over several runs."""

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from bedside.operators.episodes import sessionize
from bedside.streaming import sessions as S

SCHEMA = "entity long, ts timestamp_ntz, note string"


def batch(df, gap="8 hours"):
    numbered = sessionize(df.where("entity IS NOT NULL AND ts IS NOT NULL"), ["entity"], "ts", gap, ties=["note"])
    return sorted(
        tuple(r)
        for r in numbered.groupBy("entity", "session")
        .agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"), F.count(F.lit(1)).alias("n"))
        .select("entity", "a", "b", "n").collect()
    )


def streamed(df):
    return sorted(tuple(r) for r in df.select("entity", "starttime", "endtime", "events").collect())


@pytest.fixture(scope="module")
def events(spark):
    data = [(e, at(hours=5 * k + (k * e) % 7 * (k % 4 == 0) * 3), f"n{k}") for e in range(6) for k in range(40)]
    # pauses of exactly the gap and a little more, equal times, rows without time or entity
    data += [(9, at(), "a"), (9, at(hours=8), "b"), (9, at(hours=16, seconds=1), "c"), (9, at(hours=16, seconds=1), "d"), (8, None, "x"), (None, at(hours=3), "y")]
    return spark.createDataFrame(data, SCHEMA)


def test_shuffled_arrivals_equal_the_batch(spark, events, tmp_path):
    source = str(tmp_path / "in")
    events.repartition(7, F.xxhash64("note", "entity")).write.parquet(source)
    got = S.sessions_of_folder(spark, source, SCHEMA, ["entity"], "ts", "8 hours", late="60 days", scratch=str(tmp_path), files_per_batch=2)
    assert streamed(got) == batch(events)


def test_sessions_close_as_the_watermark_passes_and_state_goes_on(spark, events, tmp_path):
    source, options = str(tmp_path / "in"), {"late": "1 hour", "target": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state")}
    early, late = events.where("ts < timestamp_ntz'2024-01-04 00:00:00' OR ts IS NULL"), events.where("ts >= timestamp_ntz'2024-01-04 00:00:00'")
    early.coalesce(1).write.parquet(source)
    assert S.run_sessions(spark, source, SCHEMA, ["entity"], "ts", "8 hours", **options) == 0
    first = streamed(S.read_sessions(spark, options["target"], ["entity"]))
    whole = batch(events)
    assert first and set(first) < set(whole)  # what was closed is final, sessions over the border are still open
    late.coalesce(1).write.mode("append").parquet(source)
    S.run_sessions(spark, source, SCHEMA, ["entity"], "ts", "8 hours", **options)
    # an event far behind the watermark is dropped and counted
    spark.createDataFrame([(0, at(hours=1), "late")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    dropped = S.run_sessions(spark, source, SCHEMA, ["entity"], "ts", "8 hours", **options)
    S.close_sessions(spark, source, SCHEMA, ["entity"], "ts", "8 hours", "1 hour")
    S.run_sessions(spark, source, SCHEMA, ["entity"], "ts", "8 hours", **options)
    assert dropped == 1 and streamed(S.read_sessions(spark, options["target"], ["entity"])) == whole


def test_no_events(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    got = S.sessions_of_folder(spark, source, SCHEMA, ["entity"], "ts", "8 hours", late="1 day", scratch=str(tmp_path))
    assert rows(got) == []
