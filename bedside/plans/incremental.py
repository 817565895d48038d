"""Results per stay that are kept up to date: only buckets of stays with new rows are built again.

Base tables are stored in buckets by a hash of the stay, one folder a bucket, and so are the results. For every
result and bucket a record says from which files it was built. A refresh compares the record with the files that
are there, reads the buckets that differ, and replaces just their results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

_BUCKET = "__bucket"
Tables = dict[str, DataFrame]


class StayStore:
    """Base tables and results below ``root``, all by a hash of ``key``.

    ``buckets`` is fixed when the store is made: enough that a bucket is a small share of a refresh, few enough that its files
    are not tiny. Rows without a key are in one bucket.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, object], key: str = "icustay_id", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._schemas = dict(schemas)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a base table: one file in each bucket they belong to."""
        dealt = rows.select(*self._columns(name)).withColumn(_BUCKET, self._bucket())
        dealt.repartition(self.buckets, _BUCKET).sortWithinPartitions(_BUCKET, self.key).write.mode("append").partitionBy(_BUCKET).parquet(f"{self.root}/base/{name}")

    def _columns(self, name: str) -> list[str]:
        schema = self._schemas[name]
        return [f.name for f in schema] if not isinstance(schema, str) else [c.split()[0] for c in schema.split(",")]

    def _ddl(self, name: str) -> str:
        schema = self._schemas[name]
        text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        return f"{text}, {_BUCKET} int"

    def _path_exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def _base(self, name: str) -> DataFrame:
        path = f"{self.root}/base/{name}"
        if not self._path_exists(path):
            return self.spark.createDataFrame([], self._ddl(name))
        return self.spark.read.schema(self._ddl(name)).parquet(path)

    def base(self, name: str, only: Sequence[int] | None = None) -> DataFrame:
        """A base table, or some of its buckets: no other files are read."""
        table = self._base(name)
        return (table if only is None else table.where(F.col(_BUCKET).isin(list(only)))).drop(_BUCKET)

    def _stored(self, path: str) -> dict[int, set[str]]:
        """Files of each bucket of a result."""
        found: dict[int, set[str]] = {}
        if self._path_exists(path):
            for file in self.spark.read.schema(f"any int, {_BUCKET} int").parquet(path).inputFiles():
                if m := re.search(rf"{_BUCKET}=(\d+)", file):
                    found.setdefault(int(m[1]), set()).add(file)
        return found

    def _files(self, names: Sequence[str]) -> dict[int, str]:
        """Per bucket a hash of the names of its files."""
        found: dict[int, list[str]] = {}
        for name in names:
            for file in self._base(name).inputFiles():
                bucket = int(re.search(rf"{_BUCKET}=(\d+)", file)[1])
                found.setdefault(bucket, []).append(f"{name}/{file.rsplit('/', 1)[1]}")
        return {b: hashlib.sha256("\n".join(sorted(own)).encode()).hexdigest() for b, own in found.items()}

    def _record(self, result: str) -> dict[int, str]:
        """What each bucket of a result was last built from: one row a bucket and refresh, the newest counts."""
        path = f"{self.root}/built/{result}"
        if not self._path_exists(path):
            return {}
        rows = self.spark.read.parquet(path).groupBy("bucket").agg(F.max_by("files", "at").alias("files"))
        return {r["bucket"]: r["files"] for r in rows.collect()}

    def changed(self, result: str, names: Sequence[str]) -> list[int]:
        """Buckets whose files are not those the result was built from."""
        known, there = self._record(result), self._files(names)
        return sorted(b for b, files in there.items() if known.get(b) != files)

    def refresh(self, result: str, names: Sequence[str], build: Callable[[Tables], DataFrame]) -> list[int]:
        """Bring ``result`` up to date and return the buckets that were built.

        ``build`` takes the base tables ``names`` and returns rows with the key; rows of a stay may depend on that stay's
        rows only. The record is written after the rows, so a refresh that fails is done again by the next.
        """
        files = self._files(names)
        known = self._record(result)
        todo = sorted(b for b, f in files.items() if known.get(b) != f)
        if not todo:
            return []
        rows = build({n: self.base(n, todo) for n in names}).withColumn(_BUCKET, self._bucket())
        path = f"{self.root}/results/{result}"
        before = self._stored(path)
        dealt = rows.repartition(len(todo), _BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
        # a dynamic overwrite leaves a bucket alone that has no rows any more
        after = self._stored(path)
        for b in todo:
            if b in before and before[b] == after[b]:
                self._delete(f"{path}/{_BUCKET}={b}")
        built = self.spark.createDataFrame([(b, files[b]) for b in todo], "bucket int, files string").withColumn("at", F.current_timestamp())
        built.coalesce(1).write.mode("append").parquet(f"{self.root}/built/{result}")
        return todo

    def read(self, result: str, schema: str) -> DataFrame:
        """A result as it was last refreshed; ``schema`` also holds when no stay has any rows."""
        path = f"{self.root}/results/{result}"
        if not self._stored(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, {_BUCKET} int").parquet(path).drop(_BUCKET)
