"""Clinical tables stored by stay and patient, so that a cohort is built where its rows lie.

Tables with a stay are written in buckets of the stay, the others in buckets of the patient, sorted by time within
them. Grouping, windows and joins on the key then need no exchange of base rows. A bucket is one task, so stays and
patients with very many rows are not put into buckets: they form a second set of plain tables, with all stays of
their patients, and go through the plans that split timelines. Every stay is in one of the two sets with all that its
results depend on, so a result of the whole is the union of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.running import HOT_ROWS
from ..sources.lineage import cut
from ..sources.tables import CLINICAL_SCHEMAS
from .cohort import Cohort

# Where rows of a table lie: the key of its buckets, and the order within.
PLACES = {
    "chartevents": ("icustay_id", "charttime"),
    "procedureevents_mv": ("icustay_id", "starttime"),
    "inputevents_cv": ("icustay_id", "charttime"),
    "inputevents_mv": ("icustay_id", "starttime"),
    "labevents": ("subject_id", "charttime"),
    "patients": ("subject_id", "dob"),
}


class StayLayout:
    """The six clinical tables below ``root``, a folder that driver and executors share.

    ``buckets`` is fixed when the tables are written: about the bytes of the largest table over the size of a task's
    input. Keys with more than ``hot_rows`` rows in any table are hot. Rows without a stay (or patient) are one group.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 200, hot_rows: int = HOT_ROWS):
        self.spark, self.root, self.buckets, self.hot_rows = spark, root.rstrip("/"), buckets, hot_rows
        self._name = "bedside_" + hashlib.sha256(self.root.encode()).hexdigest()[:12]

    def write(self, tables: Mapping[str, DataFrame]) -> StayLayout:
        """Replace what is stored by ``tables``; extra columns are left out."""
        rows = {n: tables[n].select(*CLINICAL_SCHEMAS[n].names) for n in PLACES}
        hot = self._hot_keys(rows)
        for name, (key, time) in PLACES.items():
            usual, apart = rows[name], None
            if hot is not None:
                # Not semi and anti joins: Spark pushes these into each branch of a table that is a union, where every branch is
                # dealt by itself and all are then zipped into as few tasks as the smallest branch needs. Hot keys are distinct.
                found = hot[key].withColumn("__found", F.lit(True))
                same = rows[name][key].eqNullSafe(found["__hot"])
                apart = rows[name].join(found, same).drop("__hot", "__found")
                usual = rows[name].join(found, same, "left").where("__found IS NULL").drop("__hot", "__found")
            # The exchange deals rows as buckets do: one file a bucket.
            dealt = usual.repartition(self.buckets, key)
            dealt.write.mode("overwrite").bucketBy(self.buckets, key).sortBy(key, time).option("path", f"{self.root}/usual/{name}").saveAsTable(f"{self._name}_{name}")
            if apart is not None:
                apart.write.mode("overwrite").parquet(f"{self.root}/hot/{name}")
        facts = self.spark.createDataFrame([(self.buckets, self.hot_rows, hot is not None)], "buckets int, hot_rows long, has_hot boolean")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/layout")
        self.__dict__.pop("_cohorts", None)
        return self

    def _hot_keys(self, rows: Mapping[str, DataFrame]) -> dict[str, DataFrame] | None:
        """Hot stays and patients as tables of keys, or None; counts are combined before they are exchanged."""

        # Charts are read once, for their counts and for which stays a patient has.
        stays = cut(rows["chartevents"].groupBy("icustay_id", "subject_id").count())

        def large(name: str) -> DataFrame:
            key = F.col(PLACES[name][0]).alias("__hot")
            counts = stays.groupBy(key).agg(F.sum("count").alias("count")) if name == "chartevents" else rows[name].groupBy(key).count()
            return counts.where(F.col("count") > self.hot_rows).select("__hot")

        def by(key: str) -> DataFrame:
            parts = [large(n) for n, (k, _) in PLACES.items() if k == key]
            return cut(reduce(DataFrame.union, parts).distinct())

        hot = {key: by(key) for key in ("icustay_id", "subject_id")}
        sizes = {key: df.count() for key, df in hot.items()}
        if not any(sizes.values()):
            return None
        # All stays of a patient stay together. A second round finds nothing new unless a stay has several patients.
        of = stays.where("icustay_id IS NOT NULL AND subject_id IS NOT NULL").select("icustay_id", "subject_id")
        while True:
            for key, other in (("subject_id", "icustay_id"), ("icustay_id", "subject_id")):
                more = of.join(hot[other], of[other] == F.col("__hot"), "left_semi").select(F.col(key).alias("__hot"))
                hot[key] = cut(hot[key].union(more).distinct())
            now = {key: df.count() for key, df in hot.items()}
            if now == sizes:
                return hot
            sizes = now

    @cached_property
    def _cohorts(self) -> tuple[Cohort, ...]:
        facts = self.spark.read.parquet(f"{self.root}/layout").first()
        usual, hot = {}, {}
        for name, (key, time) in PLACES.items():
            table = f"{self._name}_{name}"
            # a session that did not write the tables learns of their buckets here
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CLINICAL_SCHEMAS[name])
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({key}) "
                f"SORTED BY ({key}, {time}) INTO {facts['buckets']} BUCKETS LOCATION '{self.root}/usual/{name}'"
            )
            usual[name] = self.spark.table(table)
            if facts["has_hot"]:
                hot[name] = self.spark.read.schema(CLINICAL_SCHEMAS[name]).parquet(f"{self.root}/hot/{name}")
        cohorts = (Cohort(usual, hot_rows=facts["hot_rows"], in_place=True),)
        return (*cohorts, Cohort(hot, hot_rows=facts["hot_rows"])) if hot else cohorts

    def result(self, name: str) -> DataFrame:
        """A result of ``Cohort`` by its name, over both sets of tables."""
        return reduce(DataFrame.unionByName, [getattr(c, name) for c in self._cohorts])
