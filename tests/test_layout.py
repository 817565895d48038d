"""Tables stored by stay: same results, no exchange of base rows."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from bedside.operators import nearest
from bedside.plans.cohort import Cohort
from bedside.plans.layout import PLACES, StayLayout
from bedside.sources.tables import CLINICAL_SCHEMAS
from checks.inputs import CLINICAL, source

RESULTS = ["episodes", "index_samples", "long_covariates", "age_gender_vaso"]


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    return {n: source(spark, sf_dir, n).cache() for n in CLINICAL}


@pytest.fixture(scope="module")
def expected(base):
    cohort = Cohort(base)
    return {n: (getattr(cohort, n).columns, rows(getattr(cohort, n))) for n in RESULTS}


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanged_scans(df):
    """Base tables with a hash exchange somewhere above their scan."""
    found = []

    def walk(node, below):
        name = node.nodeName()
        if name.startswith("Scan parquet") and below:
            found.append(node.toString())
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan(), below)
        below = below or (name == "Exchange" and "hashpartitioning" in node.toString().split("\n")[0])
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), below)

    walk(df._jdf.queryExecution().executedPlan(), False)
    return found


@pytest.mark.parametrize("hot_rows", [5_000_000, 60])
def test_equals_the_cohort_of_plain_tables(spark, base, expected, tmp_path, hot_rows):
    layout = StayLayout(spark, str(tmp_path), 8, hot_rows).write({n: df.withColumn("extra", F.lit(1)) for n, df in base.items()})
    assert len(layout._cohorts) == (1 if hot_rows > 1000 else 2)
    for name, (columns, want) in expected.items():
        assert rows(layout.result(name), *columns) == want, name
    # a later session knows the tables by their folder alone
    for name in PLACES:
        spark.sql(f"DROP TABLE {layout._name}_{name}")
    again = StayLayout(spark, str(tmp_path))
    columns, want = expected["episodes"]
    assert rows(again.result("episodes"), *columns) == want
    assert "Bucketed: true" in again._cohorts[0].settings._jdf.queryExecution().executedPlan().toString()


def test_base_rows_are_not_exchanged(spark, sf_dir, base, tmp_path, no_broadcast, monkeypatch):
    layout = StayLayout(spark, str(tmp_path), 8).write(base)
    cohort = Cohort(layout._cohorts[0].tables, reuse=lambda df: df, in_place=True)
    assert exchanged_scans(cohort.settings) == [] == exchanged_scans(cohort.episodes)
    assert exchanged_scans(Cohort({n: source(spark, sf_dir, n) for n in CLINICAL}).settings) != []
    written = []
    monkeypatch.setattr(nearest, "cut", lambda df: written.append(exchanged_scans(df)) or df.checkpoint())
    index = layout._cohorts[0].index_samples
    labs_then_charts = [[s for s in scans if "labevents" in s or "chartevents" in s] for scans in written]
    assert labs_then_charts == [[], []] and index.count() > 0
    assert exchanged_scans(layout._cohorts[0].chart_covariates) == []
    durations = exchanged_scans(layout._cohorts[0].vasopressor_durations)
    assert len(durations) <= 2  # the union of the two systems' merged intervals, not their rows


def test_hot_rows_of_a_union_are_written_by_several_tasks(spark, sf_dir, tmp_path, no_broadcast):
    """F16: with semi joins below each branch of the union, one task wrote all hot charts."""
    sizes = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        tables = {n: source(spark, sf_dir, n) for n in CLINICAL}
        layout = StayLayout(spark, str(tmp_path), 8, 60).write(tables)
    finally:
        for key in sizes:
            spark.conf.unset(key)
    hot = layout._cohorts[1].tables["chartevents"]
    assert len(hot.inputFiles()) > 1
    assert hot.count() + layout._cohorts[0].tables["chartevents"].count() == tables["chartevents"].count()


def test_stays_of_a_patient_are_kept_together(spark, base, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    chart = [(1, 10, 646, t0 + dt.timedelta(minutes=i), "95", "%", 0) for i in range(50)]  # a hot stay
    chart += [(1, 11, 646, t0, "95", "%", 0), (2, 20, 646, t0, "95", "%", 0), (3, 11, 646, t0, "95", "%", 0), (3, 30, 646, t0, "95", "%", 0)]
    chart += [(4, None, 646, t0, "95", "%", 0)] * 40
    labs = [(p, 490, t0, "80", "mmHg") for p in (1, 2, 3, 4)]
    tables = {n: spark.createDataFrame([], s) for n, s in CLINICAL_SCHEMAS.items()}
    tables["chartevents"] = spark.createDataFrame(chart, CLINICAL_SCHEMAS["chartevents"])
    tables["labevents"] = spark.createDataFrame(labs, CLINICAL_SCHEMAS["labevents"])
    usual, hot = StayLayout(spark, str(tmp_path), 4, hot_rows=30).write(tables)._cohorts
    stays = [{r[0] for r in c.tables["chartevents"].select("icustay_id").collect()} for c in (usual, hot)]
    # stay 11 has charts of two patients, so patient 3 and stay 30 follow
    assert stays == [{20}, {10, 11, 30, None}]
    assert [{r[0] for r in c.tables["labevents"].select("subject_id").collect()} for c in (usual, hot)] == [{2, 4}, {1, 3}]


def test_empty_tables(spark, tmp_path):
    layout = StayLayout(spark, str(tmp_path), 4).write({n: spark.createDataFrame([], s) for n, s in CLINICAL_SCHEMAS.items()})
    assert layout.result("long_covariates").count() == 0 and layout.result("vasopressor_durations").count() == 0
