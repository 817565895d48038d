"""Refreshing changed stays against a full rebuild."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from bedside.operators.episodes import vent_episodes
from bedside.plans import cohort
from bedside.plans.incremental import StayStore
from bedside.sources.tables import CLINICAL_SCHEMAS
from checks.inputs import source

NAMES = ["chartevents", "procedureevents_mv"]
RESULT = "icustay_id long, ventnum long, starttime timestamp_ntz, endtime timestamp_ntz, duration_hours double"

def bucket():
    return F.expr("pmod(xxhash64(icustay_id), 8)")


def episodes(tables):
    return vent_episodes(cohort.vent_settings(tables["chartevents"], tables["procedureevents_mv"]))


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    return {n: source(spark, sf_dir, n).cache() for n in NAMES}


@pytest.fixture
def store(spark, tmp_path):
    return StayStore(spark, str(tmp_path), {n: CLINICAL_SCHEMAS[n] for n in NAMES}, buckets=8)


def test_refresh_after_an_append_equals_a_full_rebuild(base, store):
    early = {n: df.where(F.col("icustay_id") % 10 < 7) for n, df in base.items()}
    for n in NAMES:
        store.append(n, early[n])
    assert len(store.refresh("episodes", NAMES, episodes)) >= 5 and store.refresh("episodes", NAMES, episodes) == []
    assert rows(store.read("episodes", RESULT)) == rows(episodes(early))
    # later rows of a few stays, old and new ones: only their buckets are read and written
    later = base["chartevents"].where("icustay_id % 10 >= 7")
    two = sorted(r[0] for r in later.select(bucket().cast("int")).distinct().collect())[:2]
    assert len(two) == 2
    late = {n: df.where("icustay_id % 10 >= 7").where(bucket().isin(two)) for n, df in base.items()}
    before = store._stored(f"{store.root}/results/episodes")
    for n in NAMES:
        store.append(n, late[n])
    assert store.changed("episodes", NAMES) == two
    read = {f.rsplit("=", 1)[1].split("/")[0] for f in store.base("chartevents", two).select("icustay_id", "_metadata.file_path").distinct().toPandas()["file_path"]}
    plan = store.base("chartevents", two)._jdf.queryExecution().executedPlan().toString()
    assert read == set(map(str, two)) and "__bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.refresh("episodes", NAMES, episodes) == two
    after = store._stored(f"{store.root}/results/episodes")
    assert {b for b in after if after[b] != before.get(b)} <= set(two)
    both = {n: early[n].unionByName(late[n]) for n in NAMES}
    assert rows(store.read("episodes", RESULT)) == rows(episodes(both))


def test_a_failed_refresh_is_done_again_and_emptied_buckets_go(base, store):
    for n in NAMES:
        store.append(n, base[n])

    def failing(tables):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.refresh("episodes", NAMES, failing)
    assert store.changed("episodes", NAMES) == store.refresh("episodes", NAMES, episodes)
    one = store.read("episodes", RESULT).select(bucket().cast("int")).first()[0]
    store.append("chartevents", base["chartevents"].where(bucket() == one).limit(1))
    assert store.refresh("episodes", NAMES, lambda t: episodes(t).where("false")) == [one]
    got = store.read("episodes", RESULT)
    assert got.where(bucket() == one).count() == 0 and got.count() > 0


def test_empty_store(store):
    assert store.refresh("episodes", NAMES, episodes) == []
    assert store.read("episodes", RESULT).count() == 0 and store.base("chartevents").count() == 0
