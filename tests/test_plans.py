"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from checks import registry
from bedside.operators.nearest import argmin_rows

QUERIES = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}
FIT = {n for n in QUERIES if n.startswith(("m7", "m8", "m9", "m10", "m11", "m13", "m14", "m15", "m17", "m18", "m20", "s6"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in FIT and n[0] in "cjpnw"))
def test_no_pairwise_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_argmin_reduces_before_the_exchange_and_has_no_window(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    text = plan(argmin_rows(df, ["user_id"], ["value"]))
    assert "Window" not in text and "partial_min" in text


def test_windows_of_one_operator_share_one_exchange(spark, sf_dir):
    text = plan(QUERIES["w3_running_episode_number"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_code_filter_reaches_the_scan(spark, tmp_path):
    from bedside.operators.events import filter_codes
    from bedside.sources.tables import CLINICAL_SCHEMAS, load_clinical

    for name, schema in CLINICAL_SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    chart = load_clinical(spark, str(tmp_path))["chartevents"]
    text = plan(filter_codes(chart, "itemid", [646, 220277]).select("subject_id"))
    assert "In(itemid, [220277,646])" in text.replace("646,220277", "220277,646")
