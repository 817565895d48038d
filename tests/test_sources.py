import pytest
from pyspark.sql import functions as F

from bedside.sources.lineage import cut, scratch_folder
from bedside.sources.tables import (
    CLINICAL_SCHEMAS, append_results, load_clinical, load_table, materialize, read_samples,
)


def test_csv_is_bound_by_name(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_text(
        "Spo2,extra,subject_id,gender,age,Fio2,Peep,Vt,Map,Temperature,vaso,Pao2,Sao2,Paco2\n"
        "95,zz,7,1,60.5,0.4,,400,70,37,1,80,,40\n"
    )
    row = read_samples(spark, str(path)).first()
    assert (row["subject_id"], row["Spo2"], row["Fio2"], row["Peep"], row["Sao2"]) == (7, 95.0, 0.4, None, None)
    bad = tmp_path / "bad.csv"
    bad.write_text("Spo2\n95\n")
    with pytest.raises(ValueError, match="columns missing"):
        read_samples(spark, str(bad))


def test_csv_files_of_one_folder_share_a_header(spark, tmp_path):
    names = "subject_id,gender,age,Spo2,Fio2,Peep,Vt,Map,Temperature,vaso,Pao2,Sao2,Paco2".split(",")
    values = [str(i) for i in range(1, 14)]
    folder = tmp_path / "samples"
    folder.mkdir()
    (folder / "a.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    (folder / "b.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    assert [r["Paco2"] for r in read_samples(spark, str(folder)).collect()] == [13.0, 13.0]
    (folder / "b.csv").write_text(",".join(names[::-1]) + "\n" + ",".join(values[::-1]) + "\n")
    with pytest.raises(Exception, match="header"):
        read_samples(spark, str(folder)).collect()


def test_materialize_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    materialize(spark.range(5).toDF("id"), path)
    assert materialize(spark.range(3).toDF("id"), path).count() == 3
    assert materialize(spark.range(2).toDF("id"), "bedside_view", table=True).count() == 2
    assert materialize(spark.range(4).toDF("id"), "bedside_view", table=True).count() == 4
    spark.sql("DROP TABLE bedside_view")


def test_results_accumulate(spark, tmp_path):
    path = str(tmp_path / "results")
    for model in ("a", "b"):
        append_results(spark.range(2).withColumn("model", F.lit(model)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.where("model = 'b'").count() == 2


def test_clinical_tables(spark, tmp_path):
    for name, schema in CLINICAL_SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    tables = load_clinical(spark, str(tmp_path))
    assert {n: t.schema.names for n, t in tables.items()} == {n: s.names for n, s in CLINICAL_SCHEMAS.items()}


def test_cut_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    rows = cut(spark.range(10))
    assert rows.count() == 10
    assert folder in spark.sparkContext.getCheckpointDir() and folder in scratch_folder(spark)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = (
        load_table(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_orderkey")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_scratch_is_removed_table_by_table_and_at_once(spark):
    import os

    from bedside.sources import lineage

    folder = lineage.scratch_folder(spark).rsplit("/", 1)[0].removeprefix("file:")
    # a folder of its own, so that other tests' tables stay
    place = f"{folder}/of_this_test"
    spark.sparkContext.setCheckpointDir(place)
    try:
        root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        one = lineage.written(spark.range(5).selectExpr("id", "id % 2 AS part"), partition_by=["part"])
        two = lineage.written(spark.range(3))
        assert one.where("part = 1").count() == 2 and two.count() == 3 and len(os.listdir(root)) == 2
        lineage.remove(one)
        assert len(os.listdir(root)) == 1 and two.count() == 3
        lineage.release(spark)
        assert os.listdir(root) == []
    finally:
        spark.sparkContext.setCheckpointDir(folder.rsplit("/", 1)[0])
