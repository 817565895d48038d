"""Table scans, materialised results and appended result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

_N, _I, _S, _F, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CLINICAL_SCHEMAS = {
    "chartevents": _schema(
        subject_id=_N, icustay_id=_N, itemid=_I, charttime=_TS, value=_S, valueuom=_S, error=_I
    ),
    "procedureevents_mv": _schema(icustay_id=_N, itemid=_I, starttime=_TS),
    "labevents": _schema(subject_id=_N, itemid=_I, charttime=_TS, value=_S, valueuom=_S),
    "inputevents_cv": _schema(
        icustay_id=_N, charttime=_TS, itemid=_I, stopped=_S, rate=_F, amount=_F
    ),
    "inputevents_mv": _schema(
        icustay_id=_N, linkorderid=_N, starttime=_TS, endtime=_TS, itemid=_I, statusdescription=_S
    ),
    "patients": _schema(subject_id=_N, dob=_TS, gender=_S),
}

SAMPLE_SCHEMA = _schema(
    subject_id=_N, gender=_I, age=_F, Spo2=_F, Fio2=_F, Peep=_F, Vt=_F, Map=_F,
    Temperature=_F, vaso=_F, Pao2=_F, Sao2=_F, Paco2=_F,
)


def load_table(
    spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet table ``directory/name.parquet``; a given schema spares the footer read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{directory}/{name}.parquet")


def load_clinical(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {n: load_table(spark, directory, n, s) for n, s in CLINICAL_SCHEMAS.items()}


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """CSV with a header. Columns are bound by name, so their order in the file does not matter.

    The header line is read first (one line), and the file is then read with a full schema in the
    order of the header; an empty cell is NULL. A folder's files must share one header: a file with another one fails,
    as its cells would land in wrong columns. A cell that is no number in a numeric column fails as well.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    wanted = {field.name: field for field in schema}
    missing = sorted(set(wanted) - set(header))
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    full = T.StructType([wanted.get(n, T.StructField(n, T.StringType())) for n in header])
    reader = spark.read.schema(full).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(path).select(*schema.names)


def materialize(df: DataFrame, target: str, *, table: bool = False) -> DataFrame:
    """Drop-and-create: write the result in full and read it back, which also cuts its lineage."""
    spark = df.sparkSession
    if table:
        df.write.mode("overwrite").saveAsTable(target)
        return spark.table(target)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def append_results(df: DataFrame, path: str, by: str = "model") -> None:
    """Add result rows to a growing result set, one folder per ``by`` value."""
    df.write.mode("append").partitionBy(by).parquet(path)
