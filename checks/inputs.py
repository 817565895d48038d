"""Clinical-shaped inputs derived from the driver tables.

Each input is one SELECT that Spark SQL and DuckDB both accept, so a query and its oracle read the
same rows. Every row of the driver table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STAY = """CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS BIGINT)
        WHEN day(ts) < 16 THEN user_id * 2 ELSE user_id * 2 + 1 END"""


def _rows(item: str, offset: str, value: str, unit: str, where: str) -> str:
    at = f"ts + {offset}" if offset else "ts"
    return f"""SELECT user_id AS subject_id, {_STAY} AS icustay_id, CAST({item} AS INT) AS itemid,
  {at} AS charttime, {value} AS value, '{unit}' AS valueuom,
  CASE WHEN event_id % 13 = 0 THEN 1 WHEN event_id % 13 = 1 THEN CAST(NULL AS INT) ELSE 0 END AS error
FROM {{events}} WHERE {where}"""


def _lab(item: str, offset: str, value: str, where: str) -> str:
    at = f"ts + {offset}" if offset else "ts"
    return f"""SELECT user_id AS subject_id, CAST({item} AS INT) AS itemid, {at} AS charttime,
  {value} AS value, 'mmHg' AS valueuom
FROM {{events}} WHERE {where}"""


_VENT = "event_type IN ('click', 'view')"

SOURCES = {
    "chartevents": "\nUNION ALL ".join(
        [
            _rows("720", "", "CASE WHEN event_id % 11 = 0 THEN 'Other/Remarks' ELSE 'Assist Control' END", "", _VENT),
            _rows("505", "INTERVAL 3 HOUR", "CAST(event_id % 45 AS STRING)", "cmH2O", _VENT),
            _rows("682", "INTERVAL 6 HOUR", "CAST(300 + event_id % 4000 AS STRING)", "ml", _VENT),
            _rows("467", "", "CASE WHEN event_id % 3 = 0 THEN 'Ventilator' WHEN event_id % 3 = 1 THEN 'Nasal Cannula' ELSE 'None' END", "", "event_type = 'signup'"),
            _rows("226732", "INTERVAL 2 HOUR", "CASE WHEN event_id % 2 = 0 THEN 'Face tent' ELSE 'Trach mask ' END", "", "event_type = 'signup'"),
            _rows("640", "", "CASE WHEN value > 40 THEN 'Self Extubation' ELSE 'Extubated' END", "", "event_type = 'error'"),
            _rows("646", "(event_id % 37) * INTERVAL 1 MINUTE", "CASE WHEN event_id % 19 <> 0 THEN CAST(60 + event_id % 41 AS STRING) END", "%", "event_id IS NOT NULL"),
            _rows("220277", "INTERVAL 95 MINUTE", "CAST(65 + event_id % 36 AS STRING)", "%", _VENT),
            _rows("223835", "INTERVAL 20 MINUTE", "CAST(21 + event_id % 80 AS STRING)", "%", "event_id IS NOT NULL"),
            _rows("52", "INTERVAL 45 MINUTE", "CAST(50 + event_id % 60 AS STRING)", "mmHg", "event_id IS NOT NULL"),
            _rows("676", "INTERVAL 50 MINUTE", "CAST(35 + event_id % 66 AS STRING)", "C", "event_id IS NOT NULL"),
            _rows("445", "INTERVAL 70 MINUTE", "CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(5 + event_id % 9 AS STRING) END", "l", "event_type = 'view'"),
        ]
    ),
    "procedureevents_mv": f"""SELECT {_STAY} AS icustay_id,
  CAST(CASE WHEN event_id % 3 = 0 THEN 225468 WHEN event_id % 3 = 1 THEN 227194 ELSE 225477 END AS INT) AS itemid,
  ts AS starttime FROM {{events}} WHERE event_type = 'error' AND value > 60
UNION ALL SELECT {_STAY}, CAST(224385 AS INT), ts FROM {{events}} WHERE event_type = 'view'""",
    "labevents": "\nUNION ALL ".join(
        [
            _lab("50821", "(event_id % 41) * INTERVAL 1 MINUTE", "CAST(40 + event_id % 200 AS STRING)", "event_type <> 'error'"),
            _lab("490", "(event_id % 29) * INTERVAL 1 MINUTE", "CAST(45 + event_id % 150 AS STRING)", "event_type = 'purchase'"),
            _lab("50818", "(event_id % 41) * INTERVAL 1 MINUTE", "CAST(30 + event_id % 30 AS STRING)", "event_type <> 'error'"),
            _lab("50817", "(event_id % 41) * INTERVAL 1 MINUTE", "CASE WHEN event_id % 5 <> 0 THEN CAST(70 + event_id % 30 AS STRING) END", "event_type = 'click'"),
            _lab("50831", "(event_id % 41) * INTERVAL 1 MINUTE", "'7'", "event_type = 'view'"),
            _lab("50811", "INTERVAL 3 HOUR", "CAST(7 + event_id % 9 AS STRING)", "event_id IS NOT NULL"),
            _lab("50804", "INTERVAL 30 MINUTE", "CAST(20 + event_id % 15 AS STRING)", "event_id IS NOT NULL"),
        ]
    ),
    "inputevents_cv": f"""SELECT {_STAY} AS icustay_id, ts AS charttime,
  CAST(CASE event_type WHEN 'purchase' THEN 30047 WHEN 'click' THEN 30120 WHEN 'view' THEN 42273
       WHEN 'signup' THEN 30047 ELSE 41913 END AS INT) AS itemid,
  CASE WHEN value > 110 THEN 'Stopped' WHEN event_id % 23 = 0 THEN 'D/C''d' WHEN event_id % 3 = 0 THEN 'Restart' END AS stopped,
  CASE WHEN value < 5 THEN 0e0 WHEN event_id % 4 <> 0 THEN floor(value / 10) END AS rate,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 5 - 1 AS DOUBLE) END AS amount
FROM {{events}}""",
    "inputevents_mv": f"""SELECT {_STAY} AS icustay_id, user_id * 1000 + CAST(floor(value / 12) AS BIGINT) AS linkorderid,
  ts AS starttime, CASE WHEN event_id % 17 <> 3 THEN ts + (event_id % 900) * INTERVAL 1 MINUTE END AS endtime,
  CAST(CASE event_type WHEN 'purchase' THEN 221906 WHEN 'click' THEN 221289 WHEN 'signup' THEN 222315 ELSE 225158 END AS INT) AS itemid,
  CASE WHEN event_id % 6 = 0 THEN 'Rewritten' WHEN event_id % 6 <> 1 THEN 'FinishedRunning' END AS statusdescription
FROM {{events}}""",
    "patients": """SELECT c_custkey AS subject_id,
  CAST(CAST('1930-01-01' AS DATE) AS TIMESTAMP) + (c_custkey * 17 % 25000) * INTERVAL 1 DAY AS dob,
  CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender
FROM {customer}""",
    # value * 3 minutes long, ends before it starts for every 50th event, one bound unknown for some
    "spans": """SELECT user_id AS entity, event_id, CASE WHEN event_id % 31 <> 5 THEN ts END AS starttime,
  CASE WHEN event_id % 29 <> 3 THEN ts END + CASE WHEN event_id % 50 = 0 THEN -1 ELSE 1 END * CAST(round(value * 180) AS BIGINT) * INTERVAL 1 SECOND AS endtime
FROM {events}""",
    "samples": """SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS visit,
  l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_orderkey AS subject_id, CAST(l_linenumber % 2 AS INT) AS gender, 18e0 + l_partkey % 80 AS age,
  50e0 + l_quantity AS Spo2,
  CASE l_linenumber WHEN 7 THEN 1e2 * (0.2e0 + 8e0 * l_discount) WHEN 6 THEN 0e0 ELSE 0.2e0 + 8e0 * l_discount END AS Fio2,
  6e2 * l_tax AS Peep,
  l_extendedprice / 20e0 AS Vt,
  CASE WHEN l_linenumber <> 3 THEN 60e0 + l_linenumber END AS Map,
  CASE WHEN l_returnflag = 'A' THEN (36e0 + l_discount * 20e0) * 1.8e0 + 32e0 ELSE 36e0 + l_discount * 20e0 END AS Temperature,
  CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END AS vaso,
  40e0 + l_extendedprice / 250e0 AS Pao2,
  CASE WHEN l_suppkey % 9 <> 0 THEN 60e0 + l_quantity * 15e0 END AS Sao2,
  30e0 + l_tax * 200e0 AS Paco2
FROM {lineitem}""",
}

CLINICAL = (
    "chartevents", "procedureevents_mv", "labevents", "inputevents_cv", "inputevents_mv", "patients",
)
_TABLE_OF = {"patients": "customer", "samples": "lineitem"}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from bedside.sources.tables import load_table

    return load_table(spark, sf_dir, name)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _TABLE_OF.get(name, "events")
    df = spark.sql(SOURCES[name], **{table: driver_table(spark, sf_dir, table)})
    # The portable text leaves Spark with zoned timestamps where it casts; the data has none.
    zoned = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: df[n].cast("timestamp_ntz") for n in zoned}) if zoned else df


def oracle_source(name: str) -> str:
    table = _TABLE_OF.get(name, "events")
    return SOURCES[name].replace("{" + table + "}", table)
