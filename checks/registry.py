"""Query registry: a Spark callable and, where SQL can say it, an oracle per operator id."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Named SELECTs the oracles build on; each may use sources and names that come before it.
VIEWS: dict[str, str] = {}


class Inputs:
    """Driver tables and derived inputs as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in inputs.SOURCES:
            df = inputs.source(self.spark, self._dir, name)
        else:
            df = inputs.driver_table(self.spark, self._dir, name)
        setattr(self, name, df)
        return df

    def clinical(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in inputs.CLINICAL}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Half away from zero on the scaled double, as the oracle engine rounds (F.round goes through decimals)."""
    scale = float(10**digits)

    def whole(c: str) -> Column:
        return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale

    return df.select(*[whole(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def with_views(sql: str) -> str:
    """Put the sources and views a statement needs in front of it."""
    needed: list[str] = []

    def visit(text: str, upto: list[str]) -> None:
        for name in upto:
            if name not in needed and _uses(text, name):
                body = VIEWS.get(name) or inputs.oracle_source(name)
                before = list(inputs.SOURCES) if name in inputs.SOURCES else list(inputs.SOURCES) + list(VIEWS)[: list(VIEWS).index(name)]
                visit(body, [] if name in inputs.SOURCES else before)
                needed.append(name)

    visit(sql, list(inputs.SOURCES) + list(VIEWS))
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS.get(n) or inputs.oracle_source(n)})" for n in needed)
    return f"WITH {ctes}\n{sql}"


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the columns both sides round to six digits."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Inputs(spark, sf_dir)))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            if doubles:
                swaps = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
                text = f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return fn

    return register
