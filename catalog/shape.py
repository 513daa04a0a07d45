"""Output shape of a query, applied alike to the Spark result and to its SQL twin.

A column is ``name`` (as is), ``name:d`` (ISO date text), ``name:i`` (whole number)
or ``name:<digits>`` (rounded number; infinities become NULL). Rounding is spelled as
the same arithmetic on both sides, and its boundary lies a little off the half: prices
are cents over small quantities, so exact decimal ties are common, and a sum taken in
another order may fall on either side of one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.columns import finite

from .setup import research
from .sql import compose


HALF = 0.5123


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable  # (Research, spark, sf_dir) -> DataFrame
    columns: str
    sql: str | None = None

    def fields(self) -> list[tuple[str, str]]:
        return [tuple((c + ":").split(":")[:2]) for c in self.columns.split()]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(research(spark, sf_dir), spark, sf_dir)
        return df.select(*[_spark_column(n, k).alias(n) for n, k in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(f"{_sql_column(n, k)} AS {n}" for n, k in self.fields())
        return compose(f"SELECT {shown} FROM ({self.sql}) q")


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "":
        return c
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "i":
        return c.cast("long")
    scale = 10.0 ** int(kind)
    return F.floor(finite(c.cast("double")) * scale + HALF) / scale


def _sql_column(name: str, kind: str) -> str:
    if kind == "":
        return f"q.{name}"
    if kind == "d":
        return f"strftime(CAST(q.{name} AS DATE), '%Y-%m-%d')"
    if kind == "i":
        return f"CAST(q.{name} AS BIGINT)"
    value = f"CAST(q.{name} AS DOUBLE)"
    scale = f"{10 ** int(kind)}.0::DOUBLE"
    return f"CASE WHEN isfinite({value}) THEN floor({value} * {scale} + {HALF}) / {scale} END"
