"""Adapters from the order tables to daily bars and constituents.

A nation's shipments are its ticker: unit prices of a day give the bar, the
region is the sector. Both outputs grow with ``lineitem`` only in their input.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

MARKET = "MARKET"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their ticker: dimension joins, no shuffle of the fact table
    while the supplier table stays under the broadcast threshold."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate",
    ).filter(F.col("l_shipdate").isNotNull())
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(
            F.upper(F.trim("n_name")).alias("ticker"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("amount"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            "l_discount", "l_tax",
            _line_order().alias("ord"),
        )
    )


def _line_order():
    """All line keys as one number: a fixed-size order key keeps aggregates hashed."""
    wide = "decimal(38,0)"
    parts = (("l_orderkey", 10 ** 24), ("l_linenumber", 10 ** 22), ("l_partkey", 10 ** 11),
             ("l_suppkey", 1))
    terms = [F.col(c).cast(wide) * F.lit(Decimal(scale)).cast(wide) for c, scale in parts]
    return sum(terms[1:], terms[0]).cast(wide)


def _bar_columns() -> list:
    """Bar aggregates; all combine map-side, so a hot ticker is one row per day and task."""
    return [
        F.min_by("unit", "ord").alias("open"), F.max("unit").alias("high"),
        F.min("unit").alias("low"), F.max_by("unit", "ord").alias("close"),
        (F.sum("amount") / F.sum("quantity")).alias("adjusted_close"),
        F.sum("quantity").alias("volume"),
    ]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).groupBy("ticker", "date").agg(*_bar_columns())


def market_bars(stock_bars: DataFrame) -> DataFrame:
    """The whole market as one proxy ticker, from the bars (not from the fact table)."""
    value = F.sum(F.col("adjusted_close") * F.col("volume")) / F.sum("volume")
    return stock_bars.groupBy("date").agg(
        value.alias("adjusted_close"), F.sum("volume").alias("volume"),
    ).select(F.lit(MARKET).alias("ticker"), "date", "adjusted_close", "volume")


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw vendor-style rows, one per line item, with text prices and real defects.

    Days repeat, some prices are unreadable text and some volumes are zero: the
    input of the quality checks.
    """
    unit = F.col("unit")
    return shipments(spark, sf_dir).select(
        "ticker", F.date_format("date", "yyyy-MM-dd").alias("Date"),
        unit.cast("string").alias("Open"), (unit * 1.01).cast("string").alias("High"),
        F.when(F.col("l_discount") > 0.095, F.lit("-1")).otherwise(
            (unit * 0.99).cast("string")).alias("Low"),
        unit.cast("string").alias("Close"),
        F.when(F.col("l_tax") > 0.075, F.lit("n/a")).otherwise(
            unit.cast("string")).alias("Adj Close"),
        F.when(F.col("l_discount") < 0.005, F.lit(0.0)).otherwise(
            F.col("quantity")).alias("Volume"),
        "ord",
    )


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies, regions as sectors, in key order."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.upper(F.trim("n_name")).alias("ticker"), F.col("n_name").alias("company_name"),
        F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
        F.col("n_nationkey").cast("long").alias("row_no"),
    )
