"""Tradable-universe construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import count_business_days, latest, reasons, upper_text
from ..params import UniverseParams

METRICS = ("has_price_data", "row_count", "expected_observations",
           "missing_data_ratio", "min_adjusted_close", "average_daily_dollar_volume",
           "zero_volume_days")


def tradability(prices: DataFrame, p: UniverseParams, unique: bool = False) -> DataFrame:
    """Per-ticker metrics over the period, last source row per day.

    ``unique`` says that ``prices`` already has one row per (ticker, date).
    """
    have = set(prices.columns)
    lacking = [c for c in ("date", "adjusted_close", "volume") if c not in have]
    if lacking:
        return prices.select("ticker").distinct().select(
            "ticker", F.lit(True).alias("has_price_data"),
            F.lit(0).cast("long").alias("row_count"),
            F.lit(0).cast("long").alias("expected_observations"),
            *[F.lit(None).cast("double").alias(c) for c in METRICS[3:6]],
            F.lit(None).cast("long").alias("zero_volume_days"),
            F.lit(None).cast("double").alias("missing_exact"),
            F.lit("missing_price_columns:" + ",".join(lacking)).alias("column_reason"),
        )
    # Rows outside the period share a NULL day, so a ticker without any row inside
    # keeps its line and the prices are scanned once.
    inside = F.col("date").between(F.lit(p.period.start), F.lit(p.period.end))
    rows = latest(prices.select(
        "ticker", F.when(inside, F.col("date")).alias("date"), "adjusted_close", "volume",
        *[c for c in ("ord",) if c in have]), ["ticker", "date"], unique, "prices")
    dated = F.col("date").isNotNull()
    expected = count_business_days(p.period.start, p.period.end)
    metrics = rows.groupBy("ticker").agg(
        F.count("date").alias("row_count"),
        F.min(F.when(dated, F.col("adjusted_close"))).alias("min_adjusted_close"),
        F.avg(F.when(dated, F.col("adjusted_close") * F.col("volume"))).alias("average_daily_dollar_volume"),
        F.count_if(dated & (F.col("volume") == 0)).alias("zero_volume_days"),
    )
    missing = F.greatest(F.lit(expected) - F.col("row_count"), F.lit(0))
    exact = missing / F.lit(float(expected)) if expected else F.lit(0.0)
    return metrics.select(
        "ticker", F.lit(True).alias("has_price_data"), "row_count",
        F.lit(expected).cast("long").alias("expected_observations"),
        F.round(exact, 6).alias("missing_data_ratio"),
        "min_adjusted_close", "average_daily_dollar_volume", "zero_volume_days",
        exact.alias("missing_exact"), F.lit(None).cast("string").alias("column_reason"),
    )


def _below(name: str, bound: float):
    return F.col(name).isNull() | (F.col(name) < bound)


def universe_audit(constituents: DataFrame, prices: DataFrame, p: UniverseParams,
                   unique: bool = False) -> DataFrame:
    """Every constituents row with its metrics, warnings and exclusion reasons.

    ``constituents`` carries ``row_no`` (its source order, from 0).
    """
    rows = constituents.select(
        (F.col("row_no") + 2).cast("long").alias("row_number"),
        upper_text(F.col("ticker")).alias("ticker"), "company_name", "sector", "industry",
    )
    # Blank tickers are never compared, so each gets a key of its own: no hot group.
    same = Window.partitionBy(
        "ticker", F.when(F.col("ticker") == "", F.col("row_number"))
    ).orderBy("row_number")
    rows = rows.withColumn("nth", F.row_number().over(same))
    usable = (F.col("ticker") != "") & (F.col("nth") == 1)
    looked_up = rows.withColumn("lookup", F.when(usable, F.col("ticker"))).join(
        tradability(prices, p, unique).withColumnRenamed("ticker", "lookup"), "lookup", "left"
    )
    unpriced = usable & F.col("has_price_data").isNull()
    measured = usable & F.col("has_price_data") & F.col("column_reason").isNull()
    found = reasons([
        (F.col("ticker") == "", "empty_ticker"),
        ((F.col("ticker") != "") & (F.col("nth") > 1), "duplicate_ticker"),
        (unpriced, "missing_processed_price_data"),
        (F.col("column_reason").isNotNull(), F.col("column_reason")),
        (measured & _below("min_adjusted_close", p.min_adjusted_close_price),
         "below_min_adjusted_close_price"),
        (measured & _below("average_daily_dollar_volume", p.min_average_daily_dollar_volume),
         "below_min_average_daily_dollar_volume"),
        (measured & (F.col("missing_exact") > p.max_missing_data_ratio),
         "excessive_missing_data_ratio"),
        (measured & (F.col("zero_volume_days") > p.max_zero_volume_days), "zero_volume_issue"),
        (measured & (F.col("row_count") < p.min_history_days), "insufficient_history"),
    ])
    warned = reasons([
        (F.trim("sector") == "", "missing_sector"),
        (F.trim("industry") == "", "missing_industry"),
    ])
    return looked_up.select(
        "row_number", "ticker", "company_name", "sector", "industry",
        (F.size(found) == 0).alias("included"),
        F.array_join(found, ";").alias("exclusion_reasons"),
        F.array_join(warned, ";").alias("warnings"),
        F.coalesce("has_price_data", F.lit(False)).alias("has_price_data"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("expected_observations", F.lit(0)).alias("expected_observations"),
        *METRICS[3:],
    )


def clean_universe(audit: DataFrame) -> DataFrame:
    return audit.filter("included").select(
        "ticker", "company_name", "sector", "industry", *METRICS)
