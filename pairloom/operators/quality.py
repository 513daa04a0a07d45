"""Data-quality checks of daily price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import count_business_days, day, latest, norm_header, number, reasons
from ..params import QualityParams

# The standard bar columns, and vendor spellings of two of them.
STANDARD = ("date", "open", "high", "low", "close", "adjusted_close", "volume")
PRICES = ("open", "high", "low", "close", "adjusted_close")
OHLCV = ("open", "high", "low", "close", "volume")
ALIASES = {"adj_close": "adjusted_close", "datetime": "date", "index": "date"}


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Canonical headers; unreadable dates and numbers become NULL."""
    df = norm_header(raw, ALIASES)
    casts = {"date": day}
    casts.update({c: number for c in (*PRICES, "volume")})
    return df.select([casts[c](F.col(c)).alias(c) if c in casts else F.col(c) for c in df.columns])


def in_period(df: DataFrame, p: QualityParams) -> DataFrame:
    if "date" not in df.columns:
        return df
    return df.filter(F.col("date").between(F.lit(p.period.start), F.lit(p.period.end)))


def validation_report(raw: DataFrame, p: QualityParams) -> DataFrame:
    """One row of findings per ticker.

    Two aggregates, both with map-side combine: (ticker, date) first, so that a
    ticker with very many rows is already one row per day when it is summed up.
    Columns the source lacks are known from its schema, before any data is read.
    """
    bars = normalize_bars(raw)
    have = set(bars.columns)
    lost = [c for c in p.required_columns if c not in have]
    lost_ohlcv = [c for c in lost if c in OHLCV]
    prices = [c for c in PRICES if c in have]

    def counted(ok: bool, condition) -> F.Column:
        return F.count_if(condition()) if ok else F.lit(0).cast("long")

    lowest = (lambda: F.least(*prices) <= 0) if len(prices) > 1 else (
        (lambda: F.col(prices[0]) <= 0) if prices else None)
    checks = [
        F.count(F.lit(1)).alias("n"),
        counted("adjusted_close" in have, lambda: F.col("adjusted_close").isNull()).alias("na"),
        counted("volume" in have, lambda: F.col("volume") == 0).alias("zv"),
        counted(bool(prices), lowest).alias("np"),
    ]
    dated = "date" in have
    if dated:
        # Rows outside the period share a NULL day: the ticker keeps its row in the
        # report without a second scan for the list of tickers.
        inside = F.col("date").between(F.lit(p.period.start), F.lit(p.period.end))
        bars = bars.withColumn("date", F.when(inside, F.col("date")))
    daily = bars.groupBy("ticker", *(["date"] if dated else [])).agg(*checks)

    def total(name: str) -> F.Column:
        value = F.when(F.col("date").isNotNull(), F.col(name)) if dated else F.col(name)
        return F.coalesce(F.sum(value), F.lit(0).cast("long"))

    repeated = F.when(F.col("date").isNotNull() & (F.col("n") > 1), F.col("n")) if dated else None
    report = daily.groupBy("ticker").agg(
        (F.count("date") if dated else F.sum("n")).alias("row_count"),
        (F.min("date") if dated else F.lit(None).cast("date")).alias("start_date"),
        (F.max("date") if dated else F.lit(None).cast("date")).alias("end_date"),
        total("na").alias("missing_adjusted_close"), total("zv").alias("zero_volume_days"),
        (F.coalesce(F.sum(repeated), F.lit(0).cast("long")) if dated
         else F.lit(0).cast("long")).alias("duplicated_dates"),
        total("np").alias("non_positive_price_rows"),
    )
    expected = count_business_days(p.period.start, p.period.end)
    missing = F.greatest(F.lit(expected) - F.col("row_count"), F.lit(0)).cast("long")
    report = report.withColumns({
        "expected_observations": F.lit(expected).cast("long"),
        "missing_observations": missing,
        "fraction": missing / F.lit(float(expected)) if expected else F.lit(0.0),
        "missing_ohlcv_columns": F.lit(",".join(lost_ohlcv)),
        "insufficient_history": F.col("row_count") < p.min_history_days,
    })
    excessive = F.col("fraction") > p.max_missing_fraction
    findings = reasons([
        (F.lit("date" in lost), "Missing required date column."),
        (F.lit(bool(lost_ohlcv)), f"Missing OHLCV columns: {', '.join(lost_ohlcv)}."),
        (F.lit("adjusted_close" not in have), "Missing adjusted_close column."),
        (F.col("missing_adjusted_close") > 0, "Adjusted close contains missing values."),
        (F.col("duplicated_dates") > 0, "Duplicated dates detected."),
        (F.col("zero_volume_days") > 0, "Zero volume days detected."),
        (F.col("non_positive_price_rows") > 0, "Non-positive prices detected."),
        (F.col("insufficient_history"), F.format_string(
            f"Only %d observations available; minimum is {p.min_history_days}.",
            F.col("row_count"))),
        (excessive, F.format_string(
            "Missing observation fraction %.2f%% exceeds threshold "
            f"{p.max_missing_fraction:.2%}%.",
            F.col("fraction") * 100)),
    ])
    return report.withColumn("found", findings).select(
        "ticker",
        (F.size("found") == 0).alias("valid"),
        "row_count", "start_date", "end_date", "expected_observations", "missing_observations",
        F.round("fraction", 6).alias("missing_observation_fraction"),
        "missing_adjusted_close", "missing_ohlcv_columns", "zero_volume_days",
        "duplicated_dates", "non_positive_price_rows", "insufficient_history",
        excessive.alias("excessive_missing_observations"),
        F.array_join("found", "; ").alias("issues"),
    )


def clean_bars(raw: DataFrame, p: QualityParams, unique: bool = False) -> DataFrame:
    """Standard columns in the period, last source row (``ord``) per (ticker, date)."""
    bars = in_period(normalize_bars(raw), p)
    columns = ["ticker", *[c for c in STANDARD if c in bars.columns]]
    if "date" not in columns:
        return bars
    bars = bars.select(*columns, *[c for c in ("ord",) if c in bars.columns])
    return latest(bars, ["ticker", "date"], unique, "bars").select(*columns)


def valid_bars(raw: DataFrame, p: QualityParams, unique: bool = False) -> DataFrame:
    """Cleaned bars of the tickers without findings."""
    valid = validation_report(raw, p).filter("valid").select("ticker")
    return clean_bars(raw, p, unique).join(valid, "ticker", "left_semi")
