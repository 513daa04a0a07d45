"""Readers, normalisers and sinks of the research tables.

Readers take Parquet or CSV folders. Normalisers are separate DataFrame functions,
so the same rules apply to any source. CSV columns are read as text and coerced
with rules of their own: unreadable values become missing instead of failing a job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import day, first_row, lower_text, norm_header, number, number_rows, text, upper_text
from ..operators.quality import ALIASES

PREDICTED_Z = ("predicted_zscore", "predicted_z_score", "prediction_zscore", "prediction_z_score")


class MissingColumns(ValueError):
    """A table lacks columns it must have."""


def require(df: DataFrame, columns, label: str) -> DataFrame:
    lost = sorted(set(columns) - set(df.columns))
    if lost:
        raise MissingColumns(f"{label} is missing required columns: {', '.join(lost)}")
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A Parquet table, or a CSV with a header whose columns all arrive as text."""
    if fmt == "csv":
        return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return spark.read.format(fmt).load(path)


def _coerce(df: DataFrame, rules: dict) -> DataFrame:
    return df.select([rules[c](F.col(c)).alias(c) if c in rules else F.col(c) for c in df.columns])


def _rules(upper=(), lower=(), dates=(), numbers=()) -> dict:
    rules = {c: upper_text for c in upper}
    rules.update({c: lower_text for c in lower})
    rules.update({c: day for c in dates})
    rules.update({c: number for c in numbers})
    return rules


# --------------------------------------------------------------------------- prices

def file_ticker(path: Column) -> Column:
    """Ticker key from a ``ticker=`` folder or a per-ticker file name; characters unfit for
    names become '_'."""
    folder = F.regexp_extract(path, r"/ticker=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+)\.csv(?:\.gz)?$", 1))
    return clean_ticker(F.url_decode(name))


def clean_ticker(ticker: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(ticker)), r"[^A-Za-z0-9_.-]+", "_")


def price_paths(spark: SparkSession, folder: str, tickers) -> list[str]:
    """Files and folders of the named tickers, ``<TICKER>.csv`` or ``ticker=<TICKER>``; others are not opened."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = sorted({re.sub(r"[^A-Za-z0-9_.-]+", "_", str(t).strip().upper()) for t in tickers if str(t).strip()})
    out = []
    for name in names:
        for path in (f"{folder}/{name}.csv", f"{folder}/ticker={name}"):
            target = jvm.org.apache.hadoop.fs.Path(path)
            if target.getFileSystem(conf).exists(target):
                out.append(path)
    return out


def read_price_files(spark: SparkSession, folder: str, tickers=None) -> DataFrame:
    """A folder of one CSV per ticker as one long table with a source ordinal.

    ``ord`` follows file order, so "the last row of a day" stays well defined. With ``tickers``
    only their files are listed and read; tickers without a file have no rows, and without any
    file at all the folder's header gives an empty table.
    """
    paths = [folder] if tickers is None else price_paths(spark, folder, tickers)
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option(
        "recursiveFileLookup", True).csv(paths or folder)
    raw = raw if paths else raw.limit(0)
    raw = raw.select("*", file_ticker(F.input_file_name()).alias("ticker"),
                     F.monotonically_increasing_id().alias("ord"))
    bars = norm_header(raw, ALIASES)
    numbers = [c for c in ("open", "high", "low", "close", "adjusted_close", "volume") if c in bars.columns]
    return _coerce(bars, _rules(dates=("date",), numbers=numbers))


def land_new(incoming: DataFrame, landed: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """Incoming rows whose key has not landed yet (read-through cache as an anti join)."""
    return incoming.join(landed.select(*keys), list(keys), "left_anti")


# --------------------------------------------------------------------------- universe and pairs

UNIVERSE = ("ticker", "company_name", "sector", "industry")


def normalize_constituents(raw: DataFrame) -> DataFrame:
    """Trimmed text, upper-case ticker, missing as ''. Keeps ``row_no`` when present."""
    df = require(norm_header(raw), UNIVERSE, "constituents")
    if "row_no" not in df.columns:
        df = number_rows(df, "row_no")
    return df.select(upper_text(F.col("ticker")).alias("ticker"),
                     *[text(F.col(c)).alias(c) for c in UNIVERSE[1:]],
                     F.col("row_no").cast("long").alias("row_no"))


def normalize_clean_universe(raw: DataFrame) -> DataFrame:
    """Constituents without blank tickers, first row per ticker."""
    df = require(norm_header(raw), UNIVERSE, "clean universe")
    if "row_no" not in df.columns:
        df = number_rows(df, "row_no")
    rules = {"ticker": upper_text, **{c: text for c in UNIVERSE[1:]}}
    rows = _coerce(df, rules).filter(F.col("ticker") != "")
    return first_row(rows, ["ticker"], ["row_no"])


def normalize_selected_pairs(raw: DataFrame) -> DataFrame:
    """Upper-case legs without blanks; the pair id is derived when absent."""
    df = require(norm_header(raw), ("ticker_1", "ticker_2"), "selected pairs")
    df = _coerce(df, _rules(upper=("ticker_1", "ticker_2")))
    df = df.filter((F.col("ticker_1") != "") & (F.col("ticker_2") != ""))
    derived = F.concat_ws("-", "ticker_1", "ticker_2")
    if "pair_id" not in df.columns:
        return df.withColumn("pair_id", derived)
    return df.withColumn("pair_id", F.trim(F.coalesce(F.col("pair_id").cast("string"), F.lit(""))))


PAIR_TEXT = ("pair_id", "ticker_1", "ticker_2")


def _pair_text(df: DataFrame) -> tuple:
    return tuple(c for c in PAIR_TEXT if c in df.columns)


def normalize_spreads(raw: DataFrame) -> DataFrame:
    df = require(norm_header(raw), ("date", "pair_id", "spread"), "spread series")
    numbers = [c for c in ("adjusted_close_1", "adjusted_close_2", "beta", "alpha", "spread",
                           "log_price_1", "log_price_2") if c in df.columns]
    return _coerce(df, _rules(upper=_pair_text(df), dates=("date",), numbers=numbers)).dropna(
        subset=["date", "spread"])


def normalize_backtest_spreads(raw: DataFrame) -> DataFrame:
    """As ``normalize_spreads``, but rows without a spread still give leg prices."""
    df = require(norm_header(raw), ("date", "pair_id"), "spread series")
    numbers = [c for c in ("adjusted_close_1", "adjusted_close_2", "beta", "spread") if c in df.columns]
    return _coerce(df, _rules(upper=_pair_text(df), dates=("date",), numbers=numbers)).dropna(subset=["date"])


def normalize_zscores(raw: DataFrame) -> DataFrame:
    df = require(norm_header(raw), ("date", "pair_id", "z_score_window", "z_score"), "z-scores")
    for c in ("rolling_mean_lagged", "rolling_std_lagged"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    rules = _rules(upper=_pair_text(df), dates=("date",),
                   numbers=("z_score", "rolling_mean_lagged", "rolling_std_lagged"))
    rules["z_score_window"] = lambda c: c.try_cast("double").cast("int")
    return _coerce(df, rules).dropna(subset=["date", "z_score_window"])


def normalize_features(raw: DataFrame, split: str, target: str) -> DataFrame:
    """One feature split; a missing split label takes the file's own."""
    df = require(norm_header(raw), ("date", "target_date", "pair_id", "ticker_1", "ticker_2", "split",
                                    "spread", target), "feature table")
    df = _coerce(df, _rules(upper=PAIR_TEXT, dates=("date", "target_date"), numbers=("spread", target)))
    return df.withColumn("split", F.coalesce(F.col("split").cast("string"), F.lit(split)))


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The feature table partitioned by split; one split reads one partition."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def normalize_predictions(raw: DataFrame) -> DataFrame:
    df = require(norm_header(raw), ("pair_id", "ticker_1", "ticker_2", "model", "feature_date",
                                    "target_date", "split"), "predictions")
    if not {"prediction", "predicted_spread"} & set(df.columns):
        raise MissingColumns("predictions need prediction or predicted_spread")
    numbers = [c for c in ("prediction", "predicted_spread", "actual", "spread", "forecast_error",
                           *PREDICTED_Z) if c in df.columns]
    return _coerce(df, _rules(upper=PAIR_TEXT, lower=("model", "split"),
                              dates=("feature_date", "target_date"), numbers=numbers)).dropna(
        subset=["feature_date", "target_date"])


def truthy(col: Column) -> Column:
    """Text flags: true, 1, yes and y in any case."""
    return lower_text(col).isin("true", "1", "yes", "y")


def normalize_comparison(raw: DataFrame) -> DataFrame:
    df = require(norm_header(raw), ("model",), "model comparison")
    rules = {"model": lower_text, "selection_rank": number, "selected_by_validation": truthy}
    numbers = [c for c in df.columns if c.endswith(("_rmse", "_mae", "_directional_accuracy"))]
    return _coerce(df, {**rules, **_rules(numbers=numbers)})


def normalize_signals(raw: DataFrame) -> DataFrame:
    df = require(norm_header(raw), ("pair_id", "ticker_1", "ticker_2", "model", "split",
                                    "signal_action"), "signals")
    dates = [c for c in ("date", "feature_date", "target_date") if c in df.columns]
    if not dates:
        raise MissingColumns("signals need target_date, feature_date or date")
    df = _coerce(df, _rules(upper=PAIR_TEXT, lower=("model", "split", "signal_action"), dates=dates))
    reason = F.coalesce(F.col("exit_reason").cast("string"), F.lit("")) \
        if "exit_reason" in df.columns else F.lit("")
    return df.withColumn("exit_reason", reason)


def normalize_diagnostics(raw: DataFrame) -> DataFrame:
    """Spread diagnostics with the hedge ratio under one name."""
    df = require(norm_header(raw), ("pair_id",), "spread diagnostics")
    df = _coerce(df, _rules(upper=_pair_text(df)))
    names = [F.col(c) for c in ("hedge_ratio_beta", "beta") if c in df.columns][:1]
    beta = number(names[0]) if names else F.lit(None).cast("double")
    return df.withColumn("hedge_ratio_beta", beta)


def _performance(raw: DataFrame, required: tuple, label: str, dates: tuple, numbers: tuple) -> DataFrame:
    df = require(norm_header(raw), required, label)
    lower = [c for c in ("model", "split") if c in df.columns]
    present = [c for c in numbers if c in df.columns]
    return _coerce(df, _rules(lower=lower, dates=[c for c in dates if c in df.columns], numbers=present))


def normalize_daily_pnl(raw: DataFrame) -> DataFrame:
    return _performance(raw, ("date", "model", "net_pnl", "equity"), "daily pnl", ("date",), (
        "gross_pnl", "transaction_cost", "net_pnl", "cumulative_net_pnl", "equity")).dropna(
        subset=["date", "model"])


def normalize_equity(raw: DataFrame) -> DataFrame:
    return _performance(raw, ("date", "model", "equity"), "equity curves", ("date",),
                        ("cumulative_net_pnl", "equity")).dropna(subset=["date", "model"])


def normalize_trade_log(raw: DataFrame) -> DataFrame:
    df = _performance(raw, ("model",), "trade log", ("entry_date", "exit_date", "date"), (
        "gross_pnl", "commission_cost", "slippage_cost", "borrow_cost", "transaction_cost", "net_pnl",
        "holding_days"))
    if "exit_reason" in df.columns:
        df = df.withColumn("exit_reason", F.coalesce(F.col("exit_reason").cast("string"), F.lit("")))
    return df


def normalize_exposure(raw: DataFrame) -> DataFrame:
    return _performance(raw, ("date", "model"), "exposure", ("date",), (
        "gross_exposure", "net_exposure", "long_exposure", "short_exposure", "active_positions",
        "turnover")).dropna(subset=["date", "model"])


# --------------------------------------------------------------------------- sinks

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple = ()) -> None:
    """Write a result table as Parquet, CSV or JSON; tasks write their own files."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Processed bars by year: readers of a period skip the other folders."""
    bars.withColumn("year", F.year("date")).repartition("year", "ticker").write.mode(
        "overwrite").partitionBy("year").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature table by split, in place of one file per split."""
    features.write.mode("overwrite").partitionBy("split").parquet(path)
