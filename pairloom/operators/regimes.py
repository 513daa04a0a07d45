"""Market-regime labels and performance attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import float_text, full_window
from ..functions.stats import expanding_quantiles
from ..params import AnalyticsParams, RegimeParams, label_name
from .analytics import (
    ALL, RETURN_METRICS, drawdown_series, equity_frame, exposure_metrics, return_metrics,
    trade_metrics,
)

KEYS = ("model", "regime")
PERFORMANCE = ("model", "regime", "regime_type", "start_date", "end_date", "label_days",
               "number_of_trading_days", "minimum_observations", "meets_minimum_observations",
               *RETURN_METRICS, "net_pnl", "number_of_trades", "trade_attribution_method",
               "average_gross_exposure", "average_net_exposure", "average_active_positions", "turnover")
SUMMARY = ("summary_item", "model", "regime", "metric", "value", "notes", *RETURN_METRICS, "net_pnl",
           "number_of_trading_days", "number_of_trades", "average_gross_exposure",
           "average_active_positions")
VOLATILITY = ("high_volatility", "low_volatility", "normal_volatility")


def market_proxy(prices: DataFrame, ticker: str) -> DataFrame:
    """Prices of one ticker: adjusted close, or close where the table has no other."""
    name = "adjusted_close" if "adjusted_close" in prices.columns else "close"
    return prices.filter(F.col("ticker") == ticker).select(
        "date", F.col(name).alias("adjusted_close")).filter(
        F.col("date").isNotNull() & F.col("adjusted_close").isNotNull())


def analysis_dates(*frames: DataFrame) -> DataFrame:
    dated = [f.select("date") for f in frames]
    return reduce(DataFrame.union, dated).filter(F.col("date").isNotNull()).distinct()


def market_features(proxy: DataFrame, p: RegimeParams, trading_days: int = 252) -> DataFrame:
    """Lagged volatility, its quantile thresholds, and the lagged trend, by day.

    One price series over one calendar: the only window group is bounded by its days.
    """
    w = Window.partitionBy(F.lit(p.market_proxy)).orderBy("date")

    def before(rows: int):
        return w.rowsBetween(-rows, -1)

    rows = proxy.withColumn("market_return", F.try_divide(
        F.col("adjusted_close"), F.lag("adjusted_close").over(w)) - 1)
    deviation = full_window(F.stddev_samp("market_return"), F.col("market_return"),
                            before(p.volatility_window), p.volatility_min_periods)
    rows = rows.withColumn("realized_volatility", deviation * F.sqrt(F.lit(float(trading_days))))
    if p.quantile_method == "full_sample":
        bounds = rows.agg(*[
            F.percentile("realized_volatility", F.lit(q)).alias(n) for n, q in _quantiles(p)])
        rows = rows.join(F.broadcast(bounds))  # one row
    else:
        rows = expanding_quantiles(rows.withColumn("series", F.lit(p.market_proxy)), ("series",), "date",
                                   "realized_volatility", dict(_quantiles(p))).drop("series")
    if p.enable_bull_bear:
        price = F.lag("adjusted_close").over(w)
        mean = full_window(F.avg("adjusted_close"), F.col("adjusted_close"),
                           before(p.trend_window), p.trend_min_periods)
        bull, bear = price > mean, price < mean
    else:
        bull, bear = F.lit(False), F.lit(False)
    return rows.select("date", "market_return", "realized_volatility", "low_volatility_threshold",
                       "high_volatility_threshold", bull.alias("bull_market"), bear.alias("bear_market"))


def _quantiles(p: RegimeParams):
    return (("low_volatility_threshold", p.low_quantile), ("high_volatility_threshold", p.high_quantile))


def regime_labels(dates: DataFrame, features: DataFrame, p: RegimeParams) -> DataFrame:
    """Boolean regime flags of each analysis date; unknown market data means no flag."""
    walk = p.walk
    day = F.col("date")

    def inside(period) -> Column:
        return day.between(F.lit(period.start), F.lit(period.end))

    def yes(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False))

    rows = dates.join(features, "date", "left")
    vol, low, high = (F.col(c) for c in ("realized_volatility", "low_volatility_threshold",
                                         "high_volatility_threshold"))
    rows = rows.withColumns({
        "market_proxy": F.lit(p.market_proxy),
        "validation": inside(walk.validation), "test": inside(walk.test),
        "holdout_2025": inside(walk.holdout),
        "high_volatility": yes(vol > high),
        "bull_market": yes(F.col("bull_market")), "bear_market": yes(F.col("bear_market")),
    })
    rows = rows.withColumn("low_volatility", yes(vol < low) & ~F.col("high_volatility"))
    rows = rows.withColumn(
        "normal_volatility", vol.isNotNull() & low.isNotNull() & high.isNotNull()
        & ~F.col("high_volatility") & ~F.col("low_volatility"))

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in names], F.lit("unclassified"))

    special = {label_name(n): inside(period) for n, period in p.special_periods}
    rows = rows.withColumns({
        "split": pick("validation", "test", "holdout_2025"),
        "volatility_regime": pick(*VOLATILITY),
        "market_trend_regime": pick("bull_market", "bear_market"), **special,
    })
    return rows.select(
        "date", "split", "market_proxy", "market_return", "realized_volatility",
        "low_volatility_threshold", "high_volatility_threshold", "volatility_regime",
        "market_trend_regime", *[n for n, _ in p.regimes()])


def regime_days(labels: DataFrame, p: RegimeParams) -> DataFrame:
    """(date, regime) of every set flag: the labels turned from columns into rows."""
    names = [n for n, _ in p.regimes()]
    flags = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return labels.select("date", F.explode(flags).alias("regime"))


def regime_performance(daily: DataFrame, curves: DataFrame, trades: DataFrame, exposures: DataFrame,
                       labels: DataFrame, p: RegimeParams, a: AnalyticsParams) -> DataFrame:
    """Metrics of every (model, regime), empty regimes included.

    Labels become rows and join by date; the analytics then run once with the
    regime as part of the key, for all models and regimes together.
    """
    days = regime_days(labels, p)
    models = reduce(DataFrame.union, [f.select("model") for f in (daily, curves, trades, exposures)])
    models = models.filter(F.trim("model") != "").distinct()
    listed = F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(t).alias("regime_type"))
                       for n, t in p.regimes()])
    base = models.select("model", F.inline(listed))
    spans = days.groupBy("regime").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("label_days"))
    method = next((c for c in ("exit_date", "entry_date", "date") if c in trades.columns), None)
    daily_in, curves_in = daily.join(days, "date"), curves.join(days, "date")
    exposed = exposures.join(days, "date")
    traded = trades.join(days.withColumnRenamed("date", method), method) if method else None

    equity = _scoped_equity(daily_in, curves_in)
    whole = F.col("split") == ALL
    returns = return_metrics(drawdown_series(equity, KEYS), a, KEYS).filter(whole).drop("split")
    exposure = exposure_metrics(exposed, KEYS).filter(whole).select(
        *KEYS, "average_gross_exposure", "average_net_exposure", "average_active_positions", "turnover")
    counted = daily_in.select(*KEYS, "date").union(curves_in.select(*KEYS, "date")).groupBy(*KEYS).agg(
        F.count_distinct("date").alias("days"))
    pnl = daily_in.groupBy(*KEYS).agg(F.sum("net_pnl").alias("daily_pnl"))
    change = curves_in.groupBy(*KEYS).agg(
        (F.max_by("cumulative_net_pnl", "date") - F.min_by("cumulative_net_pnl", "date")).alias("curve_pnl"))
    rows = base.join(F.broadcast(spans), "regime", "left")
    for part in (returns, exposure, counted, pnl, change):
        rows = rows.join(part, list(KEYS), "left")
    if traded is not None:
        rows = rows.join(trade_metrics(traded, KEYS).filter(whole).select(
            *KEYS, F.col("number_of_trades").alias("n_trades")), list(KEYS), "left")
        some = trades.limit(1).select((F.count(F.lit(1)) > 0).alias("s")).scalar()
        how = F.when(some & F.col("label_days").isNotNull(), F.lit(method)).otherwise(F.lit("none"))
        number = F.coalesce("n_trades", F.lit(0)).cast("double")
    else:
        how, number = F.lit("unavailable"), F.lit(None).cast("double")
    number_of_days = F.coalesce("days", F.lit(0))
    return rows.withColumns({
        "label_days": F.coalesce("label_days", F.lit(0)),
        "number_of_trading_days": number_of_days,
        "minimum_observations": F.lit(int(p.minimum_observations)),
        "meets_minimum_observations": number_of_days >= p.minimum_observations,
        "net_pnl": F.coalesce("daily_pnl", "curve_pnl"),
        "number_of_trades": number, "trade_attribution_method": how,
    }).select(*PERFORMANCE)


def _scoped_equity(daily: DataFrame, curves: DataFrame) -> DataFrame:
    """Daily rows per (model, regime); curves only where that key has no daily row."""
    own = equity_frame(daily, None, KEYS)
    spare = equity_frame(None, curves, KEYS).join(daily.select(*KEYS).distinct(), list(KEYS), "left_anti")
    return own.unionByName(spare)


# --------------------------------------------------------------------------- summary

def _shaped(df: DataFrame, item: str, metric: str, value: Column, notes: Column,
            source: bool = True, regime: Column | None = None) -> DataFrame:
    text = {"summary_item": F.lit(item), "metric": F.lit(metric), "value": value.cast("double"),
            "notes": notes}
    if not source:
        text["model"] = F.col("model") if "model" in df.columns else F.lit("")
        text["regime"] = regime if regime is not None else F.lit("")
    return df.select(*[
        text[c].alias(c) if c in text else
        F.col(c).alias(c) if c in ("model", "regime") else
        (F.col(c).cast("double") if source else F.lit(None).cast("double")).alias(c)
        for c in SUMMARY
    ])


def _or_note(rows: DataFrame, anchor: DataFrame, item: str, metric: str, note: str) -> DataFrame:
    """``rows``, or one explaining row when there are none (and performance exists)."""
    none = rows.select((F.count(F.lit(1)) == 0).alias("n")).scalar()
    spare = anchor.select().filter(none)
    return rows.unionByName(_shaped(spare, item, metric, F.lit(None), F.lit(note), source=False))


def regime_summary(performance: DataFrame, labels: DataFrame, proxy: DataFrame,
                   p: RegimeParams) -> DataFrame:
    """Headline rows. ``performance`` holds models times regimes rows; pass a stage table."""
    metric = p.ranking_metric
    spark = performance.sparkSession
    anchor = performance.limit(1)
    eligible = performance.filter("meets_minimum_observations")
    best = eligible.filter(F.col(metric).isNotNull()).orderBy(
        F.desc(metric), F.asc("model"), F.asc("regime")).limit(1)
    best = _or_note(
        _shaped(best, "best_regime", metric, F.col(metric),
                F.lit(f"Best regime by {metric} among rows meeting minimum observations.")),
        anchor, "best_regime", metric,
        f"No regime met the minimum observation requirement with a finite {metric}.")
    worst = eligible.filter(F.col("max_drawdown").isNotNull()).orderBy(
        F.asc("max_drawdown"), F.asc("model"), F.asc("regime")).limit(1)
    worst = _or_note(
        _shaped(worst, "worst_drawdown_regime", "max_drawdown", F.col("max_drawdown"),
                F.lit("Most negative max drawdown among rows meeting minimum observations.")),
        anchor, "worst_drawdown_regime", "max_drawdown",
        "No finite drawdown values were available for eligible regimes.")
    parts = [best, worst, _concentration(eligible, anchor), _holdout(performance, anchor, metric),
             _high_low(performance, metric)]
    has_proxy = proxy.limit(1).select((F.count(F.lit(1)) > 0).alias("h")).scalar()
    trending = labels.filter(F.col("bull_market") | F.col("bear_market")).limit(1).select(
        (F.count(F.lit(1)) > 0).alias("t")).scalar()
    parts.append(_shaped(
        anchor.select().filter(~has_proxy), "market_proxy_unavailable", "market_proxy", F.lit(None),
        F.lit(f"Processed data for {p.market_proxy} was unavailable; "
              "volatility and bull/bear regimes were left unclassified."), source=False))
    parts.append(_shaped(
        anchor.select().filter(has_proxy & ~trending), "bull_bear_unclassified", "market_trend_regime",
        F.lit(None), F.lit("Bull/bear labels require enough lagged market proxy history; "
                           "no dates met that requirement."), source=False))
    empty = performance.limit(1).select((F.count(F.lit(1)) == 0).alias("e")).scalar()
    parts.append(_shaped(
        spark.range(1).select().filter(empty), "no_regime_performance", metric, F.lit(None),
        F.lit("No model-level regime performance rows were available."), source=False))
    return reduce(DataFrame.unionByName, parts)


def _concentration(eligible: DataFrame, anchor: DataFrame) -> DataFrame:
    """Largest volatility bucket's share of absolute PnL per model (three rows each)."""
    item, metric = "performance_concentration", "absolute_net_pnl_share"
    rows = eligible.filter(F.col("regime").isin(*VOLATILITY)).withColumn("size", F.abs("net_pnl"))
    per_model = rows.groupBy("model").agg(
        F.sum("size").alias("total"),
        F.max_by(F.struct(*[c for c in rows.columns if c != "model"]),
                 F.struct(F.coalesce("size", F.lit(-1.0)), *_descending_text("regime"))).alias("top"))
    usable = F.col("total") > 0
    share = F.col("top.size") / F.col("total")
    top = per_model.filter(usable).select("model", share.alias("share"), "top.*")
    notes = F.concat(
        F.lit("concentrated="), (F.col("share") >= 0.60).cast("string"), F.lit("; top volatility regime "),
        F.col("regime"), F.lit(" accounts for "), F.format_string("%.2f%%", F.col("share") * 100),
        F.lit(" of absolute net PnL across high/low/normal volatility buckets."))
    found = _shaped(top, item, metric, F.col("share"), notes)
    flat = _shaped(per_model.filter(~F.coalesce(usable, F.lit(False))).select("model"), item, metric,
                   F.lit(None), F.lit("Absolute net PnL was zero or unavailable across volatility regimes."),
                   source=False)
    return _or_note(found.unionByName(flat), anchor, item, metric,
                    "No eligible high/low/normal volatility rows were available for concentration analysis.")


def _descending_text(column: str):
    """Order key that ranks the three bucket names high < low < normal last-first."""
    place = F.when(F.col(column) == VOLATILITY[0], 3).when(F.col(column) == VOLATILITY[1], 2).otherwise(1)
    return [place]


def _holdout(performance: DataFrame, anchor: DataFrame, metric: str) -> DataFrame:
    rows = performance.filter(F.col("regime") == "holdout_2025")
    return _or_note(
        _shaped(rows, "holdout_2025_performance", metric, F.col(metric),
                F.lit("Evaluation-only 2025 holdout performance.")),
        anchor, "holdout_2025_performance", metric, "No 2025 holdout performance rows were available.")


def _high_low(performance: DataFrame, metric: str) -> DataFrame:
    def of(regime: str, c: str) -> Column:
        return F.max(F.when(F.col("regime") == regime, F.col(c)))

    rows = performance.groupBy("model").agg(
        of("high_volatility", metric).alias("hv"), of("low_volatility", metric).alias("lv"),
        of("high_volatility", "net_pnl").alias("hp"), of("low_volatility", "net_pnl").alias("lp"),
        F.count_if(F.col("regime").isin(*VOLATILITY[:2])).alias("n"))

    def shown(c: str) -> Column:
        return float_text(F.col(c))

    both = F.col("n") == 2
    notes = F.when(both, F.concat(
        F.lit(f"high_volatility {metric}="), shown("hv"), F.lit(f"; low_volatility {metric}="), shown("lv"),
        F.lit("; high_net_pnl="), shown("hp"), F.lit("; low_net_pnl="), shown("lp"), F.lit("."),
    )).otherwise(F.lit("High or low volatility performance row was unavailable."))
    return _shaped(rows, "high_vs_low_volatility", metric, F.when(both, F.col("hv") - F.col("lv")), notes,
                   source=False, regime=F.when(both, F.lit("high_vs_low_volatility")).otherwise(F.lit("")))
