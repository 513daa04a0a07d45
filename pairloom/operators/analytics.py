"""Performance analytics, for any grouping key in front of the model.

``keys`` is the identity of one strategy run: ``("model",)`` for a backtest,
``("scenario_id", "model")`` for a sweep, ``("model", "regime")`` for regimes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import finite, ratio
from ..functions.stats import exact_median
from ..params import AnalyticsParams

ALL = "all"
MODEL = ("model",)
RETURN_METRICS = ("total_return", "annualized_return", "annualized_volatility", "sharpe_ratio",
                  "sortino_ratio", "max_drawdown", "calmar_ratio")
CORE_METRICS = RETURN_METRICS + (
    "win_rate", "profit_factor", "average_holding_period", "turnover", "average_gross_exposure",
    "average_net_exposure", "number_of_trades", "observation_count")
SUMMARY = ("model", *CORE_METRICS[:-1], "performance_rank")


def equity_frame(daily: DataFrame | None, curves: DataFrame | None = None,
                 keys: tuple = MODEL) -> DataFrame:
    """Equity input: daily PnL when it has rows, else the equity curves.

    The choice is a scalar inside the plan, so an empty daily table needs no
    driver-side check.
    """
    def shaped(df: DataFrame) -> DataFrame:
        split = F.col("split") if "split" in df.columns else F.lit(ALL)
        pnl = F.col("net_pnl") if "net_pnl" in df.columns else F.lit(None).cast("double")
        return df.filter(F.col("date").isNotNull() & F.col("equity").isNotNull()).select(
            *keys, split.alias("split"), "date", "equity", pnl.alias("net_pnl"))

    if curves is None:
        return shaped(daily)
    if daily is None:
        return shaped(curves)
    empty = daily.limit(1).select((F.count(F.lit(1)) == 0).alias("e")).scalar()
    return shaped(daily).unionByName(shaped(curves).filter(empty))


def drawdown_series(equity: DataFrame, keys: tuple = MODEL) -> DataFrame:
    """Daily return, cumulative return and drawdown, over all rows and per split.

    A row feeds its own split and the ``all`` scope; windows run per scope, each at
    most one row per day. NULL and blank splits only count in ``all``.
    """
    own = F.when((F.col("split") != ALL) & (F.trim("split") != ""), F.col("split"))
    rows = equity.withColumn("split", F.explode(F.array_compact(F.array(F.lit(ALL), own))))
    order = Window.partitionBy(*keys, "split").orderBy("date")
    grown = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = ratio(F.col("equity"), F.lag("equity").over(order)) - 1
    given = ratio(F.col("net_pnl"), F.col("equity") - F.col("net_pnl"))
    has_pnl = F.max(F.col("net_pnl").isNotNull()).over(Window.partitionBy(*keys, "split"))
    rows = rows.withColumn("daily_return", F.coalesce(
        finite(F.when(has_pnl, given).otherwise(plain)), F.lit(0.0)))
    rows = rows.withColumns({
        "cumulative_return": F.product(1.0 + F.col("daily_return")).over(grown) - 1.0,
        "running_peak_equity": F.max("equity").over(grown),
    })
    rows = rows.withColumn("drawdown", ratio(F.col("equity"), F.col("running_peak_equity")) - 1.0)
    return rows.select("date", *keys, "split", "equity", "daily_return", "cumulative_return",
                       "running_peak_equity", "drawdown",
                       F.min("drawdown").over(grown).alias("max_drawdown_to_date"))


def scoped(df: DataFrame, keys: tuple = MODEL) -> DataFrame:
    """Rows repeated for the ``all`` scope and for their own split.

    Rows already marked ``all`` replace the others in the ``all`` scope.
    """
    if "split" not in df.columns:
        return df.withColumn("split", F.lit(ALL))
    marked = df.groupBy(*keys).agg(F.max(F.coalesce(F.col("split") == ALL, F.lit(False))).alias("marked"))
    rows = df.join(marked, list(keys), "left")
    is_all = F.coalesce(F.col("split") == ALL, F.lit(False))
    whole = F.when(is_all | ~F.col("marked"), F.lit(ALL))
    own = F.when(~is_all & (F.trim("split") != ""), F.col("split"))
    return rows.withColumn("split", F.explode(F.array_compact(F.array(whole, own)))).drop("marked")


def return_metrics(drawdowns: DataFrame, p: AnalyticsParams, keys: tuple = MODEL) -> DataFrame:
    """Return, risk and ratio metrics per scope: one aggregate over its days."""
    days = float(p.trading_days_per_year)
    daily_rf = p.risk_free_rate / days
    r = F.col("daily_return")
    excess = r - daily_rf
    down = F.when(excess < 0, excess)
    sums = drawdowns.groupBy(*keys, "split").agg(
        (F.product(1.0 + r) - 1.0).alias("total_return"), F.count(r).alias("n"),
        F.stddev_samp(r).alias("std"), F.avg(excess).alias("mean"),
        F.count(down).alias("downs"), F.stddev_samp(down).alias("down_std"),
        F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("observation_count"))
    total, n = F.col("total_return"), F.col("n")
    annual = F.when((n > 0) & (total > -1.0), F.pow(1.0 + total, F.lit(days) / n) - 1.0)
    scale = F.sqrt(F.lit(days))
    return sums.withColumn("annualized_return", annual).select(
        *keys, "split", "total_return", "annualized_return",
        F.when(n >= 2, F.col("std") * scale).alias("annualized_volatility"),
        F.when(n >= 2, ratio(F.col("mean"), F.col("std")) * scale).alias("sharpe_ratio"),
        F.when(F.col("downs") >= 2, ratio(F.col("mean"), F.col("down_std")) * scale).alias("sortino_ratio"),
        "max_drawdown",
        ratio(F.col("annualized_return"), F.abs("max_drawdown")).alias("calmar_ratio"),
        "observation_count")


def trade_metrics(trades: DataFrame, keys: tuple = MODEL) -> DataFrame:
    """Win rate, PnL and holding statistics, with the exit-reason histogram."""
    rows = scoped(trades, keys)
    pnl = F.col("net_pnl" if "net_pnl" in rows.columns else "gross_pnl")
    wins = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    losses = F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0))
    held = F.col("holding_days") if "holding_days" in rows.columns else F.lit(None).cast("double")
    sums = rows.groupBy(*keys, "split").agg(
        F.count(pnl).alias("number_of_trades"),
        F.avg(F.when(pnl.isNotNull(), F.when(pnl > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        F.avg(pnl).alias("average_trade_pnl"),
        F.avg(held).alias("average_holding_period"),
        wins.alias("gross_profit"), losses.alias("gross_loss"))
    sums = sums.withColumn("profit_factor", F.when(
        F.col("gross_loss") < 0, F.col("gross_profit") / F.abs("gross_loss"),
    ).when(F.col("gross_profit") > 0, F.lit(float("inf"))))
    reason = F.trim("exit_reason") if "exit_reason" in rows.columns else F.lit("")
    counts = rows.groupBy(*keys, "split", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    middle = exact_median(rows.withColumn("pnl", pnl), [*keys, "split"], "pnl", "median_trade_pnl")
    named = counts.filter(F.col("reason") != "").groupBy(*keys, "split").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("reason", "n"))),
            lambda s: F.concat(s["reason"], F.lit(":"), s["n"].cast("string"))), ";")
        .alias("exit_reason_counts"))
    on = [*keys, "split"]
    return sums.join(named, on, "left").join(middle, on, "left").select(
        *keys, "split", "number_of_trades", "win_rate", "average_trade_pnl", "median_trade_pnl",
        "profit_factor", "average_holding_period", "gross_profit", "gross_loss",
        F.coalesce("exit_reason_counts", F.lit("")).alias("exit_reason_counts"))


def exposure_metrics(exposures: DataFrame, keys: tuple = MODEL) -> DataFrame:
    return scoped(exposures, keys).groupBy(*keys, "split").agg(
        F.avg("gross_exposure").alias("average_gross_exposure"),
        F.avg("net_exposure").alias("average_net_exposure"),
        F.max("gross_exposure").alias("max_gross_exposure"),
        F.avg("active_positions").alias("average_active_positions"),
        F.sum("turnover").alias("turnover"),
        F.avg("turnover").alias("average_daily_turnover"),
        F.count(F.lit(1)).alias("observation_count"))


def backtest_metrics(drawdowns: DataFrame, trades: DataFrame, exposures: DataFrame,
                     p: AnalyticsParams, keys: tuple = MODEL) -> DataFrame:
    """Combined metrics per scope found in any of the three inputs."""
    on = [*keys, "split"]
    returns = return_metrics(drawdowns, p, keys)
    traded = trade_metrics(trades, keys).select(
        *on, "win_rate", "profit_factor", "average_holding_period", "number_of_trades")
    exposed = exposure_metrics(exposures, keys).select(
        *on, "turnover", "average_gross_exposure", "average_net_exposure")
    joined = reduce(lambda a, b: a.join(b, on, "full_outer"), (returns, traded, exposed))
    return joined.na.fill(0, ["number_of_trades", "observation_count"]).select(*on, *CORE_METRICS)


def performance_summary(metrics: DataFrame) -> DataFrame:
    """Models ranked on their all-sample rows: Sharpe, then return, then name."""
    # One row per model: the single ranking group is as small as the model list.
    w = Window.partitionBy("split").orderBy(
        F.desc_nulls_last("sharpe_ratio"), F.desc_nulls_last("total_return"), F.asc("model"))
    return metrics.filter(F.col("split") == ALL).withColumn(
        "performance_rank", F.row_number().over(w).cast("long")).select(*SUMMARY)
