"""Research settings for the order tables, and one research run per session and folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from pairloom.params import (
    AnalyticsParams, BacktestParams, FeatureParams, ForecastParams, PairParams, Period, QualityParams,
    RegimeParams, RobustnessParams, SignalParams, SpreadParams, UniverseParams, WalkForward,
)
from pairloom.plans.research import Research, Settings
from pairloom.sources import driver

DATA = Period("1995-01-01", "2001-12-31")
FORMATION = Period("1995-01-01", "1998-12-31")
WALK = WalkForward(
    train=FORMATION, validation=Period("1999-01-01", "1999-12-31"),
    test=Period("2000-01-01", "2000-12-31"), holdout=Period("2001-01-01", "2001-12-31"))

# Prices of the order tables are noise, so the filters are wide: every pair with some
# history is a candidate, and signals trade the models named here.
SETTINGS = Settings(
    quality=QualityParams(period=DATA, min_history_days=60, max_missing_fraction=0.5),
    universe=UniverseParams(period=DATA, min_adjusted_close_price=1.0,
                            min_average_daily_dollar_volume=1_000.0,
                            max_missing_data_ratio=0.98, min_history_days=60),
    pairs=PairParams(formation=FORMATION, min_return_correlation=-0.05, fdr_alpha=0.05,
                     half_life_min_days=0.05, half_life_max_days=60, top_n_pairs=8,
                     min_overlap_days=20, variant="df"),
    spreads=SpreadParams(formation=FORMATION, data=DATA, windows=(10, 20, 60), variant="df"),
    features=FeatureParams(walk=WALK, z_score_windows=(20,), spread_mean_windows=(20,),
                           spread_volatility_windows=(20,), correlation_windows=(20,),
                           momentum_windows=(5,), volatility_regime_window=20,
                           market_proxy=driver.MARKET),
    forecasts=ForecastParams(rolling_window=10, hidden_size=16, rounds=40),
    signals=SignalParams(entry_z=0.5, exit_z=0.25, stop_loss_z=2.5, max_holding_days=5, z_score_window=60),
    backtest=BacktestParams(max_active_pairs=3, borrow_cost_bps=25.0),
    analytics=AnalyticsParams(risk_free_rate=0.01),
    robustness=RobustnessParams(
        entry_z_values=(0.5, 1.5), exit_z_values=(0.25,), stop_loss_z_values=(2.5,),
        commission_bps_values=(0.0, 5.0), zscore_window_values=(60,),
        signal_model_values=("naive", "best_validation", "rolling_mean")),
    regimes=RegimeParams(
        market_proxy=driver.MARKET, walk=WALK, volatility_window=20, volatility_min_periods=20,
        trend_window=60, trend_min_periods=60, minimum_observations=10,
        special_periods=(("Spring 1999", Period("1999-03-01", "1999-05-31")),
                         ("year-2000 close", Period("2000-10-01", "2000-12-31")),
                         ("final_holdout", Period("2001-01-01", "2001-12-31")))),
    # The chain that SQL can follow; m04, m05 and m10_all_models run the learned models.
    models=("naive", "rolling_mean", "arima"),
    traded=("naive", "rolling_mean"),
)

_RUNS: dict = {}


def research(spark: SparkSession, sf_dir: str) -> Research:
    """The run of this session and folder; its stage tables are shared by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        def prices(run: Research):
            stocks = run._stage(driver.bars(spark, sf_dir).select("ticker", "date", "adjusted_close", "volume"), "stocks")
            return stocks.unionByName(driver.market_bars(stocks))

        name = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
        _RUNS[key] = Research(spark, prices, driver.constituents(spark, sf_dir), SETTINGS, name)
    return _RUNS[key]


def forget() -> None:
    """Drop all runs, so the next query rebuilds its stages (benches and tests)."""
    _RUNS.clear()
