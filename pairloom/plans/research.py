"""The research chain: each stage is a lazy DataFrame function over stage tables.

A stage that several later stages read is written once as a Parquet stage table in
the shared folder. Stages are built on first use, so a query pays only for its own
ancestors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics as A
from ..operators import backtest as B
from ..operators import features as X
from ..operators import forecast as M
from ..operators import learned as L
from ..operators import pairs as P
from ..operators import regimes as E
from ..operators import robustness as R
from ..operators import signals as G
from ..operators import spreads as S
from ..operators import universe as U
from ..operators.panel import price_panel, price_vectors
from ..params import (
    AnalyticsParams, BacktestParams, FeatureParams, ForecastParams, PairParams, QualityParams,
    RegimeParams, RobustnessParams, SignalParams, SpreadParams, UniverseParams,
)
from ..session import remove_folder, stage_root, stage_table


@dataclass(frozen=True)
class Settings:
    quality: QualityParams = QualityParams()
    universe: UniverseParams = UniverseParams()
    pairs: PairParams = PairParams()
    spreads: SpreadParams = SpreadParams()
    features: FeatureParams = FeatureParams()
    forecasts: ForecastParams = ForecastParams()
    signals: SignalParams = SignalParams()
    backtest: BacktestParams = BacktestParams()
    analytics: AnalyticsParams = AnalyticsParams()
    robustness: RobustnessParams = RobustnessParams()
    regimes: RegimeParams = field(default_factory=RegimeParams)
    # Models of the prediction table; traded ones are a subset.
    models: tuple = ("naive", "rolling_mean", "arima", "boosted_trees", "recurrent")
    traded: tuple = ()


@dataclass
class Backtest:
    """Tables of one backtest, keyed by scenario."""

    prepared: DataFrame
    calendar: DataFrame
    positions: DataFrame
    days: DataFrame
    valued: DataFrame
    flows: DataFrame
    costs: DataFrame
    params: BacktestParams

    @property
    def trade_log(self) -> DataFrame:
        return B.trade_log(self.valued, self.costs)

    @property
    def daily_pnl(self) -> DataFrame:
        return B.daily_pnl(self.prepared, self.flows, self.calendar, self.costs, self.params)

    @property
    def exposure(self) -> DataFrame:
        return B.exposure(self.prepared, self.days, self.flows, self.calendar, self.costs)

    @property
    def open_positions(self) -> DataFrame:
        return B.open_positions(self.valued, self.costs)


class Research:
    """One research run over a price table and a constituents table.

    ``prices`` is a table, or a function that makes it when a stage first needs it. Stage
    tables lie under ``folder`` (the session's shared folder by default), the run's name and
    a digest of its settings, so runs with other settings never share files. ``close``
    removes them.
    """

    def __init__(self, spark: SparkSession, prices, constituents: DataFrame,
                 settings: Settings, name: str, folder: str | None = None):
        digest = hashlib.sha1(repr(settings).encode()).hexdigest()[:10]
        self.spark, self.settings, self.name = spark, settings, f"{name}-{digest}"
        self._prices, self.constituents = prices, constituents
        self._fitted: dict = {}
        self.folder = folder or stage_root(spark)

    def _stage(self, df: DataFrame, stage: str, partition_by: tuple = ()) -> DataFrame:
        return stage_table(df, f"{self.name}/{stage}", partition_by, self.folder)

    def close(self) -> None:
        """Remove this run's stage tables."""
        remove_folder(self.spark, f"{self.folder}/{self.name}")

    @cached_property
    def prices(self) -> DataFrame:
        """Daily closes and volumes, one row per (ticker, date)."""
        table = self._prices(self) if callable(self._prices) else self._prices
        return self._stage(table.select("ticker", "date", "adjusted_close", "volume"), "prices")

    @cached_property
    def audit(self) -> DataFrame:
        return self._stage(U.universe_audit(
            self.constituents, self.prices, self.settings.universe, unique=True), "audit")

    @property
    def universe(self) -> DataFrame:
        return U.clean_universe(self.audit)

    @cached_property
    def candidates(self) -> DataFrame:
        p = self.settings.pairs
        return self._stage(P.candidate_pairs(self.universe, p.same_sector_only, p.block_size), "candidates")

    @cached_property
    def evaluated(self) -> DataFrame:
        return self._stage(
            P.evaluate_candidates(self.candidates, self.prices, self.settings.pairs, unique=True,
                                  stage=lambda _: self.formation_vectors), "evaluated")

    @cached_property
    def formation_vectors(self) -> DataFrame:
        """Price vectors of all tickers over the formation period, written once for all tests."""
        period = self.settings.pairs.formation
        return self._stage(price_vectors(price_panel(self.prices, period, unique=True), period), "formation_vectors")

    @cached_property
    def finalized(self) -> DataFrame:
        return self._stage(P.adjust_and_finalize(self.evaluated, self.settings.pairs), "finalized")

    @cached_property
    def selected(self) -> DataFrame:
        return self._stage(P.select_pairs(self.finalized, self.settings.pairs), "selected")

    @property
    def diagnostics(self) -> DataFrame:
        return P.final_diagnostics(self.finalized, self.selected)

    @cached_property
    def vectors(self) -> DataFrame:
        """Price vectors of the selected legs over the whole data period."""
        legs = self.selected.select(F.col("ticker_1").alias("ticker")).union(self.selected.select("ticker_2"))
        panel = price_panel(self.prices, self.settings.spreads.data, legs, unique=True)
        return self._stage(price_vectors(panel, self.settings.spreads.data), "vectors")

    @cached_property
    def spread_diagnostics(self) -> DataFrame:
        return self._stage(S.spread_diagnostics(
            self.selected, self.prices, self.vectors, self.settings.spreads), "spread_diagnostics")

    @cached_property
    def spreads(self) -> DataFrame:
        return self._stage(S.spread_series(
            self.spread_diagnostics, self.vectors, self.settings.spreads), "spreads")

    @cached_property
    def zscores(self) -> DataFrame:
        return self._stage(S.lagged_zscores(self.spreads, self.settings.spreads.windows), "zscores")

    def panel(self) -> DataFrame:
        return price_panel(self.prices, self.settings.spreads.data, unique=True)

    @cached_property
    def features(self) -> DataFrame:
        return self._stage(X.build_features(
            self.spreads, self.zscores, self.panel(), self.settings.features, unique=True), "features", ("split",))

    def forecast(self, model: str) -> DataFrame:
        makers = {"naive": M.naive_forecast, "rolling_mean": M.rolling_mean_forecast, "arima": M.arima_forecast,
                  "boosted_trees": L.boosted_tree_forecast, "recurrent": L.recurrent_forecast,
                  "sequence_regression": L.sequence_forecast}
        if model not in self._fitted:
            made = makers[model](self.features, self.settings.forecasts)
            # A learned model is fitted when its table is made: once for all that read it.
            learned = model in ("boosted_trees", "recurrent", "sequence_regression")
            self._fitted[model] = self._stage(made, f"forecast_{model}") if learned else made
        return self._fitted[model]

    @cached_property
    def predictions(self) -> DataFrame:
        out = None
        for model in self.settings.models:
            part = self.forecast(model)
            out = part if out is None else out.unionByName(part)
        return self._stage(out, "predictions")

    @cached_property
    def metrics(self) -> DataFrame:
        return self._stage(M.forecast_metrics(self.predictions), "metrics")

    @cached_property
    def comparison(self) -> DataFrame:
        return self._stage(M.compare_models(self.metrics, self.settings.forecasts), "comparison")

    def traded_models(self) -> DataFrame:
        if self.settings.traded:
            names = F.array(*[F.lit(m) for m in self.settings.traded])
            return self.spark.range(1).select(F.explode(names).alias("model"))
        return M.resolve_model(self.settings.signals.signal_model, self.comparison, self.settings.forecasts)

    def signals_of(self, runs: DataFrame, stage: str) -> DataFrame:
        inputs = G.signal_input(self.predictions, self.spreads, self.zscores, self.selected, runs,
                                self.settings.signals, unique=True)
        return self._stage(G.generate_signals(inputs), stage)

    @cached_property
    def signals(self) -> DataFrame:
        return self.signals_of(G.single_run(self.traded_models(), self.settings.signals), "signals")

    @cached_property
    def leg_prices(self) -> DataFrame:
        """Leg prices of the selected pairs, shared by every backtest of this run."""
        return self._stage(B.pair_prices(
            self.selected, self.prices, self.spreads, self.settings.spreads.data, unique=True), "leg_prices")

    def run_backtest(self, signals: DataFrame, costs: DataFrame, stage: str) -> Backtest:
        p, period = self.settings.backtest, self.settings.spreads.data
        prepared = self._stage(B.prepare_signals(signals, self.selected, p), f"{stage}/prepared")
        px = self.leg_prices
        calendar = B.simulation_calendar(prepared, self.prices, period, self.selected)
        ratios = B.hedge_ratios(self.spread_diagnostics, self.spreads, self.selected)
        events = B.priced_events(prepared, px)
        positions = self._stage(B.size_positions(B.admit(events, p), ratios, p), f"{stage}/positions")
        days = self._stage(B.position_days(positions, px, calendar), f"{stage}/days")
        valued = B.valued_trades(positions, days)
        flows = self._stage(B.daily_flows(valued, days), f"{stage}/flows")
        return Backtest(prepared, calendar, positions, days, valued, flows, costs, p)

    @cached_property
    def backtest(self) -> Backtest:
        return self.run_backtest(self.signals, B.cost_table(self.spark, self.settings.backtest), "backtest")

    def _base(self, df: DataFrame, stage: str) -> DataFrame:
        return self._stage(df.drop("scenario_id"), stage)

    @cached_property
    def daily_pnl(self) -> DataFrame:
        return self._base(self.backtest.daily_pnl, "daily_pnl")

    @cached_property
    def trade_log(self) -> DataFrame:
        return self._base(self.backtest.trade_log, "trade_log")

    @cached_property
    def exposure(self) -> DataFrame:
        return self._base(self.backtest.exposure, "exposure")

    @cached_property
    def split_frames(self) -> dict:
        """Backtest outputs with the split of their signals."""
        frames = {"daily_pnl": self.backtest.daily_pnl, "trade_log": self.backtest.trade_log,
                  "exposure": self.backtest.exposure}
        tagged = R.attach_splits(frames, self.signals, self.backtest.costs,
                                 B.execution_date(self.signals.columns))
        return {k: self._stage(v.drop("scenario_id"), f"split_{k}") for k, v in tagged.items()}

    @cached_property
    def drawdowns(self) -> DataFrame:
        return self._stage(A.drawdown_series(A.equity_frame(self.split_frames["daily_pnl"])), "drawdowns")

    @cached_property
    def backtest_metrics(self) -> DataFrame:
        f = self.split_frames
        return self._stage(A.backtest_metrics(
            self.drawdowns, f["trade_log"], f["exposure"], self.settings.analytics), "backtest_metrics")

    @cached_property
    def grid(self) -> DataFrame:
        return R.scenario_grid(self.spark, self.settings.robustness)

    @cached_property
    def sweep(self) -> dict:
        """All scenarios in one job: split-tagged backtest tables keyed by scenario."""
        s = self.settings
        best = M.best_validation_model(self.metrics, s.forecasts)
        runs, resolved = R.scenario_runs(self.grid, best, s.signals)
        signals = self.signals_of(runs, "sweep/signals")
        costs = R.scenario_costs(resolved, s.backtest)
        bt = self.run_backtest(signals, costs, "sweep")
        frames = {"daily_pnl": bt.daily_pnl, "trade_log": bt.trade_log, "exposure": bt.exposure}
        tagged = R.attach_splits(frames, signals, costs, B.execution_date(signals.columns))
        return {k: self._stage(v, f"sweep/split_{k}") for k, v in tagged.items()}

    @cached_property
    def robustness_results(self) -> DataFrame:
        f = self.sweep
        drawdowns = A.drawdown_series(A.equity_frame(f["daily_pnl"], None, R.KEYS), R.KEYS)
        metrics = A.backtest_metrics(drawdowns, f["trade_log"], f["exposure"], self.settings.analytics, R.KEYS)
        return self._stage(R.attach_parameters(metrics, self.grid), "robustness_results")

    @property
    def robustness_summary(self) -> DataFrame:
        return R.robustness_summary(self.robustness_results, self.settings.robustness)

    @cached_property
    def proxy(self) -> DataFrame:
        return self._stage(E.market_proxy(self.prices, self.settings.regimes.market_proxy), "proxy")

    @cached_property
    def labels(self) -> DataFrame:
        s = self.settings
        curves = B.equity_curves(self.daily_pnl.withColumn("scenario_id", F.lit("base")))
        dates = E.analysis_dates(self.daily_pnl, curves, self.exposure)
        features = E.market_features(self.proxy, s.regimes, s.analytics.trading_days_per_year)
        return self._stage(E.regime_labels(dates, features, s.regimes), "labels")

    @cached_property
    def regime_performance(self) -> DataFrame:
        s = self.settings
        curves = self.daily_pnl.select("date", "model", "cumulative_net_pnl", "equity")
        return self._stage(E.regime_performance(
            self.daily_pnl, curves, self.trade_log, self.exposure, self.labels, s.regimes, s.analytics),
            "regime_performance")

    @property
    def regime_summary(self) -> DataFrame:
        return E.regime_summary(self.regime_performance, self.labels, self.proxy, self.settings.regimes)
