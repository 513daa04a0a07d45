"""Parameters of the research steps.

Plain frozen dataclasses. The defaults are the published research settings;
every class checks its legal values when it is built.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

# Names of the walk-forward splits, in calendar order.
SPLITS = ("train", "validation", "test", "holdout_2025")
EVALUATION_SPLITS = ("validation", "test", "holdout_2025")
HOLDOUT = "holdout_2025"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _date(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class Period:
    """A closed date range."""

    start: dt.date
    end: dt.date

    def __post_init__(self):
        object.__setattr__(self, "start", _date(self.start))
        object.__setattr__(self, "end", _date(self.end))
        _require(self.start <= self.end, "period start must be on or before its end")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


@dataclass(frozen=True)
class WalkForward:
    train: Period = Period("2008-01-01", "2018-12-31")
    validation: Period = Period("2019-01-01", "2021-12-31")
    test: Period = Period("2022-01-01", "2024-12-31")
    holdout: Period = Period("2025-01-01", "2025-12-31")

    @property
    def full(self) -> Period:
        periods = (self.train, self.validation, self.test, self.holdout)
        return Period(min(p.start for p in periods), max(p.end for p in periods))

    def named(self):
        return tuple(zip(SPLITS, (self.train, self.validation, self.test, self.holdout)))


@dataclass(frozen=True)
class QualityParams:
    period: Period = Period("2008-01-01", "2025-12-31")
    min_history_days: int = 252
    max_missing_fraction: float = 0.10
    frequency: str = "daily"
    price_field: str = "adjusted_close"
    required_columns: tuple = (
        "date", "open", "high", "low", "close", "adjusted_close", "volume",
    )

    def __post_init__(self):
        _require(self.frequency == "daily", "only daily bars are supported")
        _require(self.price_field == "adjusted_close", "price_field must be adjusted_close")


@dataclass(frozen=True)
class UniverseParams:
    period: Period = Period("2008-01-01", "2025-12-31")
    min_adjusted_close_price: float = 5.0
    min_average_daily_dollar_volume: float = 1e7
    max_missing_data_ratio: float = 0.10
    max_zero_volume_days: int = 0
    min_history_days: int = 252


@dataclass(frozen=True)
class PairParams:
    formation: Period = Period("2008-01-01", "2018-12-31")
    same_sector_only: bool = True
    min_return_correlation: float = 0.6
    cointegration_test: str = "engle_granger"
    correction: str = "benjamini_hochberg_fdr"
    fdr_alpha: float = 0.05
    half_life_min_days: float = 2
    half_life_max_days: float = 60
    top_n_pairs: int = 10
    min_overlap_days: int = 504
    # "aic": lag-augmented test with response-surface p-values;
    # "df": plain Dickey-Fuller regression with a normal p-value.
    variant: str = "aic"
    # Longest lag that "aic" may choose; None: by the length of the history.
    max_lag: int | None = None
    # Tickers of a block in the candidate self-join; spreads a hot sector.
    block_size: int = 64

    def __post_init__(self):
        _require(self.cointegration_test == "engle_granger", "only engle_granger is supported")
        _require(self.correction == "benjamini_hochberg_fdr",
                 "only benjamini_hochberg_fdr is supported")
        _require(self.variant in ("aic", "df"), "variant must be aic or df")
        _require(self.block_size >= 1, "block_size must be at least 1")


@dataclass(frozen=True)
class SpreadParams:
    formation: Period = Period("2008-01-01", "2018-12-31")
    data: Period = Period("2008-01-01", "2025-12-31")
    definition: str = "log_price_hedge_ratio_adjusted"
    hedge_ratio_method: str = "static_ols"
    windows: tuple = (20, 60, 120)
    variant: str = "aic"
    max_lag: int | None = None

    def __post_init__(self):
        _require(self.definition == "log_price_hedge_ratio_adjusted",
                 "only log_price_hedge_ratio_adjusted spreads are supported")
        _require(self.hedge_ratio_method == "static_ols", "only static_ols is supported")


FEATURE_GROUPS = (
    "lagged_spread", "lagged_z_score", "rolling_spread_mean", "rolling_spread_volatility",
    "spread_momentum", "return_differential", "rolling_correlation", "volume_ratio",
    "market_return_proxy", "volatility_regime_proxy",
)


@dataclass(frozen=True)
class FeatureParams:
    walk: WalkForward = WalkForward()
    enabled: tuple = FEATURE_GROUPS
    lag_days: int = 1
    lags: tuple = (1,)
    z_score_windows: tuple = (60,)
    spread_mean_windows: tuple = (60,)
    spread_volatility_windows: tuple = (60,)
    momentum_windows: tuple = (5,)
    correlation_windows: tuple = (60,)
    volatility_regime_window: int = 60
    targets: tuple = ("next_day_spread", "next_day_spread_change")
    default_target: str = "next_day_spread"
    drop_missing_rows: bool = True
    market_proxy: str | None = None

    def __post_init__(self):
        _require(self.lag_days >= 1, "lag_days must be at least 1")
        lags = tuple(sorted({max(int(lag), self.lag_days) for lag in self.lags}))
        object.__setattr__(self, "lags", lags)


@dataclass(frozen=True)
class ForecastParams:
    target: str = "target_next_day_spread"
    rolling_window: int = 20
    arima_order: tuple = (1, 0, 0)
    train_validation_for_test: bool = False
    selection_metric: str = "rmse"
    selection_split: str = "validation"
    selection_direction: str = "minimize"
    trees: int = 200
    tree_depth: int = 3
    learning_rate: float = 0.05
    subsample: float = 0.8
    column_sample: float = 0.8
    l2: float = 1.0
    l1: float = 0.0
    split_price: float = 0.0
    least_weight: float = 1.0
    seed: int = 42
    missing_strategy: str = "median"
    sequence_length: int = 20
    scale_features: bool = True
    hidden_size: int = 32
    rounds: int = 60
    patience: int = 10
    recurrent_rate: float = 0.02

    def __post_init__(self):
        _require(len(self.arima_order) == 3, "arima_order needs three integers")
        _require(self.selection_split == "validation",
                 "model selection must use validation metrics only")
        _require(self.selection_direction in ("minimize", "maximize"),
                 "selection_direction must be minimize or maximize")
        _require(self.missing_strategy in ("median", "zero"),
                 "missing_strategy must be median or zero")
        _require(self.sequence_length >= 1, "sequence_length must be at least 1")
        _require(self.hidden_size >= 1 and self.rounds >= 1, "hidden_size and rounds must be at least 1")


@dataclass(frozen=True)
class SignalParams:
    signal_model: str = "best_validation"
    entry_z: float = 2.0
    exit_z: float = 0.5
    stop_loss_z: float = 3.0
    max_holding_days: int = 60
    z_score_window: int = 60
    generate_train_signals: bool = False
    use_predicted_spread: bool = True
    use_predicted_zscore: bool = True

    def __post_init__(self):
        _require(self.entry_z > 0 and self.stop_loss_z > 0, "entry and stop must be positive")
        _require(self.exit_z >= 0, "exit_z must not be negative")
        _require(self.max_holding_days >= 1, "max_holding_days must be at least 1")


@dataclass(frozen=True)
class BacktestParams:
    initial_capital: float = 100_000.0
    commission_bps: float = 5.0
    slippage_bps: float = 2.0
    borrow_cost_bps: float = 0.0
    max_active_pairs: int = 20
    capital_allocation: str = "equal_weight"
    position_sizing: str = "beta_scaled_gross"
    generate_train_backtest: bool = False

    def __post_init__(self):
        _require(self.initial_capital > 0, "initial_capital must be positive")
        _require(self.max_active_pairs >= 1, "max_active_pairs must be at least 1")
        _require(min(self.commission_bps, self.slippage_bps, self.borrow_cost_bps) >= 0,
                 "costs must not be negative")
        _require(self.capital_allocation in ("equal_weight", "equal_weight_pairs"),
                 "capital_allocation must be equal_weight or equal_weight_pairs")
        _require(self.position_sizing == "beta_scaled_gross",
                 "position_sizing must be beta_scaled_gross")


@dataclass(frozen=True)
class AnalyticsParams:
    risk_free_rate: float = 0.0
    trading_days_per_year: int = 252

    def __post_init__(self):
        _require(self.trading_days_per_year > 0, "trading_days_per_year must be positive")


@dataclass(frozen=True)
class RobustnessParams:
    entry_z_values: tuple = (1.5, 2.0)
    exit_z_values: tuple = (0.5,)
    stop_loss_z_values: tuple = (3.0,)
    commission_bps_values: tuple = (0.0, 5.0)
    slippage_bps_values: tuple = (2.0,)
    zscore_window_values: tuple = (60,)
    signal_model_values: tuple = ("best_validation",)
    # None runs the whole product; a number is an explicit choice of the caller.
    max_scenarios: int | None = None
    selection_metric: str = "sharpe_ratio"
    selection_split: str = "validation"
    concentration_top_fraction: float = 0.2

    def __post_init__(self):
        _require(self.max_scenarios is None or self.max_scenarios >= 1, "max_scenarios must be at least 1")
        _require(self.selection_split == "validation",
                 "scenario ranking must use validation metrics only")
        _require(self.selection_metric in ("sharpe_ratio", "calmar_ratio"),
                 "selection_metric must be sharpe_ratio or calmar_ratio")
        _require(0 < self.concentration_top_fraction <= 1,
                 "concentration_top_fraction must be in (0, 1]")
        for values in (self.entry_z_values, self.stop_loss_z_values):
            _require(all(v > 0 for v in values), "entry and stop values must be positive")
        for values in (self.exit_z_values, self.commission_bps_values,
                       self.slippage_bps_values):
            _require(all(v >= 0 for v in values), "exit and cost values must not be negative")
        _require(all(v >= 1 for v in self.zscore_window_values), "windows must be at least 1")
        _require(all(str(v).strip() for v in self.signal_model_values),
                 "signal models must not be blank")


def label_name(name: str) -> str:
    """Column-safe form of a period name: its runs of letters and digits, tied by '_'."""
    runs = re.findall(r"[a-z0-9]+", str(name).lower())
    _require(bool(runs), "period names must not be blank")
    return "_".join(runs)


@dataclass(frozen=True)
class RegimeParams:
    market_proxy: str = "SPY"
    walk: WalkForward = WalkForward()
    volatility_window: int = 60
    volatility_min_periods: int = 60
    quantile_method: str = "historical_expanding"
    high_quantile: float = 0.75
    low_quantile: float = 0.25
    enable_bull_bear: bool = True
    trend_window: int = 200
    trend_min_periods: int = 200
    minimum_observations: int = 20
    ranking_metric: str = "sharpe_ratio"
    special_periods: tuple = field(default_factory=lambda: (
        ("covid_stress", Period("2020-02-01", "2020-06-30")),
        ("rate_hike_drawdown", Period("2022-01-01", "2022-12-31")),
        ("final_holdout_2025", Period("2025-01-01", "2025-12-31")),
    ))

    def __post_init__(self):
        _require(2 <= self.volatility_min_periods <= self.volatility_window,
                 "need 2 <= volatility_min_periods <= volatility_window")
        _require(2 <= self.trend_min_periods <= self.trend_window,
                 "need 2 <= trend_min_periods <= trend_window")
        _require(0 < self.low_quantile < self.high_quantile < 1,
                 "need 0 < low_quantile < high_quantile < 1")
        _require(self.quantile_method in ("historical_expanding", "full_sample"),
                 "quantile_method must be historical_expanding or full_sample")
        _require(self.minimum_observations >= 1, "minimum_observations must be at least 1")
        _require(self.ranking_metric in ("sharpe_ratio", "calmar_ratio"),
                 "ranking_metric must be sharpe_ratio or calmar_ratio")
        _require(bool(self.market_proxy), "market_proxy must not be blank")

    def regimes(self):
        """(label column, regime type) in reporting order."""
        base = (
            ("validation", "walk_forward_split"),
            ("test", "walk_forward_split"),
            ("holdout_2025", "walk_forward_split"),
            ("high_volatility", "volatility"),
            ("low_volatility", "volatility"),
            ("normal_volatility", "volatility"),
            ("bull_market", "market_trend"),
            ("bear_market", "market_trend"),
        )
        return base + tuple((label_name(n), "special_period") for n, _ in self.special_periods)
