"""Look-ahead-free features: every column is a window over the pair, lagged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import by_date, full_window, latest, ratio, split_of
from ..params import FeatureParams


def feature_columns(p: FeatureParams, has_proxy: bool, has_zscores: bool = True) -> list[str]:
    """Names of the generated features, in order."""
    def groups():
        for lag in p.lags:
            yield "lagged_spread", f"spread_lag_{lag}"
        if has_zscores:
            for w in p.z_score_windows:
                for lag in p.lags:
                    yield "lagged_z_score", f"z_score_{w}_lag_{lag}"
        for group, prefix, windows in (
            ("rolling_spread_mean", "spread_mean", p.spread_mean_windows),
            ("rolling_spread_volatility", "spread_volatility", p.spread_volatility_windows),
            ("spread_momentum", "spread_momentum", p.momentum_windows),
        ):
            for w in windows:
                for lag in p.lags:
                    yield group, f"{prefix}_{w}_lag_{lag}"
        for lag in p.lags:
            yield "return_differential", f"return_differential_lag_{lag}"
        for w in p.correlation_windows:
            for lag in p.lags:
                yield "rolling_correlation", f"return_correlation_{w}_lag_{lag}"
        for lag in p.lags:
            yield "volume_ratio", f"volume_ratio_lag_{lag}"
        if has_proxy:
            for lag in p.lags:
                yield "market_return_proxy", f"market_return_proxy_lag_{lag}"
            for lag in p.lags:
                yield ("volatility_regime_proxy",
                       f"volatility_regime_{p.volatility_regime_window}_lag_{lag}")

    return [name for group, name in groups() if group in p.enabled]


def proxy_returns(panel: DataFrame, calendar: DataFrame, ticker: str) -> DataFrame:
    """Return of the proxy on the union calendar; a gap repeats the last price."""
    proxy = panel.filter(F.col("ticker") == ticker).select(
        "date", F.col("adjusted_close").alias("px"))
    # One ticker over one calendar: the single group is bounded by the days covered.
    w = Window.partitionBy(F.lit(ticker)).orderBy("date")
    filled = calendar.join(proxy, "date", "left").select(
        "date", F.last("px", ignorenulls=True).over(w).alias("px"))
    return filled.select("date", (F.col("px") / F.lag("px").over(w) - 1).alias("market_return"))


def build_features(spreads: DataFrame, zscores: DataFrame, panel: DataFrame,
                   p: FeatureParams, unique: bool = False) -> DataFrame:
    """Targets, split and all enabled features of each pair and date.

    Of several spread or z-score rows of one (pair, date[, window]) the last source
    row (``ord``) counts; ``unique`` says that there is one.
    ``panel`` has one row per (ticker, date). Prices and volumes join by
    (ticker, date); then every feature shares one shuffle and one sort by
    (pair, date).
    """
    spreads = latest(spreads, ["pair_id", "date"], unique, "spreads")
    base = spreads.select("pair_id", "ticker_1", "ticker_2", "date", "spread")
    px = panel.select("ticker", "date", "adjusted_close", "volume")

    def leg(n: int) -> DataFrame:
        return px.select(F.col("ticker").alias(f"ticker_{n}"), "date",
                         F.col("adjusted_close").alias(f"px{n}"), F.col("volume").alias(f"vol{n}"))

    rows = base.join(leg(1), ["ticker_1", "date"], "left").join(leg(2), ["ticker_2", "date"], "left")
    windows = [int(w) for w in p.z_score_windows] if "lagged_z_score" in p.enabled else []
    if windows:
        z = latest(zscores.filter(F.col("z_score_window").isin(windows)),
                   ["pair_id", "date", "z_score_window"], unique, "z-scores")
        wide = z.groupBy("pair_id", "date").agg(*[
            F.max(F.when(F.col("z_score_window") == w, F.col("z_score"))).alias(f"z{w}")
            for w in windows
        ])
        rows = rows.join(wide, ["pair_id", "date"], "left")
    proxied = bool(p.market_proxy)
    if proxied:
        calendar = panel.select("date").distinct()
        rows = rows.join(proxy_returns(panel, calendar, p.market_proxy), "date", "left")

    spec = by_date("pair_id")

    def before(column: str, lag: int):
        return F.lag(column, lag).over(spec)

    def frame(window: int, lag: int):
        return spec.rowsBetween(-(window + lag - 1), -lag)

    rows = rows.withColumns({
        "r1": F.col("px1") / before("px1", 1) - 1,
        "r2": F.col("px2") / before("px2", 1) - 1,
        "target_date": F.lead("date").over(spec),
        "target_next_day_spread": F.lead("spread").over(spec),
        "vr": ratio(F.col("vol1"), F.col("vol2")),
    })
    both = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), F.struct("r1", "r2"))
    made: dict = {"target_next_day_spread_change": F.col("target_next_day_spread") - F.col("spread")}
    spread = F.col("spread")
    for lag in p.lags:
        made[f"spread_lag_{lag}"] = before("spread", lag)
        for w in windows:
            made[f"z_score_{w}_lag_{lag}"] = before(f"z{w}", lag)
        for w in p.spread_mean_windows:
            made[f"spread_mean_{w}_lag_{lag}"] = full_window(
                F.avg("spread"), spread, frame(w, lag), w)
        for w in p.spread_volatility_windows:
            made[f"spread_volatility_{w}_lag_{lag}"] = full_window(
                F.stddev_samp("spread"), spread, frame(w, lag), w)
        for w in p.momentum_windows:
            made[f"spread_momentum_{w}_lag_{lag}"] = before("spread", lag) - before("spread", lag + w)
        made[f"return_differential_lag_{lag}"] = before("r1", lag) - before("r2", lag)
        for w in p.correlation_windows:
            f = frame(w, lag)
            # Correlation of flat returns is missing, as is one with gaps in the window.
            made[f"return_correlation_{w}_lag_{lag}"] = F.when(
                F.count(both).over(f) >= w,
                ratio(F.covar_samp("r1", "r2").over(f),
                      F.sqrt(F.var_samp("r1").over(f) * F.var_samp("r2").over(f))))
        made[f"volume_ratio_lag_{lag}"] = before("vr", lag)
        if proxied:
            made[f"market_return_proxy_lag_{lag}"] = before("market_return", lag)
            made[f"volatility_regime_{p.volatility_regime_window}_lag_{lag}"] = full_window(
                F.stddev_samp("market_return"), F.col("market_return"),
                frame(p.volatility_regime_window, lag), p.volatility_regime_window)
    features = feature_columns(p, proxied)
    targets = [f"target_{t}" for t in p.targets]
    out = rows.withColumns(made).withColumn("split", split_of(F.col("target_date"), p.walk))
    out = out.filter(F.col("split").isNotNull()).select(
        "date", "pair_id", "ticker_1", "ticker_2", "spread", "target_date",
        *targets, *features, "split")
    return out.dropna(subset=features + targets) if p.drop_missing_rows else out


def split_extract(features: DataFrame, split: str) -> DataFrame:
    """One walk-forward split; a partition filter on the stage table."""
    return features.filter(F.col("split") == split)
