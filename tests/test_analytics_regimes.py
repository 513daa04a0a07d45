import datetime as dt
import json
from dataclasses import replace
from hashlib import sha1

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows, weekdays
from pairloom.functions.columns import float_text, general_text
from pairloom.functions.stats import Ranks, expanding_quantiles
from pairloom.operators import analytics as A
from pairloom.operators import regimes as E
from pairloom.operators import report as T
from pairloom.operators import robustness as R
from pairloom.params import AnalyticsParams, ForecastParams, Period, RegimeParams, RobustnessParams, WalkForward

DAYS = weekdays("2021-03-01", 12)
AP = AnalyticsParams(trading_days_per_year=50)
START = 2000.0
RETURNS = np.array([0.02, -0.01, 0.0, 0.015, -0.03, 0.01, -0.005])
TRADES = [(31.5, 2, "exit_z"), (-12.25, 7, "stop_loss_z"), (4.0, 1, "exit_z"), (-3.5, 4, "max_holding_days"), (18.0, 6, "exit_z")]
BOOK = [(250.0, 40.0, 2, 75.0), (310.0, -20.0, 3, 0.0), (180.0, 5.0, 1, 130.0), (0.0, 0.0, 0, 180.0), (90.0, 90.0, 1, 90.0)]


def daily(spark, split=None):
    equity = START * np.cumprod(1 + RETURNS)
    pnl = np.diff(np.concatenate([[START], equity]))
    df = spark.createDataFrame([(d, "naive", float(p), float(e)) for d, p, e in zip(DAYS, pnl, equity)],
                               "date date, model string, net_pnl double, equity double")
    return df.withColumn("split", F.lit(split)) if split else df


def trades(spark):
    return spark.createDataFrame([("naive", DAYS[i % 3 + 1], *t) for i, t in enumerate(TRADES)],
                                 "model string, exit_date date, net_pnl double, holding_days int, exit_reason string")


def exposures(spark):
    return spark.createDataFrame([(d, "naive", *b) for d, b in zip(DAYS, BOOK)],
                                 "date date, model string, gross_exposure double, net_exposure double, active_positions int, turnover double")


@pytest.mark.parametrize("split", [None, "validation"])
def test_return_metrics(spark, split):
    out = {r["split"]: r for r in rows(A.return_metrics(A.drawdown_series(A.equity_frame(daily(spark, split))), AP))}
    assert set(out) == ({"all", split} if split else {"all"})
    year, curve = AP.trading_days_per_year, np.cumprod(1 + RETURNS)
    total = curve[-1] - 1
    annual = curve[-1] ** (year / len(RETURNS)) - 1
    deepest = min(curve / np.maximum.accumulate(curve) - 1)
    want = {"total_return": total, "annualized_return": annual, "max_drawdown": deepest, "calmar_ratio": annual / -deepest,
            "annualized_volatility": RETURNS.std(ddof=1) * year ** 0.5,
            "sharpe_ratio": RETURNS.mean() / RETURNS.std(ddof=1) * year ** 0.5,
            "sortino_ratio": RETURNS.mean() / RETURNS[RETURNS < 0].std(ddof=1) * year ** 0.5}
    for m in out.values():
        assert {k: m[k] for k in want} == pytest.approx(want)


def test_trade_and_exposure_metrics(spark):
    pnl, held, why = (np.array(x) for x in zip(*TRADES))
    t = rows(A.trade_metrics(trades(spark)))[0]
    want = {"number_of_trades": len(pnl), "win_rate": (pnl > 0).mean(), "average_trade_pnl": pnl.mean(),
            "median_trade_pnl": np.median(pnl), "profit_factor": pnl[pnl > 0].sum() / -pnl[pnl < 0].sum(),
            "average_holding_period": held.mean()}
    assert {k: t[k] for k in want} == pytest.approx(want)
    assert t["exit_reason_counts"] == ";".join(f"{x}:{(why == x).sum()}" for x in sorted(set(why)))
    gross, net, active, turnover = (np.array(x, float) for x in zip(*BOOK))
    e = rows(A.exposure_metrics(exposures(spark)))[0]
    want = {"average_gross_exposure": gross.mean(), "average_net_exposure": net.mean(), "max_gross_exposure": gross.max(),
            "average_active_positions": active.mean(), "turnover": turnover.sum(), "average_daily_turnover": turnover.mean()}
    assert {k: e[k] for k in want} == pytest.approx(want)
    wins = A.trade_metrics(trades(spark).filter("net_pnl > 0"))
    assert rows(wins)[0]["profit_factor"] == float("inf")


def test_scopes_prefer_rows_marked_all(spark):
    df = spark.createDataFrame([("m", "all", 1.0), ("m", "test", 2.0), ("n", "test", 3.0), ("n", "", 4.0), ("n", None, 5.0)],
                               "model string, split string, v double")
    got = sorted((r["model"], r["split"], r["v"]) for r in rows(A.scoped(df)))
    assert got == [("m", "all", 1.0), ("m", "test", 2.0), ("n", "all", 3.0), ("n", "all", 4.0), ("n", "all", 5.0), ("n", "test", 3.0)]


def test_combined_metrics_and_equity_fallback(spark):
    curves = daily(spark).drop("net_pnl")
    empty = daily(spark).limit(0)
    dd = A.drawdown_series(A.equity_frame(empty, curves))
    assert [r["daily_return"] for r in rows(dd, "date")] == pytest.approx([0.0, *RETURNS[1:]])
    m = rows(A.backtest_metrics(A.drawdown_series(A.equity_frame(daily(spark), curves)), trades(spark).limit(0),
                                exposures(spark), AP))[0]
    assert (m["number_of_trades"], m["observation_count"], m["win_rate"], m["turnover"]) == (
        0, len(RETURNS), None, sum(b[3] for b in BOOK))
    summary = rows(A.performance_summary(A.backtest_metrics(dd, trades(spark), exposures(spark), AP)))
    assert summary[0]["performance_rank"] == 1


def test_empty_inputs_keep_their_schema(spark):
    none = A.backtest_metrics(A.drawdown_series(A.equity_frame(daily(spark).limit(0))), trades(spark).limit(0),
                              exposures(spark).limit(0), AP)
    assert none.columns == ["model", "split", *A.CORE_METRICS] and none.count() == 0


def test_scenario_ids_are_canonical(spark):
    p = RobustnessParams(entry_z_values=(1.5, 2.0), commission_bps_values=(0, 5), max_scenarios=3)
    got = rows(R.scenario_grid(spark, p))
    assert [(r["entry_z"], r["commission_bps"]) for r in got] == [(1.5, 0.0), (1.5, 5.0), (2.0, 0.0)]
    body = {"entry_z": 1.5, "exit_z": 0.5, "stop_loss_z": 3.0, "commission_bps": 0.0, "slippage_bps": 2.0,
            "zscore_window": 60, "signal_model": "best_validation"}
    want = "scenario_" + sha1(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    assert got[0]["scenario_id"] == want


def results(spark, data):
    base = {c: 0.0 for c in A.CORE_METRICS}
    made = []
    for scenario, split, sharpe, drawdown, entry, commission in data:
        row = {**base, "sharpe_ratio": sharpe, "max_drawdown": drawdown, "scenario_id": scenario, "model": "naive",
               "split": split, "entry_z": entry, "exit_z": 0.5, "stop_loss_z": 3.0, "commission_bps": commission,
               "slippage_bps": 2.0, "zscore_window": 60, "signal_model": "naive"}
        made.append([row[c] for c in R.RESULTS])
    types = dict(R._types())
    return spark.createDataFrame(made, ", ".join(f"{c} {types[c]}" for c in R.RESULTS))


def test_summary_uses_validation_rows(spark):
    grid = [("s1", 0.75, -0.04, 1.0, 1.0), ("s2", 1.25, -0.11, 1.0, 3.0), ("s3", -0.5, -0.3, 2.5, 3.0), ("s4", 0.25, -0.2, 2.5, 1.0)]
    data = [(n, "validation", *x) for n, *x in grid] + [(n, "test", -10 * x[0], -0.9, *x[2:]) for n, *x in grid]
    out = {r["summary_item"]: r for r in rows(R.robustness_summary(results(spark, data), RobustnessParams()))}
    best, worst = max(grid, key=lambda g: g[1]), min(grid, key=lambda g: g[2])
    assert (out[R.ITEMS[0]]["scenario_id"], out[R.ITEMS[0]]["value"]) == best[:2]
    assert out[R.ITEMS[1]]["sharpe_ratio"] == np.median([g[1] for g in grid])
    assert (out[R.ITEMS[2]]["scenario_id"], out[R.ITEMS[2]]["value"]) == (worst[0], worst[2])
    low, high = (np.median([g[1] for g in grid if g[4] == c]) for c in (1.0, 3.0))
    assert out[R.ITEMS[3]]["value"] == high - low
    assert out[R.ITEMS[3]]["notes"] == (
        f"Validation sharpe_ratio median changed from {low:.6g} at 3 bps to {high:.6g} at 5 bps.")
    assert out[R.ITEMS[4]]["notes"] == "concentrated=true; top_rows=1; narrow_parameters=entry_z,commission_bps"


def test_no_scenario_is_dropped_without_a_choice(spark):
    p = RobustnessParams(entry_z_values=tuple(1 + k / 8 for k in range(6)), commission_bps_values=(0.0, 1e-5, 2e7))
    got = rows(R.scenario_grid(spark, p))
    assert len(got) == 18 and len({r["scenario_id"] for r in got}) == 18
    for r in got:
        body = {c: r[c] for c in R.PARAMETERS}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        assert r["scenario_id"] == "scenario_" + sha1(text.encode()).hexdigest()[:12]


def test_number_texts(spark):
    values = [0.000123, 1234567.0, -1e-5, 0.1, 1e16, 123456789012345.0, 1.5e-7, 0.0, -2.0, 1e300, 99999.26, 12345678.51]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = rows(df.select("v", general_text(F.col("v")).alias("six"), float_text(F.col("v")).alias("whole")))
    for r in got:
        assert r["whole"] == ("nan" if r["v"] is None else str(r["v"])), r
        assert r["v"] is None or r["six"] == f"{r['v']:.6g}", r


def test_six_digits_round_the_exact_value(spark):
    values = [1000.005, -1000.005, 2.0000005, 0.30000045, 1.0000035e-7, 100000.5, 0.0, -0.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", general_text(F.col("v")).alias("six"), float_text(F.col("v")).alias("whole")).collect():
        assert r["six"] == ("0" if r["v"] == 0 else f"{r['v']:.6g}") and r["whole"] == repr(r["v"])


def test_summary_without_validation_explains_itself(spark):
    out = {r["summary_item"]: r["notes"] for r in rows(R.robustness_summary(
        results(spark, [("s1", "test", 2.0, -0.1, 1.5, 0.0)]), RobustnessParams()))}
    assert out[R.ITEMS[0]] == "No validation metrics were available; no scenario was selected." and len(out) == 5
    assert rows(R.robustness_summary(results(spark, [("s", "test", 1.0, 0.0, 1.0, 0.0)]).limit(0), RobustnessParams())) == []


def test_dominant_split_breaks_ties_by_priority(spark):
    df = spark.createDataFrame([(1, "test"), (1, "validation"), (2, "test"), (2, "test"), (2, "validation"), (3, "zz"), (3, "aa")],
                               "k int, split string")
    assert {r["k"]: r["split"] for r in rows(R.dominant_split(df, ["k"]))} == {1: "validation", 2: "test", 3: "aa"}


WALK = WalkForward(Period("2020-01-01", "2020-12-31"), Period(DAYS[0], DAYS[3]), Period(DAYS[4], DAYS[7]), Period(DAYS[8], DAYS[11]))
RP = RegimeParams(market_proxy="SPY", walk=WALK, volatility_window=3, volatility_min_periods=3, trend_window=3,
                  trend_min_periods=3, minimum_observations=2, special_periods=(("Stress  One!", Period(DAYS[1], DAYS[2])),))


def market(spark, n=40, shock=0):
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, n)
    r[n - shock:] *= 30
    days = weekdays("2021-01-25", n)
    return spark.createDataFrame([(d, float(p)) for d, p in zip(days, 100 * np.cumprod(1 + r))], "date date, adjusted_close double")


def test_labels_and_future_shock(spark):
    dates = spark.createDataFrame([(d,) for d in DAYS], "date date")
    calm = rows(E.regime_labels(dates, E.market_features(market(spark), RP), RP), "date")
    later = market(spark).union(spark.createDataFrame([(dt.date(2021, 5, 3), 900.0), (dt.date(2021, 5, 4), 10.0)], "date date, adjusted_close double"))
    assert calm == rows(E.regime_labels(dates, E.market_features(later, RP), RP), "date")
    assert [r["split"] for r in calm] == ["validation"] * 4 + ["test"] * 4 + ["holdout_2025"] * 4
    assert [r["stress_one"] for r in calm] == [False, True, True] + [False] * 9
    assert all(r["high_volatility"] + r["low_volatility"] + r["normal_volatility"] == 1 for r in calm)
    full = rows(E.market_features(market(spark), replace(RP, quantile_method="full_sample")))
    assert len({r["high_volatility_threshold"] for r in full}) == 1
    blank = rows(E.regime_labels(dates, E.market_features(market(spark).limit(0), RP), RP))
    assert {(r["volatility_regime"], r["market_trend_regime"]) for r in blank} == {("unclassified", "unclassified")}


def test_regime_performance_and_summary(spark):
    pnl = [10.0, -5.0, 4.0, 1.0, 2.0, -3.0, 5.0, 0.0, 1.0, 2.0, -1.0, 3.0]
    equity = 100 + np.cumsum(pnl)
    day = spark.createDataFrame([(d, "naive", p, float(e), float(e - 100)) for d, p, e in zip(DAYS, pnl, equity)],
                                "date date, model string, net_pnl double, equity double, cumulative_net_pnl double")
    ex = day.select("date", "model", F.lit(50.0).alias("gross_exposure"), F.lit(0.0).alias("net_exposure"),
                    F.lit(1).alias("active_positions"), F.lit(2.0).alias("turnover"))
    dates = E.analysis_dates(day, ex)
    labels = E.regime_labels(dates, E.market_features(market(spark), RP), RP).cache()
    args = (day, day.drop("net_pnl"), trades(spark), ex, labels, RP, AP)
    perf = E.regime_performance(*args).cache()
    out = {r["regime"]: r for r in rows(perf)}
    assert len(out) == 9
    v = out["validation"]
    assert (v["label_days"], v["number_of_trading_days"], v["net_pnl"], v["number_of_trades"], v["turnover"],
            v["trade_attribution_method"]) == (4, 4, sum(pnl[:4]), float(len(TRADES)), 8.0, "exit_date")
    assert (out["test"]["number_of_trades"], out["stress_one"]["net_pnl"]) == (0.0, pnl[1] + pnl[2])
    spare = {r["regime"]: r for r in rows(E.regime_performance(day.limit(0), *args[1:]))}
    assert spare["validation"]["net_pnl"] == pytest.approx(equity[3] - equity[0])
    summary = rows(E.regime_summary(perf, labels, market(spark), RP))
    items = [r["summary_item"] for r in summary]
    assert items.count("best_regime") == 1 and "market_proxy_unavailable" not in items
    assert "market_proxy_unavailable" in [r["summary_item"] for r in rows(E.regime_summary(perf, labels, market(spark).limit(0), RP))]
    none = rows(E.regime_summary(perf.limit(0), labels, market(spark), RP))
    assert [r["summary_item"] for r in none] == ["no_regime_performance"]


def test_report_fallbacks(spark):
    metrics = spark.createDataFrame([("a", "validation", 2.0), ("b", "validation", 1.0)], "model string, split string, rmse double")
    table = spark.createDataFrame([("a", False, None), ("b", False, 2)], "model string, selected_by_validation boolean, selection_rank int")
    p = ForecastParams()
    assert rows(T.selected_model(table, metrics, p)) == [{"model": "b"}]
    assert rows(T.selected_model(table.filter("model = 'a'"), metrics, p)) == [{"model": "b"}]
    assert rows(T.selected_model(table.withColumn("selected_by_validation", F.col("model") == "a"), metrics, p)) == [{"model": "a"}]
    frame = spark.createDataFrame([("a", "all", 1.0, 1.0), ("b", "all", 2.0, 0.5), ("a", "test", 9.0, 9.0)],
                                  "model string, split string, sharpe_ratio double, total_return double")
    missing = metrics.select(F.lit("zz").alias("model"))
    assert rows(T.metric_row(frame, missing, "all"))[0]["model"] == "b"
    assert rows(T.metric_row(frame, metrics.select(F.lit("a").alias("model")), "all"))[0]["sharpe_ratio"] == 1.0
    assert rows(T.metric_row(frame, missing, "holdout_2025"))[0]["split"] == "test"


def test_expanding_quantiles_of_many_series_equal_plain_ones(spark):
    draw = np.random.default_rng(4)
    day = dt.date(2000, 1, 1)
    data = {}
    for k in range(6):
        values = np.round(draw.normal(size=300), 1 if k % 2 else 6)
        data[f"s{k}"] = [None if draw.random() < 0.1 else float(v) for v in values]
    listed = [(k, day + dt.timedelta(days=i), v) for k, vs in data.items() for i, v in enumerate(vs)]
    listed = [listed[i] for i in draw.permutation(len(listed))]
    df = spark.createDataFrame(listed, "k string, date date, v double")
    out = expanding_quantiles(df, ("k",), "date", "v", {"low": 0.25, "high": 0.9}).collect()
    assert len(out) == 1800
    for r in out:
        before = [v for v in data[r["k"]][:(r["date"] - day).days] if v is not None]
        assert r["v"] == data[r["k"]][(r["date"] - day).days]
        want = (np.quantile(before, 0.25), np.quantile(before, 0.9)) if before else (None, None)
        assert (r["low"], r["high"]) == (pytest.approx(want) if before else want)


def test_ranks_cost_no_more_than_a_logarithm():
    n = 20_000
    values = np.random.default_rng(1).normal(size=n)
    ranks = Ranks(values)
    for r in ranks.rank.tolist():
        ranks.insert(r)
    assert ranks.quantile(0.37) == pytest.approx(np.quantile(values, 0.37)) and len(ranks.tree) == n + 1
