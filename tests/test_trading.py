import datetime as dt
import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows, weekdays
from pairloom.operators import backtest as B
from pairloom.operators import signals as G
from pairloom.params import BacktestParams, Period, SignalParams
from pairloom.session import stage_table

DAYS = weekdays("2021-01-04", 30)
SP = SignalParams(z_score_window=60)
COUNTER = itertools.count()


def machine(predicted, current, p=SP):
    return G.Walk(np.array(predicted, float), np.array(current, float), p.entry_z, p.exit_z, p.stop_loss_z, p.max_holding_days)


def walk(predicted, current, p=SP):
    labels = machine(predicted, current, p).labels(0)
    return pd.DataFrame(dict(zip(("signal_action", "signal_state", "holding_days", "exit_reason"), labels)))


def plain_walk(predicted, current, p):
    """Row-by-row restatement of the rules."""
    state, held, out = "flat", 0, []
    for forecast, z in zip(predicted, current):
        action, shown = "no_action", 0
        if state == "flat":
            if np.isfinite(forecast) and abs(forecast) > p.entry_z:
                state, held = ("short_spread" if forecast > 0 else "long_spread"), 0
                action = "enter_" + state
        else:
            held += 1
            shown = held
            if np.isfinite(z) and abs(z) > p.stop_loss_z:
                action, state = "stop_loss", "flat"
            elif np.isfinite(z) and abs(z) < p.exit_z:
                action, state = "exit", "flat"
            elif held > p.max_holding_days:
                action, state = "force_exit_max_holding", "flat"
            else:
                action = "hold_" + state
        out.append((action, state, shown))
    return out


def noisy(draw, n):
    predicted, current = draw.normal(0, 2, n), draw.normal(0, 1.6, n)
    predicted[draw.random(n) < 0.1] = np.nan
    current[draw.random(n) < 0.1] = np.nan
    return predicted, current


def test_chunks_compose_to_the_whole_walk():
    draw = np.random.default_rng(12)
    for _ in range(60):
        n = int(draw.integers(1, 120))
        predicted, current = noisy(draw, n)
        p = replace(SP, max_holding_days=int(draw.integers(1, 9)), exit_z=0.3)
        cuts = [0, *sorted(draw.integers(0, n + 1, 6).tolist()), n]
        state, got = 0, []
        for a, b in zip(cuts, cuts[1:]):
            part = machine(predicted[a:b], current[a:b], p)
            action, name, held, _ = part.labels(state)
            got += list(zip(action.tolist(), name.tolist(), held.tolist()))
            code = part.table()[0 if not state else 1 + (state - 1) // 2]
            state = 1 + 2 * (-1 - code) + (state - 1) % 2 if code < 0 else code
        assert got == plain_walk(predicted, current, p)


@pytest.mark.parametrize("days", [1, 5, 400])
def test_signals_over_chunks_of_days(spark, days):
    draw = np.random.default_rng(3)
    p = replace(SP, max_holding_days=4, exit_z=0.3)
    dates = weekdays("2021-01-04", 61)
    data, want = [], {}
    for pair in ("A-B", "C-D"):
        predicted, current = noisy(draw, 60)
        want[pair] = plain_walk(predicted, current, p)
        data += [("r", pair, "A", "B", "m", d, e, "test", 0.0, 0.0, None if np.isnan(z) else float(z),
                  None if np.isnan(f) else float(f), p.entry_z, p.exit_z, p.stop_loss_z, p.max_holding_days)
                 for d, e, z, f in zip(dates, dates[1:], current, predicted)]
    data = [data[k] for k in draw.permutation(len(data))]
    df = spark.createDataFrame(data, (
        "run_id string, pair_id string, ticker_1 string, ticker_2 string, model string, feature_date date, target_date date, "
        "split string, current_spread double, predicted_spread double, current_zscore double, predicted_zscore double, "
        "entry_z double, exit_z double, stop_loss_z double, max_holding_days int"))
    out = rows(G.generate_signals(df, days), "pair_id", "feature_date")
    for pair in want:
        assert [(r["signal_action"], r["signal_state"], r["holding_days"]) for r in out if r["pair_id"] == pair] == want[pair]


def test_entries_exits_and_stops():
    assert walk([-2.5, -2.5], [1.2, 0.2])["signal_action"].tolist() == ["enter_long_spread", "exit"]
    out = walk([2.5, 0.0], [1.0, -3.5])
    assert out["signal_action"].tolist() == ["enter_short_spread", "stop_loss"]
    assert out["exit_reason"].tolist() == ["", "stop_loss_z"]
    nan = float("nan")
    assert walk([nan, float("inf")], [0.1, 0.1])["signal_action"].tolist() == ["no_action", "no_action"]
    assert walk([-3, nan], [nan, nan])["signal_state"].tolist() == ["long_spread", "long_spread"]


def test_forced_exit_after_the_limit():
    out = walk([3, 3, 3, 3, 3], [1, 1, 1, 1, 1], replace(SP, max_holding_days=2))
    assert out["signal_action"].tolist() == ["enter_short_spread", "hold_short_spread", "hold_short_spread",
                                             "force_exit_max_holding", "enter_short_spread"]
    assert out["holding_days"].tolist() == [0, 1, 2, 3, 0]


@pytest.mark.parametrize("seed", range(6))
def test_jumps_equal_steps(seed):
    rng = np.random.default_rng(seed)
    p = SignalParams(entry_z=0.8, exit_z=0.3, stop_loss_z=1.8, max_holding_days=3)
    predicted, current = rng.normal(size=29), rng.normal(size=29)
    predicted[rng.random(29) < 0.1] = np.nan
    current[rng.random(29) < 0.1] = np.nan
    out = walk(predicted, current, p)
    got = list(zip(out["signal_action"], out["signal_state"], out["holding_days"]))
    assert got == plain_walk(predicted, current, p)


def test_signal_context_and_summary(spark):
    pred = spark.createDataFrame(
        [("A_B", "A", "B", "naive", DAYS[0], DAYS[1], "validation", -2.5, 7.0),
         ("A_B", "A", "B", "naive", DAYS[1], DAYS[2], "validation", 0.0, 7.0),
         ("A_B", "A", "B", "naive", DAYS[1], DAYS[2], "train", 0.0, 7.0),
         ("C_D", "C", "D", "naive", DAYS[0], DAYS[1], "validation", 9.0, 7.0),
         ("A_B", "A", "B", "other", DAYS[0], DAYS[1], "validation", 9.0, 7.0)],
        "pair_id string, ticker_1 string, ticker_2 string, model string, feature_date date, target_date date, "
        "split string, prediction double, spread double")
    spreads = spark.createDataFrame([(DAYS[0], "A_B", 1.5)], "date date, pair_id string, spread double")
    z = spark.createDataFrame([(DAYS[0], "A_B", 60, None, 0.0, 1.0), (DAYS[1], "A_B", 60, 0.2, 0.0, 1.0),
                               (DAYS[0], "A_B", 20, 9.0, 9.0, 9.0)],
                              "date date, pair_id string, z_score_window int, z_score double, "
                              "rolling_mean_lagged double, rolling_std_lagged double")
    chosen = spark.createDataFrame([("A_B",)], "pair_id string")
    models = spark.createDataFrame([("naive",)], "model string")
    inputs = G.signal_input(pred, spreads, z, chosen, G.single_run(models, SP), SP, unique=True)
    got = rows(inputs, "feature_date")
    assert [(r["current_spread"], r["current_zscore"], r["predicted_zscore"]) for r in got] == [(1.5, 1.5, -2.5), (7.0, 0.2, 0.0)]
    summary = rows(G.signal_summary(G.generate_signals(inputs)))[0]
    assert (summary["enter_long_spread_count"], summary["exit_count"], summary["final_open_positions"]) == (1, 1, 0)
    everything = G.signal_input(pred, spreads, z, chosen.limit(0), G.single_run(models, SP), SP, unique=True)
    assert everything.count() == 3


def run(spark, actions, p1, p2, beta=1.0, pair=("AAA_BBB", "AAA", "BBB"), splits=None, **costs):
    p = BacktestParams(max_active_pairs=1, **{"commission_bps": 0, "slippage_bps": 0, **costs})
    n = len(p1)
    splits = splits or ["validation"] * len(actions)
    signals = spark.createDataFrame(
        [(*pair, "naive", DAYS[i] - dt.timedelta(days=1), DAYS[i], s, a, "") for i, (a, s) in enumerate(zip(actions, splits))],
        "pair_id string, ticker_1 string, ticker_2 string, model string, feature_date date, target_date date, "
        "split string, signal_action string, exit_reason string")
    chosen = spark.createDataFrame([pair], "pair_id string, ticker_1 string, ticker_2 string")
    spreads = spark.createDataFrame([(d, pair[0], beta, 0.0) for d in DAYS[:n]], "date date, pair_id string, beta double, spread double")
    diag = spark.createDataFrame([(pair[0], beta)], "pair_id string, beta double")
    prices = spark.createDataFrame(
        [(t, d, v, 1.0) for t, px in (("AAA", p1), ("BBB", p2)) for d, v in zip(DAYS, px) if v is not None],
        "ticker string, date date, adjusted_close double, volume double")
    period = Period(DAYS[0], DAYS[n - 1])
    name = f"tests/{next(COUNTER)}"
    stage = lambda df, part: stage_table(df, f"{name}/{part}")
    prepared = stage(B.prepare_signals(signals, chosen, p), "prepared")
    px = stage(B.pair_prices(chosen, prices, spreads, period, unique=True), "px")
    calendar = stage(B.simulation_calendar(prepared, prices, period, chosen), "calendar")
    ratios = B.hedge_ratios(diag, spreads, chosen)
    events = stage(B.priced_events(prepared, px), "events")
    positions = stage(B.size_positions(B.admit(events, p), ratios, p), "positions")
    days = stage(B.position_days(positions, px, calendar), "days")
    valued = stage(B.valued_trades(positions, days), "valued")
    flows, table = stage(B.daily_flows(valued, days), "flows"), B.cost_table(spark, p)
    return {"trades": rows(B.trade_log(valued, table)),
            "daily": rows(B.daily_pnl(prepared, flows, calendar, table, p), "date"),
            "exposure": rows(B.exposure(prepared, days, flows, calendar, table), "date"),
            "open": rows(B.open_positions(valued, table))}


def test_accounting_identities(spark):
    out = run(spark, ["enter_long_spread", "exit"], [100.0, 110.0], [50.0, 45.0],
              commission_bps=5.0, slippage_bps=2.0, borrow_cost_bps=252.0)
    t = out["trades"][0]
    assert (t["gross_pnl"], t["commission_cost"], t["slippage_cost"], t["borrow_cost"], t["net_pnl"]) == pytest.approx(
        (10000.0, 100.0, 40.0, 4.5, 9855.5))
    assert t["exit_reason"] == "exit" and t["holding_days"] == 1
    assert [r["equity"] for r in out["daily"]] == pytest.approx([99930.0, 109855.5])
    first, second = out["exposure"]
    assert (first["gross_exposure"], first["net_exposure"], first["long_exposure"], first["active_positions"],
            first["turnover"]) == pytest.approx((100000.0, 0.0, 50000.0, 1, 100000.0))
    assert (second["active_positions"], second["turnover"]) == (0, pytest.approx(100000.0))


def test_beta_sizing_and_open_position(spark):
    out = run(spark, ["enter_long_spread"], [100.0], [50.0], beta=2.0)
    e, o = out["exposure"][0], out["open"][0]
    assert (e["gross_exposure"], e["long_exposure"], e["short_exposure"]) == pytest.approx((1e5, 1e5 / 3, 2e5 / 3))
    assert (o["hedge_ratio_beta"], o["holding_days"]) == (2.0, 0)
    assert run(spark, ["enter_long_spread"], [100.0], [50.0], beta=-2.0)["open"][0]["hedge_ratio_beta"] == 1.0


def test_train_rows_do_not_trade(spark):
    out = run(spark, ["enter_long_spread", "no_action"], [100.0, 110.0], [50.0, 45.0], splits=["train", "validation"])
    assert not out["trades"] and not out["open"]
    assert [r["equity"] for r in out["daily"]] == [100000.0]


def test_unpriced_days(spark):
    """A gap moves its pnl to the next priced day; an exit on it leaves the position open."""
    out = run(spark, ["enter_long_spread", "exit", "no_action", "exit"], [100.0, None, 120.0, 130.0], [50.0, 50.0, 50.0, 50.0])
    t = out["trades"][0]
    assert (t["exit_date"], t["holding_days"], t["gross_pnl"]) == (DAYS[3], 2, pytest.approx(15000.0))
    assert [r["gross_pnl"] for r in out["daily"]] == pytest.approx([0.0, 0.0, 10000.0, 5000.0])
    assert out["exposure"][1]["gross_exposure"] == pytest.approx(100000.0)


@pytest.mark.parametrize("slots", [1, 2, 3, 50])
def test_admission_equals_a_plain_fold(spark, slots):
    rng = np.random.default_rng(slots)
    events = []
    for model in ("m1", "m2"):
        for pair in (f"P{i}" for i in range(9)):
            inside = False
            for d in DAYS:
                if rng.random() < 0.45:
                    # Repeated entries and stray exits happen when a price was missing.
                    inside = (not inside) if rng.random() < 0.85 else inside
                    events.append(("r", model, pair, d, inside))
    events.sort(key=lambda e: (e[1], e[3], e[2]))
    want, held = [], {}
    for _, model, pair, d, enters in events:
        if enters:
            if (model, pair) not in held and sum(1 for k in held if k[0] == model) < slots:
                held[model, pair] = d
        elif (model, pair) in held:
            want.append((model, pair, held.pop((model, pair)), d))
    want += [(m, q, d, None) for (m, q), d in held.items()]
    df = spark.createDataFrame([(*e[:4], "A", "B", "enter_long_spread" if e[4] else "exit", e[4], 1.0, 2.0, "") for e in events],
                               "run_id string, model string, pair_id string, execution_date date, ticker_1 string, "
                               "ticker_2 string, signal_action string, enters boolean, p1 double, p2 double, exit_reason string")
    got = [(r["model"], r["pair_id"], r["entry_date"], r["exit_date"])
           for r in rows(B.admit(df, BacktestParams(max_active_pairs=slots)))]
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_spread_prices_fill_in_as_a_pair(spark):
    prices = spark.createDataFrame([("A", DAYS[0], 1.0, 1.0), ("B", DAYS[0], 2.0, 1.0), ("A", DAYS[1], 3.0, 1.0)],
                                   "ticker string, date date, adjusted_close double, volume double")
    spreads = spark.createDataFrame([("A_B", d, 7.0, 8.0) for d in DAYS[:2]],
                                    "pair_id string, date date, adjusted_close_1 double, adjusted_close_2 double")
    pairs = spark.createDataFrame([("A_B", "A", "B")], "pair_id string, ticker_1 string, ticker_2 string")
    out = rows(B.pair_prices(pairs, prices, spreads, Period(DAYS[0], DAYS[2]), unique=True), "date")
    assert [(r["p1"], r["p2"]) for r in out] == [(1.0, 2.0), (7.0, 8.0)]
