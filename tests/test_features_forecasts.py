import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows, weekdays
from pairloom.functions import statespace
from pairloom.functions.recurrent import Cell
from pairloom.operators import boosting
from pairloom.operators import features as X
from pairloom.operators import forecast as M
from pairloom.operators import learned as L
from pairloom.params import FeatureParams, ForecastParams, Period, WalkForward

N = 90
DAYS = weekdays("2020-01-01", N)
WALK = WalkForward(Period(DAYS[0], DAYS[39]), Period(DAYS[40], DAYS[59]), Period(DAYS[60], DAYS[74]),
                   Period(DAYS[75], DAYS[-1]))
P = FeatureParams(walk=WALK, z_score_windows=(3,), spread_mean_windows=(3,), spread_volatility_windows=(3,),
                  momentum_windows=(2,), correlation_windows=(3,), volatility_regime_window=3, market_proxy="M")


def inputs(spark, n=N, shock=0.0):
    rng = np.random.default_rng(2)
    s = rng.normal(size=N)
    s[n - 1] += shock
    px = {t: np.exp(np.cumsum(rng.normal(0, 0.01, N)) + 4) for t in "ABM"}
    spreads = spark.createDataFrame([(d, "A-B", "A", "B", float(v)) for d, v in zip(DAYS[:n], s)],
                                    "date date, pair_id string, ticker_1 string, ticker_2 string, spread double")
    z = spreads.select("date", "pair_id", F.lit(3).alias("z_score_window"), (F.col("spread") * 10).alias("z_score"))
    panel = spark.createDataFrame([(t, d, float(p), 1e6 + 100 * i) for t in "ABM"
                                   for i, (d, p) in enumerate(zip(DAYS, px[t]))],
                                  "ticker string, date date, adjusted_close double, volume double")
    return spreads, z, panel, s, px


def test_features_match_pandas(spark):
    spreads, z, panel, s, px = inputs(spark)
    out = pd.DataFrame(rows(X.build_features(spreads, z, panel, P, unique=True), "date")).set_index("date")
    s = pd.Series(s, index=DAYS)
    r = {t: pd.Series(px[t], index=DAYS).pct_change() for t in "ABM"}
    want = pd.DataFrame({
        "spread_lag_1": s.shift(1), "z_score_3_lag_1": (10 * s).shift(1),
        "spread_mean_3_lag_1": s.rolling(3).mean().shift(1), "spread_volatility_3_lag_1": s.rolling(3).std().shift(1),
        "spread_momentum_2_lag_1": s.diff(2).shift(1), "return_differential_lag_1": (r["A"] - r["B"]).shift(1),
        "return_correlation_3_lag_1": r["A"].rolling(3).corr(r["B"]).shift(1), "volume_ratio_lag_1": 1.0,
        "market_return_proxy_lag_1": r["M"].shift(1), "volatility_regime_3_lag_1": r["M"].rolling(3).std().shift(1),
        "target_next_day_spread": s.shift(-1), "target_next_day_spread_change": s.shift(-1) - s}).dropna()
    assert list(out.index) == list(want.index)
    for c in want:
        np.testing.assert_allclose(out[c].astype(float), want[c], rtol=1e-8, atol=1e-10)
    assert out["split"].value_counts().to_dict() == {"train": 35, "validation": 20, "test": 15, "holdout_2025": 15}


def test_a_later_shock_changes_no_earlier_feature(spark):
    made = X.feature_columns(P, True)
    spreads, z, panel, *_ = inputs(spark)
    shocked, zs, *_ = inputs(spark, shock=50.0)
    cut = F.col("date") < F.lit(DAYS[-1])
    a = rows(X.build_features(spreads, z, panel, P, unique=True).filter(cut).select("date", *made), "date")
    b = rows(X.build_features(shocked, zs, panel, P, unique=True).filter(cut).select("date", *made), "date")
    assert a == b and len(a) > 50


def test_lags_have_a_floor():
    assert replace(P, lags=(0, 2)).lags == (1, 2)
    with pytest.raises(ValueError):
        FeatureParams(lag_days=0)


def frame(spark, parts, extra=()):
    data, day = [], dt.date(2020, 1, 1)
    for split, values in parts:
        for v in values:
            data.append((day, day + dt.timedelta(days=1), "A-B", "A", "B", split, v, (v or 0.0) + 1,
                         *[f(len(data)) for f in extra]))
            day += dt.timedelta(days=1)
    names = ["date date", "target_date date", "pair_id string", "ticker_1 string", "ticker_2 string", "split string",
             "spread double", "target_next_day_spread double"] + [f"x{i} double" for i in range(len(extra))]
    return spark.createDataFrame(data, ", ".join(names))


def test_naive_and_rolling_mean(spark):
    df = frame(spark, [("train", [1.0, 2.0, 3.0]), ("validation", [100.0, 200.0]), ("test", [None, 9.0, 5.0])])
    assert [r["prediction"] for r in rows(M.naive_forecast(df, ForecastParams()), "feature_date")] == [
        100.0, 200.0, None, 9.0, 5.0]
    out = rows(M.rolling_mean_forecast(df, ForecastParams(rolling_window=3)), "feature_date")
    # The test split restarts from training; the unknown spread is not history.
    assert [r["prediction"] for r in out] == pytest.approx([2.0, 35.0, 2.0, 2.0, (2 + 3 + 9) / 3])
    assert {r["training_observation_count"] for r in out} == {3} and {r["training_split_source"] for r in out} == {"train"}
    both = ForecastParams(rolling_window=3, train_validation_for_test=True)
    out = [r for r in rows(M.rolling_mean_forecast(df, both), "feature_date") if r["split"] == "test"]
    assert out[0]["prediction"] == pytest.approx((3 + 100 + 200) / 3)
    assert (out[0]["training_observation_count"], out[0]["training_split_source"]) == (5, "train+validation")


def test_ar1_is_the_exact_likelihood_fit(spark):
    rng = np.random.default_rng(4)
    x = [2.0]
    for _ in range(79):
        x.append(2.0 + 0.7 * (x[-1] - 2.0) + rng.normal(0, 0.3))
    x = np.array(x)
    df = frame(spark, [("train", x.tolist()), ("validation", [0.0] * 3)])
    row = rows(M.ar1_parameters(df, ForecastParams()))[0]

    def loss(phi):
        cov = phi ** np.abs(np.subtract.outer(np.arange(80), np.arange(80))) / (1 - phi ** 2)
        inv, one = np.linalg.inv(cov), np.ones(80)
        mu = one @ inv @ x / (one @ inv @ one)
        e = x - mu
        return 80 * math.log(e @ inv @ e / 80) + np.linalg.slogdet(cov)[1], mu

    grid = np.linspace(row["phi"] - 0.01, row["phi"] + 0.01, 401)
    best = grid[np.argmin([loss(g)[0] for g in grid])]
    assert row["phi"] == pytest.approx(best, abs=6e-5)
    assert row["mean"] == pytest.approx(loss(row["phi"])[1], rel=1e-9)
    out = rows(M.arima_forecast(df, ForecastParams()), "feature_date")
    assert [r["prediction"] for r in out] == pytest.approx(
        [row["mean"] + row["phi"] ** h * (x[-1] - row["mean"]) for h in (1, 2, 3)])


def test_arima_falls_back_to_the_last_value(spark):
    df = frame(spark, [("train", [1.0, 4.0]), ("validation", [0.0, 0.0])])
    for order in ((1, 0, 0), (2, 1, 1)):
        assert [r["prediction"] for r in rows(M.arima_forecast(df, ForecastParams(arima_order=order)))] == [4.0, 4.0]


def test_differenced_order_continues_a_line(spark):
    df = frame(spark, [("train", [1.0 + 0.5 * i for i in range(30)]), ("test", [0.0] * 3)])
    out = rows(M.arima_forecast(df, ForecastParams(arima_order=(1, 1, 0))), "feature_date")
    assert [r["prediction"] for r in out] == pytest.approx([16.0, 16.5, 17.0])


def predictions(spark, data):
    return spark.createDataFrame(data, "model string, split string, spread double, prediction double, actual double")


def test_metrics(spark):
    df = predictions(spark, [("naive", "validation", 10.0, 11.0, 12.0), ("naive", "validation", 10.0, 12.0, 9.0),
                             ("naive", "validation", None, None, 3.0), ("late", "test", 1.0, None, 1.0)])
    out = {r["model"]: r for r in rows(M.forecast_metrics(df))}
    n = out["naive"]
    assert (n["rmse"], n["mae"], n["bias"], n["directional_accuracy"], n["observation_count"]) == pytest.approx(
        (math.sqrt(5), 2.0, -1.0, 0.5, 2))
    assert out["late"]["observation_count"] == 0 and out["late"]["rmse"] is None
    one = rows(M.forecast_metrics(predictions(spark, [("a", "test", 1.0, 1.5, 2.0)])))[0]
    assert one["prediction_correlation"] is None
    assert rows(M.forecast_metrics(df.drop("spread")).filter("model = 'naive'"))[0]["directional_accuracy"] is None


def test_selection_reads_validation_only(spark):
    df = spark.createDataFrame(
        [("a", "validation", 1.0), ("a", "test", 9.0), ("b", "validation", 2.0), ("b", "test", 0.1), ("c", "test", 0.0)],
        "model string, split string, rmse double").withColumns(
        {"mae": F.col("rmse"), "directional_accuracy": F.col("rmse")})
    p = ForecastParams()
    table = {r["model"]: (r["selected_by_validation"], r["selection_rank"]) for r in rows(M.compare_models(df, p))}
    assert table == {"a": (True, 1), "b": (False, 2), "c": (False, None)}
    comparison = M.compare_models(df, p)
    assert rows(M.resolve_model("best_validation", comparison, p)) == [{"model": "a"}]
    assert rows(M.resolve_model(" Named ", comparison, p)) == [{"model": "named"}]
    with pytest.raises(ValueError):
        ForecastParams(selection_split="test")


def test_fitted_inputs_fill_and_scale(spark):
    values = [1.0, None, 4.0, 7.0]
    df = frame(spark, [("train", [1.0, 2.0, 3.0, 4.0]), ("validation", [1.0])],
               extra=(lambda i: values[i] if i < 4 else 9.0, lambda i: None if i < 4 else 1.0))
    out = {r["column"]: r for r in rows(L.fitted_inputs(df, ForecastParams()))}
    filled = np.array([1.0, 4.0, 4.0, 7.0])
    assert set(out) == {"spread", "x0"}
    assert (out["x0"]["fill"], out["x0"]["mean"], out["x0"]["std"]) == pytest.approx((4.0, filled.mean(), filled.std()))


def test_sequences_continue_from_training(spark):
    df = frame(spark, [("train", [1.0, 2.0, 3.0]), ("validation", [4.0]), ("test", [5.0])])
    out = rows(L.sequences(df, ForecastParams(sequence_length=2, scale_features=False)), "for_split", "phase", "date")
    got = {s: [r["sequence"] for r in out if r["for_split"] == s] for s in ("validation", "test")}
    assert got == {"validation": [None, [1.0, 2.0], [2.0, 3.0], [3.0, 4.0]],
                   "test": [None, [1.0, 2.0], [2.0, 3.0], [3.0, 5.0]]}


def test_learned_forecasts_beat_the_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=120)
    parts = [("train", x[:80].tolist()), ("validation", x[80:100].tolist()), ("test", x[100:].tolist())]
    df = frame(spark, parts, extra=(lambda i: float(x[i] ** 2),))
    p = ForecastParams(trees=20, sequence_length=2)
    for out in (L.boosted_tree_forecast(df, p), L.sequence_forecast(df, p)):
        got = rows(out)
        assert len(got) == 40
        error = np.array([r["forecast_error"] for r in got])
        actual = np.array([r["actual"] for r in got])
        assert (error ** 2).mean() < 0.5 * actual.var()


# ------------------------------------------------------------------ likelihood of any order

def plain_likelihood(x, phi, theta, mean):
    """Minus twice the log likelihood (without constants) from the covariance matrix itself."""
    n, long = len(x), 2000
    psi = np.zeros(long)
    psi[0] = 1
    for t in range(1, long):
        psi[t] = (theta[t - 1] if t <= len(theta) else 0) + sum(f * psi[t - i - 1] for i, f in enumerate(phi) if t > i)
    gamma = np.array([psi[:long - k] @ psi[k:] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    root = np.linalg.cholesky(cov)
    y, one = np.linalg.solve(root, x), np.linalg.solve(root, np.ones(n))
    y = y - (one @ y) / (one @ one) * one if mean else y
    return n * math.log(y @ y / n) + 2 * np.log(np.diag(root)).sum()


@pytest.mark.parametrize("p, q", [(1, 0), (2, 0), (0, 1), (1, 1), (2, 2)])
def test_state_space_fit_is_the_best_of_a_grid(p, q):
    rng = np.random.default_rng(p * 3 + q)
    series = []
    for n in (60, 110, 85):
        e, x = rng.normal(size=n + 100), np.zeros(n + 100)
        for t in range(2, n + 100):
            x[t] = 0.6 * x[t - 1] - 0.2 * x[t - 2] + e[t] + 0.4 * e[t - 1]
        series.append(x[100:] * 3 + 7)
    arma = statespace.Arma(series, p, q, True)
    free = arma.fit()
    value = arma.filter(np.arange(3), free[None])[0][0]
    phi, theta = arma.model(free)
    for k, x in enumerate(series):
        z = (x - arma.shift[k]) / arma.scale[k]
        assert value[k] == pytest.approx(plain_likelihood(z, phi[k], theta[k], True), abs=1e-8)
    for size in (1e-3, 1e-2, 0.1, 0.5, 1.0):
        for _ in range(60):
            near = arma.filter(np.arange(3), (free + rng.normal(size=free.shape) * size)[None])[0][0]
            assert (near >= value - 1e-4).all()


def test_state_space_equals_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x = [2.0]
    for _ in range(79):
        x.append(2.0 + 0.7 * (x[-1] - 2.0) + rng.normal(0, 0.3))
    df = frame(spark, [("train", x), ("validation", [0.0] * 5)])
    closed = [r["prediction"] for r in rows(M.arima_forecast(df, ForecastParams()), "feature_date")]
    path = statespace.forecast_paths([np.array(x)], np.array([5]), (1, 0, 0))[0]
    assert path.tolist() == pytest.approx(closed, abs=1e-6)


def test_orders_of_a_batch_do_not_touch_each_other():
    rng = np.random.default_rng(9)
    series = [rng.normal(size=n).cumsum() for n in (30, 70, 4)] + [np.full(20, 3.0)]
    together = statespace.forecast_paths(series, np.array([2, 3, 1, 2]), (2, 1, 1))
    alone = [statespace.forecast_paths([s], np.array([h]), (2, 1, 1))[0] for s, h in zip(series, (2, 3, 1, 2))]
    assert [len(x) for x in together] == [2, 3, 1, 2] and together[3].tolist() == [3.0, 3.0]
    for a, b in zip(together, alone):
        assert a == pytest.approx(b, abs=1e-6)
    assert together[2].tolist() == [series[2][-1]]


# ------------------------------------------------------------------ boosted trees

def test_split_search_equals_brute_force():
    rng = np.random.default_rng(1)
    for penalties in ({}, {"l1": 0.7, "l2": 2.0}, {"split_price": 0.5, "least_weight": 8.0}):
        p = ForecastParams(**penalties)
        x, slope = rng.integers(0, 6, (80, 3)), rng.normal(size=80)
        g, h = np.zeros((3, 6)), np.zeros((3, 6))
        for f in range(3):
            np.add.at(g[f], x[:, f], slope)
            np.add.at(h[f], x[:, f], 1.0)

        def score(s):
            return max(abs(s.sum()) - p.l1, 0.0) ** 2 / (len(s) + p.l2)

        found = [((score(slope[x[:, f] < b]) + score(slope[x[:, f] >= b]) - score(slope)) / 2 - p.split_price, f, b)
                 for f in range(3) for b in range(1, 6)
                 if min((x[:, f] < b).sum(), (x[:, f] >= b).sum()) >= p.least_weight]
        best = max(found, key=lambda s: s[0])
        got = boosting.best_split(g, h, p)
        assert got is None if best[0] <= 0 else got[1:] == best[1:] and got[0] == pytest.approx(best[0])


def test_trees_equal_trees_grown_row_by_row(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 0] > 0.2, 2.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=300) * 0.1
    p = ForecastParams(trees=4, tree_depth=2, subsample=1.0, column_sample=1.0, learning_rate=0.5)
    train = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "inputs array<double>, label double")
    model = boosting.fit(train.repartition(3), 3, p, bins=16)
    bins = boosting.binned(x, model.cuts)
    made = np.full(300, y.mean())

    def leaf(some):
        return -0.5 * (made[some] - y[some]).sum() / (some.sum() + p.l2)

    def split(some):
        best = (1e-12, None, None)
        for f in range(3):
            for b in range(1, 16):
                left, right = some & (bins[:, f] < b), some & (bins[:, f] >= b)
                if left.sum() and right.sum():
                    s = [(made[k] - y[k]).sum() ** 2 / (k.sum() + p.l2) for k in (left, right, some)]
                    gain = (s[0] + s[1] - s[2]) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
        return best[1:]

    for _ in range(4):
        parts = [np.ones(300, bool)]
        for _ in range(2):
            parts = [half for some in parts for half in (split(some) if split(some)[0] is not None else [some])]
        step = np.zeros(300)
        for some in parts:
            step[some] = leaf(some)
        made = made + step
    assert model.predict(x) == pytest.approx(made, abs=1e-9)
    assert ((made - y) ** 2).mean() < 0.2 * y.var()


def test_draws_keep_their_share():
    p = ForecastParams(subsample=0.8)
    shares = [boosting._drawn(np.arange(20_000), t, p).mean() for t in range(3)]
    assert all(abs(s - 0.8) < 0.02 for s in shares)
    assert (boosting._drawn(np.arange(100), 0, p) != boosting._drawn(np.arange(100), 1, p)).any()


def jobs_of(spark, group, run):
    """What ``run()`` returns and how many jobs it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_level_of_a_tree_is_one_job(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(5000, 3))
    y = np.sin(3 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0)
    train = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "inputs array<double>, label double").repartition(3)
    p = ForecastParams(trees=27, tree_depth=2, learning_rate=0.2)
    _, few = jobs_of(spark, "few trees", lambda: boosting.fit(train, 3, replace(p, trees=7), bins=16))
    model, many = jobs_of(spark, "many trees", lambda: boosting.fit(train, 3, p, bins=16))
    assert many - few == 2 * 20 + 1  # and one that renews the sum of the trees
    assert np.mean((model.predict(x) - y) ** 2) < 0.3 * y.var()


# ------------------------------------------------------------------ recurrent cell

def test_a_round_of_the_recurrent_cell_is_one_job(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(5000, 3, 2))
    train = spark.createDataFrame([(v.reshape(-1).tolist(), float(v[1, 0])) for v in x], "sequence array<double>, label double")
    cell, p = Cell(2, 3), ForecastParams(sequence_length=3, rounds=12)
    _, few = jobs_of(spark, "few rounds", lambda: L.fit_recurrent(train, cell, replace(p, rounds=2)))
    (flat, centre, scale), many = jobs_of(spark, "many rounds", lambda: L.fit_recurrent(train, cell, p))
    assert many - few == 10
    y = x[:, 1, 0]
    assert (centre, scale) == pytest.approx((y.mean(), y.std()))
    assert np.mean((centre + scale * cell.predict(flat, x) - y) ** 2) < y.var()


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    cell = Cell(2, 3)
    flat = cell.initial(1) + rng.normal(size=cell.size) * 0.1
    x, y = rng.normal(size=(5, 4, 2)), rng.normal(size=5)
    loss, slope = cell.gradient(flat, x, y)
    assert loss == pytest.approx(((cell.predict(flat, x) - y) ** 2).sum())
    step = 1e-6
    for k in range(cell.size):
        up, down = flat.copy(), flat.copy()
        up[k] += step
        down[k] -= step
        assert slope[k] == pytest.approx((cell.gradient(up, x, y)[0] - cell.gradient(down, x, y)[0]) / (2 * step), abs=1e-5)


def test_recurrent_forecast_beats_linear_regression_and_reads_no_targets(spark):
    rng = np.random.default_rng(5)
    x = rng.choice([-1.0, 1.0], 700) + rng.normal(size=700) * 0.05
    spread = np.zeros(700)
    spread[2:] = x[1:-1] * x[:-2]  # tomorrow's spread is the product of the last two inputs
    parts = [("train", spread[:600].tolist()), ("validation", spread[600:].tolist())]
    df = frame(spark, parts, extra=(lambda i: float(x[i]),))
    p = ForecastParams(sequence_length=3, hidden_size=8, rounds=120, patience=40, recurrent_rate=0.03)
    errors = {}
    for name, make in (("recurrent", L.recurrent_forecast), ("linear", L.sequence_forecast)):
        got = [r for r in rows(make(df, p)) if r["forecast_error"] is not None]
        errors[name] = np.mean([r["forecast_error"] ** 2 for r in got])
    assert errors["recurrent"] < 0.4 * errors["linear"]
    few = replace(p, rounds=3)
    blind = df.withColumn(p.target, F.when(F.col("split") == "train", F.col(p.target)))
    seen, unseen = (rows(L.recurrent_forecast(d, few), "feature_date") for d in (df, blind))
    assert [r["prediction"] for r in seen] == pytest.approx([r["prediction"] for r in unseen], rel=1e-9)
    assert all(r["actual"] is None for r in unseen)


def test_recurrent_forecast_without_long_sequences(spark):
    df = frame(spark, [("train", [1.0, 2.0]), ("validation", [1.0])])
    out = rows(L.recurrent_forecast(df, ForecastParams(sequence_length=9, rounds=2)))
    assert [r["prediction"] for r in out] == [None]
