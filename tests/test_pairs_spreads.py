import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows, weekdays
from pairloom.functions.lagtest import unit_root, with_tau_p
from pairloom.functions.stats import exact_median
from pairloom.operators import pairs as P
from pairloom.operators import spreads as S
from pairloom.operators.panel import price_panel, price_vectors
from pairloom.operators.tiles import pair_moments
from pairloom.params import PairParams, Period, SpreadParams


def universe(spark, tickers):
    return spark.createDataFrame([(t, t, s, "x", v) for t, s, v in tickers],
                                 "ticker string, company_name string, sector string, industry string, "
                                 "average_daily_dollar_volume double")


def price_table(spark, series, days):
    return spark.createDataFrame(
        [(t, d, float(p), 1.0) for t, px in series.items() for d, p in zip(days, px) if p is not None],
        "ticker string, date date, adjusted_close double, volume double")


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_candidates_are_all_pairs_once(spark, blocks):
    names = [(f"T{i:02d}", "A" if i % 3 else "B", float(i)) for i in range(20)] + [("Z", " ", 1.0)]
    got = {r["pair_id"] for r in rows(P.candidate_pairs(universe(spark, names), True, blocks))}
    want = {f"{a[0]}-{b[0]}" for a, b in itertools.combinations(names[:-1], 2) if a[1] == b[1]}
    out = P.candidate_pairs(universe(spark, names), False, blocks)
    assert got == want and out.count() == 21 * 20 // 2


def test_pair_liquidity_needs_both(spark):
    out = P.candidate_pairs(universe(spark, [("A", "s", 5.0), ("B", "s", 3.0), ("C", "s", None)]))
    assert {r["pair_id"]: r["pair_liquidity"] for r in rows(out)} == {"A-B": 3.0, "A-C": None, "B-C": None}


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(3)
    days = weekdays("2020-01-01", 120)
    x = np.cumsum(rng.normal(0, 0.02, 120)) + 4
    y = 0.5 + 1.3 * x + rng.normal(0, 0.05, 120)
    a, b = [math.exp(v) for v in y], [math.exp(v) for v in x]
    a[7], b[20], b[21] = None, None, None
    period = Period(days[0], days[-1])
    prices = price_table(spark, {"A": a, "B": b}, days)
    pairs = spark.createDataFrame([("A-B", "A", "B")], ["pair_id", "ticker_1", "ticker_2"])
    vectors = price_vectors(price_panel(prices, period, unique=True), period)
    row = rows(P.pair_statistics(pairs, vectors, period))[0]
    keep = [i for i in range(120) if a[i] is not None and b[i] is not None]
    pa, pb = np.array([a[i] for i in keep]), np.array([b[i] for i in keep])
    la, lb = np.log(pa), np.log(pb)
    beta, alpha = np.polyfit(lb, la, 1)
    s = la - beta * lb
    design = np.column_stack([np.ones(len(s) - 1), s[:-1]])
    coef, *_ = np.linalg.lstsq(design, np.diff(s), rcond=None)
    err = np.diff(s) - design @ coef
    se = math.sqrt(err @ err / (len(err) - 2) * np.linalg.inv(design.T @ design)[1, 1])
    assert row["overlap_observations"] == len(keep)
    assert row["return_correlation"] == pytest.approx(np.corrcoef(pa[1:] / pa[:-1], pb[1:] / pb[:-1])[0, 1])
    assert (row["hedge_ratio_beta"], row["alpha"]) == pytest.approx((beta, alpha))
    assert row["df_statistic"] == pytest.approx(coef[1] / se)
    assert row["half_life_days"] == pytest.approx(-math.log(2) / coef[1])


def test_exact_fit_and_decay(spark):
    x = np.linspace(4, 5, 20)
    days = weekdays("2020-01-01", 100)
    decay = [10 * 0.8 ** i for i in range(100)]
    period = Period(days[0], days[-1])
    prices = price_table(spark, {"A": np.exp(0.7 + 1.4 * x), "B": np.exp(x), "D": np.exp(decay), "U": [1.0] * 99 + [1.01]}, days)
    pairs = spark.createDataFrame([("A-B", "A", "B"), ("D-U", "D", "U")], ["pair_id", "ticker_1", "ticker_2"])
    out = {r["pair_id"]: r for r in rows(P.pair_statistics(pairs, price_vectors(price_panel(prices, period, unique=True), period), period))}
    assert (out["A-B"]["alpha"], out["A-B"]["hedge_ratio_beta"]) == pytest.approx((0.7, 1.4))
    assert out["A-B"]["df_statistic"] == 0.0 and out["A-B"]["half_life_days"] is None
    assert 3 < out["D-U"]["half_life_days"] < 4


def test_benjamini_hochberg_small_and_tied(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.random(400) ** 6, 3).tolist() + [0.0] * 100 + [1.0] * 30 + [1e-200, 3e-9, 3e-9]
    df = spark.createDataFrame([(i, float(v), f) for f in "xy" for i, v in enumerate(values)]
                               + [(10_000, 0.01, "z"), (10_001, 0.04, "z"), (10_002, 0.03, "z"), (10_003, None, "z")],
                               "id int, p0 double, family string")
    out = rows(P.benjamini_hochberg(df, "p0", "adj", ("family",)), "family", "id")
    order = np.argsort(values, kind="stable")
    raw = np.array(values)[order] * len(values) / np.arange(1, len(values) + 1)
    want = np.empty(len(values))
    want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1.0)
    assert [r["adj"] for r in out if r["family"] == "x"] == pytest.approx(want.tolist())
    assert [r["adj"] for r in out if r["family"] == "z"] == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]


def plain_unit_root(x, const, max_lag=None):
    """Statistic and lags by one regression per lag length."""
    n, base = len(x), 2 if const else 1
    limit = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - base)
    if limit < 0:
        return None, None
    limit = limit if max_lag is None else min(limit, max_lag)
    dx = np.diff(x)

    def fit(first, lags):
        y = dx[first:]
        design = np.column_stack([x[first:-1], *[dx[first - k:len(dx) - k] for k in range(1, lags + 1)],
                                  *([np.ones(len(y))] if const else [])])
        coef, *_ = np.linalg.lstsq(design, y, rcond=None)
        err = y - design @ coef
        return y, design, coef, err @ err

    def aic(lags):
        y, design, _, rss = fit(limit, lags)
        return len(y) * math.log(rss / len(y)) + 2 * (base + lags)

    lags = min(range(limit + 1), key=aic)
    y, design, coef, rss = fit(lags, lags)
    if len(y) <= design.shape[1]:
        return None, lags
    return coef[0] / math.sqrt(rss / (len(y) - design.shape[1]) * np.linalg.inv(design.T @ design)[0, 0]), lags


@pytest.mark.parametrize("const", [True, False])
@pytest.mark.parametrize("max_lag", [None, 0, 2])
def test_unit_root_equals_plain_regressions(spark, const, max_lag):
    rng = np.random.default_rng(11)
    series = {}
    for i, n in enumerate((4, 7, 12, 20, 35, 80, 150, 400, 900)):
        x = np.cumsum(rng.normal(size=n)) * 0.3 + rng.normal(size=n)
        x = np.convolve(x, [1, 0.5, 0.3])[:n] if i % 2 else x
        series[f"p{n}"] = x - x.mean()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in series.items()], "pair_id string, s array<double>")
    got = {r["pair_id"]: r for r in rows(unit_root(df, const, 1000, max_lag))}
    for k, x in series.items():
        statistic, lags = plain_unit_root(x, const, max_lag)
        if statistic is None:
            assert k not in got or got[k]["statistic"] is None
        else:
            assert got[k]["lags"] == lags and got[k]["statistic"] == pytest.approx(statistic, rel=1e-8)


def test_unit_root_without_error_has_no_statistic(spark):
    df = spark.createDataFrame([("flat", [0.0] * 40), ("line", [float(i) for i in range(40)])], "pair_id string, s array<double>")
    assert all(r["statistic"] is None for r in rows(unit_root(df, True, 100)))


def test_lags_of_a_pair_and_an_exact_fit(spark):
    rng = np.random.default_rng(2)
    n = 120
    days = weekdays("2020-01-01", n)
    x = np.cumsum(rng.normal(0, 0.02, n)) + 4
    noise = np.zeros(n)
    for i in range(2, n):
        noise[i] = 0.9 * noise[i - 1] - 0.5 * noise[i - 2] + rng.normal(0, 0.05)
    a = np.exp(0.3 + 1.1 * x + noise)
    a[[5, 50]] = np.nan
    prices = price_table(spark, {"A": [None if math.isnan(v) else v for v in a], "B": np.exp(x), "C": np.exp(0.2 + 2 * x)}, days)
    listed = universe(spark, [("A", "s", 1.0), ("B", "s", 1.0), ("C", "s", 1.0)])
    p = PairParams(formation=Period(days[0], days[-1]), min_overlap_days=20, min_return_correlation=-1.0, variant="aic")
    out = {r["pair_id"]: r for r in rows(P.evaluate_candidates(P.candidate_pairs(listed), prices, p, unique=True, keep=("lags",)))}
    keep = ~np.isnan(a)
    beta, alpha = np.polyfit(x[keep], np.log(a[keep]), 1)
    statistic, lags = plain_unit_root(np.log(a[keep]) - alpha - beta * x[keep], False)
    got = out["A-B"]
    assert lags > 0 and (got["lags"], got["cointegration_test_statistic"]) == (lags, pytest.approx(statistic, rel=1e-8))
    exact = out["B-C"]
    assert exact["cointegration_test_statistic"] == -math.inf and exact["cointegration_pvalue_raw"] == 0.0


@pytest.mark.parametrize("block", [64, 2])
def test_tiles_equal_one_pair_at_a_time(spark, block):
    rng = np.random.default_rng(7)
    n = 40
    days = weekdays("2020-01-01", n)
    prices, names = {}, [f"T{i}" for i in range(9)]
    for k, name in enumerate(names):
        values = np.exp(np.cumsum(rng.normal(0, 0.05, n)))
        gaps = rng.choice(n, k // 3 * 6, replace=False)
        prices[name] = [None if i in gaps else float(v) for i, v in enumerate(values)]
    prices["NIL"] = [None] * n
    period = Period(days[0], days[-1])
    vectors = price_vectors(price_panel(price_table(spark, prices, days), period, unique=True), period)
    listed = [(f"{a}-{b}", a, b, "s", "s") for a, b in itertools.combinations([*names, "NIL"], 2)]
    pairs = spark.createDataFrame(listed, "pair_id string, ticker_1 string, ticker_2 string, sector_1 string, sector_2 string")
    out = {r["pair_id"]: r for r in rows(pair_moments(pairs, vectors, block))}
    assert len(out) == 36
    for a, b in itertools.combinations(names, 2):
        both = [(u, v) for u, v in zip(prices[a], prices[b]) if u is not None and v is not None]
        y, x = np.log(np.array(both)).T
        dy, dx = np.diff(y), np.diff(x)
        r = out[f"{a}-{b}"]
        assert (r["overlap_observations"], r["m_n"]) == (len(y), len(y) - 1)
        cov = lambda u, v: np.cov(u, v)[0, 1]
        want = {"mean_y": y.mean(), "mean_x": x.mean(), "v_x": cov(x, x), "c_yx": cov(y, x), "m_yy": cov(y[:-1], y[:-1]),
                "m_xx": cov(x[:-1], x[:-1]), "m_yx": cov(y[:-1], x[:-1]), "m_dyy": cov(dy, y[:-1]), "m_dyx": cov(dy, x[:-1]),
                "m_dxy": cov(dx, y[:-1]), "m_dxx": cov(dx, x[:-1]), "m_vdy": cov(dy, dy), "m_vdx": cov(dx, dx), "m_vdyx": cov(dy, dx),
                "r_yy": cov(np.expm1(dy), np.expm1(dy)), "r_xx": cov(np.expm1(dx), np.expm1(dx)), "r_yx": cov(np.expm1(dy), np.expm1(dx))}
        assert {k: r[k] for k in want} == {k: pytest.approx(v, rel=1e-9, abs=1e-13) for k, v in want.items()}


def test_response_surface_hits_known_critical_values(spark):
    df = spark.createDataFrame([(t,) for t in (-2.86, -3.34, 5.0, -30.0, None)], "t double")
    one, two = ([r["p"] for r in rows(with_tau_p(df, "t", "p", k))] for k in (1, 2))
    assert one[0] == pytest.approx(0.05, abs=0.002) and two[1] == pytest.approx(0.05, abs=0.003)
    assert one[2:] == [1.0, 0.0, None] and two[2:] == [1.0, 0.0, None]


def synthetic(spark, future=True):
    """A and B share a drifting log price and a decaying spread; then the link breaks."""
    n = 60
    days = weekdays("2020-01-01", n + 20)
    i = np.arange(n)
    base = 4 + np.cumsum(0.002 + 0.01 * np.sin(i / 5))
    rng = np.random.default_rng(1)
    series = {"AAA": np.exp(base + 0.005 * 0.8 ** i + rng.normal(0, 0.002, n)), "BBB": np.exp(base),
              "CCC": np.exp(4 + 0.08 * (-1.0) ** i)}
    if future:
        j = np.arange(20)
        series = {"AAA": np.append(series["AAA"], np.exp(4.3 + 0.03 * j)),
                  "BBB": np.append(series["BBB"], np.exp(4.8 - 0.04 * j)),
                  "CCC": np.append(series["CCC"], np.exp(4.1 + 0.02 * j))}
    p = PairParams(formation=Period(days[0], days[n - 1]), min_return_correlation=0.6, fdr_alpha=0.05,
                   half_life_min_days=0.1, half_life_max_days=60, top_n_pairs=5, min_overlap_days=40)
    return price_table(spark, series, days), p


@pytest.mark.parametrize("variant", ["df", "aic"])
def test_selection_finds_the_linked_pair_and_ignores_the_future(spark, variant):
    u = universe(spark, [(t, "Tech", 1e7) for t in ("AAA", "BBB", "CCC")] + [("DDD", "Tech", 1e7)])
    results = []
    for future in (False, True):
        prices, p = synthetic(spark, future)
        p = replace(p, variant=variant)
        evaluated = P.evaluate_candidates(P.candidate_pairs(u), prices, p, unique=True).cache()
        final = P.adjust_and_finalize(evaluated, p).cache()
        chosen = P.select_pairs(final, p)
        table = {r["pair_id"]: r for r in rows(P.final_diagnostics(final, chosen))}
        assert [r["pair_id"] for r in rows(chosen)] == ["AAA-BBB"]
        assert table["AAA-CCC"]["exclusion_reasons"] == "below_min_return_correlation"
        assert table["AAA-DDD"]["exclusion_reasons"] == "missing_processed_price_data"
        assert table["AAA-DDD"]["pair_liquidity"] is None
        results.append({k: (v["return_correlation"], v["cointegration_pvalue_adjusted"]) for k, v in table.items()})
    assert results[0] == results[1]


def test_ranked_below_top_n(spark):
    rows_ = [("A-B", 0.001, 0.9, 10.0, 1e8, True, ""), ("C-D", 0.04, 0.7, 50.0, 1e7, True, "")]
    df = spark.createDataFrame([(*r, dt.date(2020, 1, 1)) for r in rows_],
                               "pair_id string, cointegration_pvalue_adjusted double, return_correlation double, "
                               "half_life_days double, pair_liquidity double, selected boolean, "
                               "exclusion_reasons string, formation_end date")
    p = PairParams(top_n_pairs=1)
    chosen = P.select_pairs(df, p)
    row = rows(chosen)[0]
    assert row["pair_id"] == "A-B" and row["liquidity_score"] == 1.0
    assert row["selection_score"] == pytest.approx(
        0.4 * (1 - 0.001 / 0.05) + 0.25 * (0.3 / 0.4) + 0.25 * (1 - 21 / 29) + 0.1)
    out = {r["pair_id"]: r for r in rows(P.final_diagnostics(df, chosen))}
    assert out["C-D"]["exclusion_reasons"] == "ranked_below_top_n" and not out["C-D"]["selected"]


@pytest.mark.parametrize("variant", ["df", "aic"])
def test_spread_diagnostics(spark, variant):
    prices, pp = synthetic(spark)
    days = sorted(r["date"] for r in prices.select("date").distinct().collect())
    p = SpreadParams(formation=pp.formation, data=Period(days[0], days[-1]), windows=(3,), variant=variant)
    pairs = spark.createDataFrame([("AAA-BBB", "AAA", "BBB"), ("AAA-NIL", "AAA", "NIL")],
                                  ["pair_id", "ticker_1", "ticker_2"])
    vectors = price_vectors(price_panel(prices, p.data, unique=True), p.data)
    out = {r["pair_id"]: r for r in rows(S.spread_diagnostics(pairs, prices, vectors, p))}
    assert out["AAA-NIL"]["exclusion_reasons"] == "missing_processed_price_data"
    good = out["AAA-BBB"]
    assert (good["observations"], good["formation_observations"], good["missing_ratio"]) == (80, 60, 0.0)
    assert 0 <= good["adf_p_value_formation"] < 0.05
    series = rows(S.spread_series(S.spread_diagnostics(pairs, prices, vectors, p), vectors, p), "date")
    assert len(series) == 80
    inside = [r["spread"] for r in series[:60]]
    assert np.mean(inside) == pytest.approx(good["spread_mean_formation"])
    assert np.std(inside, ddof=1) == pytest.approx(good["spread_std_formation"])


def test_lagged_zscore_uses_rows_before_today(spark):
    days = weekdays("2020-01-01", 5)
    df = spark.createDataFrame([(d, "A-B", "A", "B", float(v)) for d, v in zip(days, (1, 2, 3, 4, 100))],
                               "date date, pair_id string, ticker_1 string, ticker_2 string, spread double")
    out = rows(S.lagged_zscores(df, (3,)), "date")
    assert [r["z_score"] for r in out[:3]] == [None] * 3
    assert (out[3]["rolling_mean_lagged"], out[3]["rolling_std_lagged"], out[3]["z_score"]) == (2.0, 1.0, 2.0)
    flat = df.withColumn("spread", F.lit(1.0))
    assert {r["z_score"] for r in rows(S.lagged_zscores(flat, (3,)))} == {None}


def test_exact_median_with_hot_values(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=5001), "b": np.append(np.full(3000, 1.5), rng.normal(size=4000)), "c": [3.0, 1.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("c", None)],
                               "k string, v double")
    got = {r["k"]: r["m"] for r in rows(exact_median(df, ["k"], "v", "m", margin=0.01))}
    assert got == {k: float(np.median(v)) for k, v in groups.items()}
