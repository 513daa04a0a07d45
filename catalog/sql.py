"""DuckDB twins of the research stages, as named SQL steps.

``compose("SELECT ... FROM step")`` puts the steps a statement needs in front of it.
The SQL follows the definitions directly (second passes, plain windows, recursive
state machines), not the plans of the Spark operators, so it is an independent check.
"""

from __future__ import annotations

import re

from .setup import DATA, SETTINGS, WALK
from pairloom.functions.stats import TAU
from pairloom.params import label_name
from pairloom.sources.driver import MARKET

S = SETTINGS
STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def compose(final: str) -> str:
    order: list[str] = []

    def visit(sql: str) -> None:
        # A step's name inside a text literal is not a mention of the step.
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", re.sub(r"'[^']*'", "''", sql)):
            if name in STEPS and name not in order and name not in stack:
                stack.append(name)
                visit(STEPS[name])
                stack.pop()
                if name not in order:
                    order.append(name)

    stack: list[str] = []
    visit(final)
    if not order:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in order) + "\n" + final


def d(value) -> str:
    return f"DATE '{value}'"


def between(column: str, period) -> str:
    return f"{column} BETWEEN {d(period.start)} AND {d(period.end)}"


def bdays(start: str, end: str) -> str:
    """Weekdays in a closed range, counted one by one."""
    return (f"len(list_filter(generate_series({start}::TIMESTAMP, {end}::TIMESTAMP, INTERVAL 1 DAY), "
            "lambda t: isodow(t) < 6))")


def erfc(x: str) -> str:
    """Complementary error function by its all-positive series (0 beyond 6)."""
    series = (f"list_sum(list_transform(range(0, 160), lambda k: exp(k * ln(4.0) + lgamma(k + 1.0) "
              f"- lgamma(2.0 * k + 2.0) + (2 * k + 1) * ln({x}))))")
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 6 THEN 0.0 WHEN {x} = 0 THEN 1.0 "
            f"ELSE 1.0 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {series} END")


def tau_p(t: str, series: int) -> str:
    """Response-surface p-value of a unit-root statistic."""
    row = TAU[series]

    def surface(powers) -> str:
        z = "(" + " + ".join(f"({c}) * ({t}) ** {k}" for k, c in enumerate(powers)) + ")"
        return (f"CASE WHEN {z} < 0 THEN 0.5 * ({erfc(f'(-{z} / sqrt(2.0))')}) "
                f"ELSE 1 - 0.5 * ({erfc(f'({z} / sqrt(2.0))')}) END")

    return (f"CASE WHEN {t} > {row['max']} THEN 1.0 WHEN {t} < {row['min']} THEN 0.0 "
            f"WHEN {t} <= {row['star']} THEN {surface(row['small'])} ELSE {surface(row['large'])} END")


# --------------------------------------------------------------------------- inputs

step("ship", """
 SELECT upper(trim(n_name)) AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity,
        l_extendedprice AS amount, l_extendedprice / l_quantity AS unit, l_discount, l_tax,
        l_orderkey, l_linenumber, l_partkey, l_suppkey
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 WHERE l_shipdate IS NOT NULL""")
step("ohlc", """
 SELECT ticker, date,
        arg_min(unit, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open,
        max(unit) AS high, min(unit) AS low,
        arg_max(unit, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close,
        sum(amount) / sum(quantity) AS adjusted_close, sum(quantity) AS volume
 FROM ship GROUP BY ticker, date""")
step("stocks", "SELECT ticker, date, sum(amount) / sum(quantity) AS adjusted_close, "
               "sum(quantity) AS volume FROM ship GROUP BY ticker, date")
step("prices", f"""
 SELECT ticker, date, adjusted_close, volume FROM stocks UNION ALL
 SELECT '{MARKET}', date, sum(adjusted_close * volume) / sum(volume), sum(volume) FROM stocks GROUP BY date""")
step("cons", """
 SELECT upper(trim(n_name)) AS ticker, n_name AS company_name, r_name AS sector, n_name AS industry,
        n_nationkey AS row_no FROM nation JOIN region ON n_regionkey = r_regionkey""")
step("vendor", """
 SELECT ticker, date, unit AS open, unit * 1.01 AS high,
        CASE WHEN l_discount > 0.095 THEN -1.0 ELSE unit * 0.99 END AS low, unit AS close,
        CASE WHEN l_tax > 0.075 THEN NULL ELSE unit END AS adjusted_close,
        CASE WHEN l_discount < 0.005 THEN 0.0 ELSE quantity END AS volume,
        l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ship""")
Q = S.quality
step("vendor_in", f"SELECT * FROM vendor WHERE {between('date', Q.period)}")
step("vendor_clean", """
 SELECT * FROM vendor_in QUALIFY row_number() OVER (PARTITION BY ticker, date
   ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""")
_exp = bdays(d(Q.period.start), d(Q.period.end))
step("vendor_counts", f"""
 SELECT ticker, count(DISTINCT date) AS row_count, min(date) AS start_date, max(date) AS end_date,
   count(*) FILTER (WHERE adjusted_close IS NULL) AS missing_adjusted_close,
   count(*) FILTER (WHERE volume = 0) AS zero_volume_days,
   count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR adjusted_close <= 0)
     AS non_positive_price_rows,
   count(*) FILTER (WHERE same > 1) AS duplicated_dates, {_exp} AS expected_observations
 FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS same FROM vendor_in) GROUP BY ticker""")
step("quality_report", f"""
 SELECT ticker, row_count, start_date, end_date, expected_observations,
   greatest(expected_observations - row_count, 0) AS missing_observations,
   greatest(expected_observations - row_count, 0) / expected_observations AS fraction,
   missing_adjusted_close, zero_volume_days, duplicated_dates, non_positive_price_rows,
   row_count < {Q.min_history_days} AS insufficient_history,
   fraction > {Q.max_missing_fraction} AS excessive_missing_observations,
   concat_ws('; ',
     CASE WHEN missing_adjusted_close > 0 THEN 'Adjusted close contains missing values.' END,
     CASE WHEN duplicated_dates > 0 THEN 'Duplicated dates detected.' END,
     CASE WHEN zero_volume_days > 0 THEN 'Zero volume days detected.' END,
     CASE WHEN non_positive_price_rows > 0 THEN 'Non-positive prices detected.' END,
     CASE WHEN insufficient_history THEN
       format('Only {{}} observations available; minimum is {Q.min_history_days}.', row_count) END,
     CASE WHEN fraction > {Q.max_missing_fraction} THEN
       printf('Missing observation fraction %.2f%% exceeds threshold {Q.max_missing_fraction:.2%}%.', 100 * fraction)
     END) AS issues,
   issues = '' AS valid, '' AS missing_ohlcv_columns FROM vendor_counts""")


def audit_steps(prefix: str, cons: str, prices: str, u) -> None:
    expected = bdays(d(u.period.start), d(u.period.end))
    step(f"{prefix}_metrics", f"""
 SELECT t.ticker, count(p.date) AS row_count, min(adjusted_close) AS min_adjusted_close,
   avg(adjusted_close * volume) AS average_daily_dollar_volume,
   count(*) FILTER (WHERE volume = 0) AS zero_volume_days, {expected} AS expected_observations,
   greatest({expected} - count(p.date), 0) / {expected} AS exact
 FROM (SELECT DISTINCT ticker FROM {prices}) t
 LEFT JOIN {prices} p ON p.ticker = t.ticker AND {between('p.date', u.period)} GROUP BY t.ticker""")
    step(f"{prefix}_numbered", f"""
 SELECT row_no + 2 AS row_number, upper(trim(ticker)) AS ticker, company_name, sector, industry,
   row_number() OVER (PARTITION BY upper(trim(ticker)) ORDER BY row_no) AS nth FROM {cons}""")
    step(f"{prefix}_audit", f"""
 SELECT n.row_number, n.ticker, company_name, sector, industry,
   concat_ws(';',
     CASE WHEN n.ticker = '' THEN 'empty_ticker' END,
     CASE WHEN n.ticker <> '' AND nth > 1 THEN 'duplicate_ticker' END,
     CASE WHEN n.ticker <> '' AND nth = 1 AND m.ticker IS NULL THEN 'missing_processed_price_data' END,
     CASE WHEN m.ticker IS NOT NULL AND coalesce(min_adjusted_close < {u.min_adjusted_close_price}, true)
       THEN 'below_min_adjusted_close_price' END,
     CASE WHEN m.ticker IS NOT NULL AND coalesce(average_daily_dollar_volume < {u.min_average_daily_dollar_volume}, true)
       THEN 'below_min_average_daily_dollar_volume' END,
     CASE WHEN exact > {u.max_missing_data_ratio} THEN 'excessive_missing_data_ratio' END,
     CASE WHEN zero_volume_days > {u.max_zero_volume_days} THEN 'zero_volume_issue' END,
     CASE WHEN row_count < {u.min_history_days} THEN 'insufficient_history' END) AS exclusion_reasons,
   exclusion_reasons = '' AS included,
   concat_ws(';', CASE WHEN trim(sector) = '' THEN 'missing_sector' END,
     CASE WHEN trim(industry) = '' THEN 'missing_industry' END) AS warnings,
   m.ticker IS NOT NULL AS has_price_data, coalesce(row_count, 0) AS row_count,
   coalesce(expected_observations, 0) AS expected_observations, round(exact, 6) AS missing_data_ratio,
   min_adjusted_close, average_daily_dollar_volume, zero_volume_days
 FROM {prefix}_numbered n LEFT JOIN {prefix}_metrics m
   ON m.ticker = n.ticker AND n.ticker <> '' AND nth = 1""")


audit_steps("main", "cons", "prices", S.universe)
step("universe", "SELECT * FROM main_audit WHERE included")

# --------------------------------------------------------------------------- pairs


def candidate_sql(universe: str, same_sector: bool) -> str:
    on = "trim(a.sector) = trim(b.sector) AND trim(a.sector) <> '' AND" if same_sector else ""
    return f"""
 SELECT a.ticker || '-' || b.ticker AS pair_id, a.ticker AS ticker_1, b.ticker AS ticker_2,
   a.sector AS sector_1, b.sector AS sector_2, a.industry AS industry_1, b.industry AS industry_2,
   a.company_name AS company_name_1, b.company_name AS company_name_2,
   CASE WHEN a.average_daily_dollar_volume IS NOT NULL AND b.average_daily_dollar_volume IS NOT NULL
     THEN least(a.average_daily_dollar_volume, b.average_daily_dollar_volume) END AS pair_liquidity
 FROM {universe} a JOIN {universe} b ON {on} a.ticker < b.ticker"""


PP = S.pairs
step("candidates", candidate_sql("universe", True))
step("formation_rows", f"""
 SELECT c.pair_id, a.date, a.adjusted_close AS p1, b.adjusted_close AS p2
 FROM candidates c JOIN prices a ON a.ticker = c.ticker_1
 JOIN prices b ON b.ticker = c.ticker_2 AND b.date = a.date
 WHERE {between('a.date', PP.formation)} AND a.adjusted_close > 0 AND b.adjusted_close > 0""")
step("formation_returns", """
 SELECT pair_id, p1 / lag(p1) OVER w - 1 AS r1, p2 / lag(p2) OVER w - 1 AS r2, ln(p1) AS y, ln(p2) AS x, date
 FROM formation_rows WINDOW w AS (PARTITION BY pair_id ORDER BY date)""")
step("pair_fit", """
 SELECT pair_id, count(*) AS n, corr(r1, r2) AS rho, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha
 FROM formation_returns GROUP BY pair_id""")
step("pair_residuals", """
 SELECT pair_id, s - lag(s) OVER w AS ds, lag(s) OVER w AS s1 FROM (
   SELECT r.pair_id, date, y - beta * x AS s FROM formation_returns r JOIN pair_fit USING (pair_id))
 WINDOW w AS (PARTITION BY pair_id ORDER BY date)""")


def dickey_fuller(rows: str) -> str:
    return f"""
 SELECT pair_id, regr_slope(ds, s1) AS gamma, count(ds) AS m,
   regr_slope(ds, s1) / sqrt((regr_syy(ds, s1) - regr_slope(ds, s1) * regr_sxy(ds, s1))
     / (count(ds) - 2) / regr_sxx(ds, s1)) AS t
 FROM {rows} WHERE s1 IS NOT NULL GROUP BY pair_id"""


step("pair_df", dickey_fuller("pair_residuals"))


def orthogonal(rows: str, names: list[str], free: list[str], const: bool) -> str:
    """``names`` in turn freed of all named before them, row by row; ``free`` of all of ``names``."""
    every = [*names, *free]
    shown = ", ".join(f"{c} - avg({c}) OVER p AS {c}" if const else c for c in every)
    sql = f"SELECT pair_id, {shown} FROM ({rows}) WINDOW p AS (PARTITION BY pair_id)"
    for k, name in enumerate(names):
        freed = ", ".join(f"{c} - {name} * (sum({c} * {name}) OVER p / sum({name} * {name}) OVER p) AS {c}" for c in every[k + 1:])
        sql = f"SELECT pair_id, {', '.join(names[:k + 1])}, {freed} FROM ({sql}) WINDOW p AS (PARTITION BY pair_id)"
    return sql


def lag_test(series: str, most: int, const: bool) -> str:
    """pair_id, lags and stat of the unit-root test of (pair_id, date, s) with up to ``most`` lags."""
    base = 2 if const else 1
    steps = (f"SELECT pair_id, date, s - lag(s) OVER w AS d0, lag(s) OVER w AS lev FROM {series} "
             "WINDOW w AS (PARTITION BY pair_id ORDER BY date)")
    lagged = "".join(f", lag(d0, {k}) OVER w AS d{k}" for k in range(1, most + 1))
    rows = f"SELECT *{lagged} FROM ({steps}) WINDOW w AS (PARTITION BY pair_id ORDER BY date)"
    scored, tested = [], []
    for k in range(most + 1):
        ds = [f"d{j}" for j in range(1, k + 1)]
        common = orthogonal(f"SELECT * FROM ({rows}) WHERE d{most} IS NOT NULL", ["lev", *ds], ["d0"], const)
        scored.append(f"SELECT pair_id, {k} AS lags, count(*) * ln(sum(d0 * d0) / count(*)) + {2 * (k + base)} AS aic "
                      f"FROM ({common}) GROUP BY pair_id")
        own = orthogonal(f"SELECT * FROM ({rows}) WHERE d{k} IS NOT NULL", ds, ["lev", "d0"], const)
        tested.append(f"SELECT pair_id, {k} AS lags, sum(lev * d0) / sqrt((sum(d0 * d0) - sum(lev * d0) ** 2 / sum(lev * lev)) "
                      f"/ (count(*) - {k + base}) * sum(lev * lev)) AS stat FROM ({own}) GROUP BY pair_id")
    chosen = f"SELECT pair_id, arg_min(lags, (aic, lags)) AS lags FROM ({' UNION ALL '.join(scored)}) GROUP BY pair_id"
    return f"SELECT * FROM ({chosen}) JOIN ({' UNION ALL '.join(tested)}) USING (pair_id, lags)"


step("pair_residual_series", """
 SELECT pair_id, date, e - avg(e) OVER (PARTITION BY pair_id) AS s FROM (
   SELECT r.pair_id, date, y - beta * x AS e FROM formation_returns r JOIN pair_fit USING (pair_id))""")
step("evaluated", f"""
 SELECT c.*, {d(PP.formation.start)} AS formation_start, {d(PP.formation.end)} AS formation_end,
   sector_1 = sector_2 AS same_sector_pair, coalesce(n, 0) AS overlap_observations,
   rho AS return_correlation,
   concat_ws(';', CASE WHEN coalesce(n, 0) < {PP.min_overlap_days} THEN 'insufficient_overlapping_history' END,
     CASE WHEN rho IS NULL THEN 'missing_return_correlation'
          WHEN rho < {PP.min_return_correlation} THEN 'below_min_return_correlation' END) AS exclusion_reasons,
   exclusion_reasons = '' AS passes_correlation_filter,
   CASE WHEN passes_correlation_filter THEN {erfc('abs(t) / sqrt(2.0)')} END AS cointegration_pvalue_raw,
   CASE WHEN passes_correlation_filter THEN t END AS cointegration_test_statistic,
   CASE WHEN passes_correlation_filter THEN beta END AS hedge_ratio_beta,
   CASE WHEN passes_correlation_filter AND gamma < 0 THEN -ln(2) / gamma END AS half_life_days
 FROM candidates c LEFT JOIN pair_fit USING (pair_id) LEFT JOIN pair_df USING (pair_id)""")
step("corrected", """
 SELECT *, min(least(p * total / rank, 1.0)) OVER (ORDER BY p DESC, pair_id DESC
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted FROM (
   SELECT pair_id, cointegration_pvalue_raw AS p, count(*) OVER () AS total,
     row_number() OVER (ORDER BY cointegration_pvalue_raw, pair_id) AS rank
   FROM evaluated WHERE passes_correlation_filter)""")
step("finalized", f"""
 SELECT e.* EXCLUDE (exclusion_reasons), adjusted AS cointegration_pvalue_adjusted,
   concat_ws(';', nullif(e.exclusion_reasons, ''),
     CASE WHEN passes_correlation_filter AND coalesce(adjusted > {PP.fdr_alpha}, true)
       THEN 'cointegration_fdr_not_significant' END,
     CASE WHEN passes_correlation_filter AND half_life_days IS NULL THEN 'missing_half_life'
          WHEN passes_correlation_filter AND (half_life_days < {PP.half_life_min_days}
            OR half_life_days > {PP.half_life_max_days}) THEN 'half_life_out_of_range' END) AS exclusion_reasons
 FROM evaluated e LEFT JOIN corrected USING (pair_id)""")
_mid = (PP.half_life_min_days + PP.half_life_max_days) / 2
_half = max((PP.half_life_max_days - PP.half_life_min_days) / 2, 1.0)


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


step("scored", f"""
 SELECT *, {clip(f'1 - cointegration_pvalue_adjusted / {PP.fdr_alpha}')} AS p_value_score,
   {clip(f'(return_correlation - ({PP.min_return_correlation})) / (1 - ({PP.min_return_correlation}))')} AS correlation_score,
   {clip(f'1 - abs(half_life_days - {_mid}) / {_half}')} AS half_life_score,
   {clip('ln(1 + pair_liquidity) / max(ln(1 + pair_liquidity)) OVER ()')} AS liquidity_score,
   0.4 * p_value_score + 0.25 * correlation_score + 0.25 * half_life_score + 0.1 * liquidity_score
     AS selection_score
 FROM finalized WHERE exclusion_reasons = ''""")
step("selected", f"""
 SELECT * FROM scored ORDER BY selection_score DESC, cointegration_pvalue_adjusted,
   return_correlation DESC, pair_id LIMIT {PP.top_n_pairs}""")
step("diagnostics", """
 SELECT f.* EXCLUDE (exclusion_reasons), s.pair_id IS NOT NULL AS selected,
   CASE WHEN f.exclusion_reasons = '' AND s.pair_id IS NULL THEN 'ranked_below_top_n'
        ELSE f.exclusion_reasons END AS exclusion_reasons
 FROM finalized f LEFT JOIN (SELECT pair_id FROM selected) s USING (pair_id)""")

# --------------------------------------------------------------------------- spreads

SP = S.spreads
step("pair_rows", f"""
 SELECT c.pair_id, c.ticker_1, c.ticker_2, a.date, a.adjusted_close AS adjusted_close_1,
   b.adjusted_close AS adjusted_close_2, ln(a.adjusted_close) AS log_price_1, ln(b.adjusted_close) AS log_price_2,
   {between('a.date', SP.formation)} AS inside
 FROM selected c JOIN prices a ON a.ticker = c.ticker_1
 JOIN prices b ON b.ticker = c.ticker_2 AND b.date = a.date WHERE {between('a.date', SP.data)}""")
step("spread_fit", """
 SELECT pair_id, regr_slope(log_price_1, log_price_2) AS beta, regr_intercept(log_price_1, log_price_2) AS alpha
 FROM pair_rows WHERE inside GROUP BY pair_id""")
step("spreads", """
 SELECT r.* EXCLUDE (inside), alpha, beta, log_price_1 - beta * log_price_2 AS spread, inside
 FROM pair_rows r JOIN spread_fit USING (pair_id)""")
step("spread_changes", """
 SELECT pair_id, spread - lag(spread) OVER w AS ds, lag(spread) OVER w AS s1
 FROM spreads WHERE inside WINDOW w AS (PARTITION BY pair_id ORDER BY date)""")
step("spread_df", dickey_fuller("spread_changes"))
step("formation_spreads", "SELECT pair_id, date, spread AS s FROM spreads WHERE inside")
step("spread_diagnostics", f"""
 SELECT s.pair_id, any_value(ticker_1) AS ticker_1, any_value(ticker_2) AS ticker_2,
   any_value(beta) AS beta, any_value(alpha) AS alpha,
   avg(spread) FILTER (WHERE inside) AS spread_mean_formation,
   stddev_samp(spread) FILTER (WHERE inside) AS spread_std_formation,
   any_value({erfc('abs(t) / sqrt(2.0)')}) AS adf_p_value_formation,
   any_value(CASE WHEN gamma < 0 THEN -ln(2) / gamma END) AS half_life_formation,
   count(*) AS observations, count(*) FILTER (WHERE inside) AS formation_observations,
   greatest({bdays('min(date)', 'max(date)')} - count(*), 0) / {bdays('min(date)', 'max(date)')} AS missing_ratio
 FROM spreads s JOIN spread_df USING (pair_id) GROUP BY s.pair_id""")
_z = []
for _w in SP.windows:
    _z.append(f"""
 SELECT date, pair_id, ticker_1, ticker_2, {_w} AS z_score_window, spread,
   CASE WHEN count(spread) OVER f = {_w} THEN avg(spread) OVER f END AS rolling_mean_lagged,
   CASE WHEN count(spread) OVER f = {_w} THEN stddev_samp(spread) OVER f END AS rolling_std_lagged
 FROM spreads WINDOW f AS (PARTITION BY pair_id ORDER BY date ROWS BETWEEN {_w} PRECEDING AND 1 PRECEDING)""")
step("zrows", " UNION ALL ".join(_z))
step("zscores", "SELECT * EXCLUDE (spread), (spread - rolling_mean_lagged) / nullif(rolling_std_lagged, 0) "
                "AS z_score FROM zrows")

# --------------------------------------------------------------------------- features

FP = S.features
_zw, _mw, _vw, _mo, _cw, _rw = (FP.z_score_windows[0], FP.spread_mean_windows[0], FP.spread_volatility_windows[0],
                                FP.momentum_windows[0], FP.correlation_windows[0], FP.volatility_regime_window)
step("proxy", f"SELECT date, adjusted_close FROM prices WHERE ticker = '{MARKET}'")
step("proxy_returns", """
 SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS market_return FROM (
   SELECT date, last_value(adjusted_close IGNORE NULLS) OVER (ORDER BY date) AS px
   FROM (SELECT DISTINCT date FROM prices) LEFT JOIN proxy USING (date))""")
step("feature_input", f"""
 SELECT s.pair_id, s.ticker_1, s.ticker_2, s.date, s.spread, z.z_score, a.volume / nullif(b.volume, 0) AS vr,
   a.adjusted_close / lag(a.adjusted_close) OVER w - 1 AS r1,
   b.adjusted_close / lag(b.adjusted_close) OVER w - 1 AS r2, m.market_return,
   lead(s.date) OVER w AS target_date, lead(s.spread) OVER w AS target_next_day_spread
 FROM spreads s JOIN prices a ON a.ticker = s.ticker_1 AND a.date = s.date
 JOIN prices b ON b.ticker = s.ticker_2 AND b.date = s.date
 LEFT JOIN zscores z ON z.pair_id = s.pair_id AND z.date = s.date AND z.z_score_window = {_zw}
 LEFT JOIN proxy_returns m ON m.date = s.date WINDOW w AS (PARTITION BY s.pair_id ORDER BY s.date)""")


def guarded(fn: str, count: str, frame: str, w: int) -> str:
    return f"CASE WHEN count({count}) OVER {frame} = {w} THEN {fn} OVER {frame} END"


_split = "CASE " + " ".join(f"WHEN {between('target_date', p)} THEN '{n}'" for n, p in WALK.named()) + " END"
step("feature_rows", f"""
 SELECT date, pair_id, ticker_1, ticker_2, spread, target_date, target_next_day_spread,
   target_next_day_spread - spread AS target_next_day_spread_change,
   lag(spread, 1) OVER w AS spread_lag_1, lag(z_score, 1) OVER w AS z_score_{_zw}_lag_1,
   {guarded('avg(spread)', 'spread', 'fm', _mw)} AS spread_mean_{_mw}_lag_1,
   {guarded('stddev_samp(spread)', 'spread', 'fv', _vw)} AS spread_volatility_{_vw}_lag_1,
   lag(spread, 1) OVER w - lag(spread, {1 + _mo}) OVER w AS spread_momentum_{_mo}_lag_1,
   lag(r1 - r2, 1) OVER w AS return_differential_lag_1,
   CASE WHEN count(r1 + r2) OVER fc = {_cw} THEN corr(r1, r2) OVER fc END AS return_correlation_{_cw}_lag_1,
   lag(vr, 1) OVER w AS volume_ratio_lag_1, lag(market_return, 1) OVER w AS market_return_proxy_lag_1,
   {guarded('stddev_samp(market_return)', 'market_return', 'fr', _rw)} AS volatility_regime_{_rw}_lag_1,
   {_split} AS split
 FROM feature_input WINDOW w AS (PARTITION BY pair_id ORDER BY date),
   fm AS (PARTITION BY pair_id ORDER BY date ROWS BETWEEN {_mw} PRECEDING AND 1 PRECEDING),
   fv AS (PARTITION BY pair_id ORDER BY date ROWS BETWEEN {_vw} PRECEDING AND 1 PRECEDING),
   fc AS (PARTITION BY pair_id ORDER BY date ROWS BETWEEN {_cw} PRECEDING AND 1 PRECEDING),
   fr AS (PARTITION BY pair_id ORDER BY date ROWS BETWEEN {_rw} PRECEDING AND 1 PRECEDING)""")
FEATURES = ["spread_lag_1", f"z_score_{_zw}_lag_1", f"spread_mean_{_mw}_lag_1", f"spread_volatility_{_vw}_lag_1",
            f"spread_momentum_{_mo}_lag_1", "return_differential_lag_1", f"return_correlation_{_cw}_lag_1",
            "volume_ratio_lag_1", "market_return_proxy_lag_1", f"volatility_regime_{_rw}_lag_1"]
TARGETS = ["target_next_day_spread", "target_next_day_spread_change"]
step("features", "SELECT * FROM feature_rows WHERE split IS NOT NULL AND "
     + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES + TARGETS))

# --------------------------------------------------------------------------- forecasts

MP = S.forecasts
EVAL = "('validation', 'test', 'holdout_2025')"
step("train", "SELECT * FROM features WHERE split = 'train'")
step("eval_rows", f"SELECT * FROM features WHERE split IN {EVAL}")
step("naive", "SELECT *, spread AS prediction, 'naive' AS model FROM eval_rows")
step("history", """
 SELECT pair_id, split, date, 1 AS phase, spread FROM eval_rows UNION ALL
 SELECT t.pair_id, s.split, t.date, 0, t.spread FROM train t
 CROSS JOIN (SELECT unnest(['validation', 'test', 'holdout_2025']) AS split) s""")
_k = MP.rolling_window
step("rolling", f"""
 SELECT e.*, h.prediction, 'rolling_mean' AS model FROM eval_rows e JOIN (
   SELECT pair_id, split, date, phase, CASE WHEN count(spread) OVER f = {_k} THEN avg(spread) OVER f END AS prediction
   FROM history WINDOW f AS (PARTITION BY pair_id, split ORDER BY phase, date
     ROWS BETWEEN {_k} PRECEDING AND 1 PRECEDING)) h
 ON h.pair_id = e.pair_id AND h.split = e.split AND h.date = e.date AND h.phase = 1""")
step("ar_rows", """
 SELECT pair_id, date, spread - avg(spread) OVER (PARTITION BY pair_id) AS c,
   avg(spread) OVER (PARTITION BY pair_id) AS m, spread FROM train""")
step("ar_lagged", "SELECT *, lag(c) OVER (PARTITION BY pair_id ORDER BY date) AS c1 FROM ar_rows")
step("ar_sums", """
 SELECT pair_id, count(*)::DOUBLE AS n, any_value(m) AS m, sum(c * c) AS q, sum(c * c1) AS l,
   arg_min(c, date) AS a, arg_max(c, date) AS b, arg_max(spread, date) AS last FROM ar_lagged GROUP BY pair_id""")
_mu = "(phi * (a + b) / ((1 + phi) + (n - 1) * (1 - phi)))"
step("ar_search", f"""
 SELECT pair_id, n, m, q, l, a, b, last, -1 + 1e-9 AS lo, 1 - 1e-9 AS hi, 0 AS i FROM ar_sums
 UNION ALL
 SELECT pair_id, n, m, q, l, a, b, last, CASE WHEN slope < 0 THEN phi ELSE lo END,
   CASE WHEN slope < 0 THEN hi ELSE phi END, i + 1
 FROM (SELECT *, n * 2 * (phi * (early - (a - mu) ** 2) - cross_) / ((1 - phi ** 2) * (a - mu) ** 2 + late
         - 2 * phi * cross_ + phi ** 2 * early) + 2 * phi / (1 - phi ** 2) AS slope
   FROM (SELECT *, l + mu * (a + b) + (n - 1) * mu ** 2 AS cross_, q - b ** 2 + 2 * mu * b + (n - 1) * mu ** 2 AS early,
           q - a ** 2 + 2 * mu * a + (n - 1) * mu ** 2 AS late
     FROM (SELECT *, {_mu} AS mu FROM (SELECT *, (lo + hi) / 2 AS phi FROM ar_search WHERE i < 64))))""")
step("ar_fit", f"SELECT *, m + {_mu} AS mean FROM (SELECT *, (lo + hi) / 2 AS phi FROM ar_search WHERE i = 64)")
step("arima", """
 SELECT e.* EXCLUDE (h), mean + phi ** h * (last - mean) AS prediction, 'arima' AS model
 FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, split ORDER BY date) AS h FROM eval_rows) e
 JOIN ar_fit USING (pair_id)""")


def prediction_sql(source: str) -> str:
    return f"""
 SELECT pair_id, ticker_1, ticker_2, model, date AS feature_date, target_date, split, prediction,
   target_next_day_spread AS actual, target_next_day_spread - prediction AS forecast_error,
   'train' AS training_split_source, (SELECT count(*) FROM train) AS training_observation_count, spread
 FROM {source}"""


step("predictions", " UNION ALL ".join(prediction_sql(s) for s in ("naive", "rolling", "arima")))
step("metrics", """
 SELECT model, split, sqrt(avg((actual - prediction) ** 2)) AS rmse, avg(abs(actual - prediction)) AS mae,
   avg(CASE WHEN sign(actual - spread) = sign(prediction - spread) THEN 1.0 ELSE 0.0 END) AS directional_accuracy,
   corr(prediction, actual) AS prediction_correlation, avg(actual - prediction) AS bias,
   count(*) AS observation_count
 FROM predictions WHERE prediction IS NOT NULL AND actual IS NOT NULL GROUP BY model, split""")
step("model_ranks", """
 SELECT model, row_number() OVER (ORDER BY rmse, model) AS selection_rank
 FROM metrics WHERE split = 'validation' AND rmse IS NOT NULL""")
step("comparison", "SELECT m.model, " + ", ".join(
    f"max({c}) FILTER (WHERE split = '{s}') AS {s}_{c}"
    for s in ("validation", "test", "holdout_2025") for c in ("rmse", "mae", "directional_accuracy"))
    + """, coalesce(any_value(selection_rank) = 1, false) AS selected_by_validation,
   any_value(selection_rank) AS selection_rank
 FROM metrics m LEFT JOIN model_ranks r ON r.model = m.model GROUP BY m.model""")
step("best_model", "SELECT model FROM model_ranks WHERE selection_rank = 1")

# --------------------------------------------------------------------------- signals and backtest

GP, BP = S.signals, S.backtest
step("base_runs", "SELECT 'base' AS run_id, unnest([" + ", ".join(f"'{m}'" for m in S.traded) + f"]) AS model, "
     f"{GP.entry_z}::DOUBLE AS entry_z, {GP.exit_z}::DOUBLE AS exit_z, {GP.stop_loss_z}::DOUBLE AS stop_loss_z, "
     f"{GP.max_holding_days} AS max_holding_days, {GP.z_score_window} AS z_score_window")
step("base_costs", f"SELECT 'base' AS scenario_id, 'base' AS run_id, {BP.commission_bps}::DOUBLE AS commission_bps, "
                   f"{BP.slippage_bps}::DOUBLE AS slippage_bps, {BP.borrow_cost_bps}::DOUBLE AS borrow_bps")
RP = S.robustness
step("grid", "SELECT *, 'scenario_' || substr(sha1(payload), 1, 12) AS scenario_id FROM (SELECT *, "
     "'{\"commission_bps\":' || commission_bps || ',\"entry_z\":' || entry_z || ',\"exit_z\":' || exit_z "
     "|| ',\"signal_model\":\"' || signal_model || '\",\"slippage_bps\":' || slippage_bps || ',\"stop_loss_z\":' "
     "|| stop_loss_z || ',\"zscore_window\":' || zscore_window || '}' AS payload FROM (VALUES "
     + ", ".join(
         f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE, {g}, '{h}')" for a, b, c, e, f, g, h in [
             (a, b, c, e, f, g, h) for a in RP.entry_z_values for b in RP.exit_z_values for c in RP.stop_loss_z_values
             for e in RP.commission_bps_values for f in RP.slippage_bps_values for g in RP.zscore_window_values
             for h in RP.signal_model_values])
     + ") v(entry_z, exit_z, stop_loss_z, commission_bps, slippage_bps, zscore_window, signal_model))")
step("resolved", """
 SELECT *, concat_ws('|', entry_z, exit_z, stop_loss_z, zscore_window, model) AS run_id FROM (
   SELECT *, CASE WHEN signal_model = 'best_validation' THEN (SELECT model FROM best_model) ELSE signal_model END
     AS model FROM grid)""")
step("sweep_runs", f"SELECT DISTINCT run_id, model, entry_z, exit_z, stop_loss_z, {GP.max_holding_days} "
                   "AS max_holding_days, zscore_window AS z_score_window FROM resolved")
step("sweep_costs", f"SELECT scenario_id, run_id, commission_bps, slippage_bps, {BP.borrow_cost_bps}::DOUBLE "
                    "AS borrow_bps FROM resolved")
step("ratios", """
 SELECT pair_id, CASE WHEN beta > 0 AND isfinite(beta) THEN beta ELSE 1.0 END AS hedge_ratio_beta
 FROM spread_diagnostics""")
step("legs", "SELECT pair_id, date, adjusted_close_1 AS p1, adjusted_close_2 AS p2 FROM pair_rows")
step("leg_dates", f"""SELECT DISTINCT date FROM prices WHERE {between('date', DATA)} AND ticker IN (
   SELECT ticker_1 FROM selected UNION SELECT ticker_2 FROM selected)""")
_budget = BP.initial_capital / BP.max_active_pairs


def backtest_steps(x: str) -> None:
    """Signals, admission, trades and daily tables of the runs in ``{x}_runs``."""
    step(f"{x}_input", f"""
 SELECT r.*, p.pair_id, p.ticker_1, p.ticker_2, feature_date, target_date, split,
   coalesce(s.spread, p.spread) AS current_spread, prediction AS predicted_spread,
   coalesce(z.z_score, (coalesce(s.spread, p.spread) - rolling_mean_lagged) / nullif(rolling_std_lagged, 0))
     AS current_zscore,
   (prediction - rolling_mean_lagged) / nullif(rolling_std_lagged, 0) AS predicted_zscore,
   row_number() OVER (PARTITION BY run_id, r.model, p.pair_id ORDER BY feature_date, target_date) AS rn
 FROM predictions p JOIN {x}_runs r ON r.model = p.model
 LEFT JOIN spreads s ON s.pair_id = p.pair_id AND s.date = feature_date
 LEFT JOIN zscores z ON z.pair_id = p.pair_id AND z.date = feature_date AND z.z_score_window = r.z_score_window
 WHERE split IN {EVAL}""")
    act = """CASE
       WHEN {s} = 'flat' THEN CASE WHEN predicted_zscore > entry_z THEN 'enter_short_spread'
            WHEN predicted_zscore < -entry_z THEN 'enter_long_spread' ELSE 'no_action' END
       WHEN abs(current_zscore) > stop_loss_z THEN 'stop_loss'
       WHEN abs(current_zscore) < exit_z THEN 'exit'
       WHEN {h} + 1 > max_holding_days THEN 'force_exit_max_holding' ELSE 'hold_' || {s} END"""
    after = ("CASE WHEN action IN ('stop_loss', 'exit', 'force_exit_max_holding', 'no_action') THEN 'flat' "
             "ELSE regexp_replace(action, '^(enter|hold)_', '') END")
    step(f"{x}_walk", f"""
 SELECT run_id, model, pair_id, rn, action, {after} AS state, 0 AS held, 0 AS shown FROM (
   SELECT *, {act.format(s="'flat'", h='0')} AS action FROM {x}_input WHERE rn = 1)
 UNION ALL
 SELECT run_id, model, pair_id, rn, action, {after},
   CASE WHEN before <> 'flat' AND action LIKE 'hold%' THEN was + 1 ELSE 0 END,
   CASE WHEN before <> 'flat' THEN was + 1 ELSE 0 END
 FROM (SELECT i.*, w.state AS before, w.held AS was, {act.format(s='w.state', h='w.held')} AS action
   FROM {x}_walk w JOIN {x}_input i ON i.run_id = w.run_id AND i.model = w.model AND i.pair_id = w.pair_id
     AND i.rn = w.rn + 1)""")
    step(f"{x}_signals", f"""
 SELECT i.*, w.action AS signal_action, w.state AS signal_state, w.shown AS holding_days,
   CASE w.action WHEN 'stop_loss' THEN 'stop_loss_z' WHEN 'exit' THEN 'exit_z'
     WHEN 'force_exit_max_holding' THEN 'max_holding_days' ELSE '' END AS exit_reason
 FROM {x}_input i JOIN {x}_walk w USING (run_id, model, pair_id, rn)""")
    step(f"{x}_prepared", f"""
 SELECT *, coalesce(target_date, feature_date) AS execution_date FROM {x}_signals
 QUALIFY row_number() OVER (PARTITION BY run_id, coalesce(target_date, feature_date), model, pair_id
   ORDER BY target_date DESC, feature_date DESC) = 1""")
    step(f"{x}_calendar", f"""
 SELECT DISTINCT run_id, execution_date AS date FROM {x}_prepared UNION
 SELECT run_id, date FROM leg_dates JOIN (SELECT run_id, min(execution_date) AS lo, max(execution_date) AS hi
   FROM {x}_prepared GROUP BY run_id) ON date BETWEEN lo AND hi""")
    step(f"{x}_events", f"""
 SELECT e.run_id, e.model, e.pair_id, ticker_1, ticker_2, execution_date, signal_action, exit_reason, p1, p2,
   signal_action LIKE 'enter%' AS enters,
   row_number() OVER (PARTITION BY e.run_id, e.model ORDER BY execution_date, e.pair_id) AS k
 FROM {x}_prepared e JOIN legs l ON l.pair_id = e.pair_id AND l.date = e.execution_date
 WHERE signal_action LIKE 'enter%' OR signal_action IN ('exit', 'stop_loss', 'force_exit_max_holding')""")
    decide = (f"CASE WHEN enters AND NOT list_contains(held, pair_id) AND len(held) < {BP.max_active_pairs} "
              "THEN 'open' WHEN NOT enters AND list_contains(held, pair_id) THEN 'close' ELSE '' END")
    change = ("CASE deed WHEN 'open' THEN list_append(held, pair_id) "
              "WHEN 'close' THEN list_filter(held, lambda v: v <> pair_id) ELSE held END")
    step(f"{x}_fold", f"""
 SELECT run_id, model, k, pair_id, deed, {change} AS held FROM (
   SELECT *, {decide} AS deed FROM (SELECT *, []::VARCHAR[] AS held FROM {x}_events WHERE k = 1))
 UNION ALL
 SELECT run_id, model, k, pair_id, deed, {change} FROM (
   SELECT *, {decide} AS deed FROM (SELECT e.*, f.held FROM {x}_fold f JOIN {x}_events e
     ON e.run_id = f.run_id AND e.model = f.model AND e.k = f.k + 1))""")
    step(f"{x}_deeds", f"""
 SELECT e.*, deed, lead(execution_date) OVER w AS next_date, lead(p1) OVER w AS next_p1, lead(p2) OVER w AS next_p2,
   lead(signal_action) OVER w AS next_action, lead(exit_reason) OVER w AS next_reason
 FROM {x}_events e JOIN {x}_fold f USING (run_id, model, k) WHERE deed <> ''
 WINDOW w AS (PARTITION BY e.run_id, e.model, e.pair_id ORDER BY k)""")
    step(f"{x}_positions", f"""
 SELECT run_id, model, pair_id, ticker_1, ticker_2, CASE WHEN signal_action = 'enter_long_spread'
     THEN 'long_spread' ELSE 'short_spread' END AS side, execution_date AS entry_date, p1 AS entry_price_1,
   p2 AS entry_price_2, next_date AS exit_date, next_p1 AS exit_price_1, next_p2 AS exit_price_2,
   next_action AS exit_action, next_reason AS exit_reason, hedge_ratio_beta,
   (CASE WHEN side = 'long_spread' THEN 1 ELSE -1 END) * {_budget} / (1 + hedge_ratio_beta) / p1 AS shares_1,
   (CASE WHEN side = 'long_spread' THEN -1 ELSE 1 END) * {_budget} * hedge_ratio_beta / (1 + hedge_ratio_beta) / p2
     AS shares_2
 FROM {x}_deeds JOIN ratios USING (pair_id) WHERE deed = 'open'""")
    step(f"{x}_days", f"""
 SELECT p.*, c.date, sim_end, l.p1, l.p2, c.date > entry_date AND l.p1 IS NOT NULL AS marked,
   last_value(CASE WHEN c.date = entry_date THEN entry_price_1 ELSE l.p1 END IGNORE NULLS) OVER b AS prev_1,
   last_value(CASE WHEN c.date = entry_date THEN entry_price_2 ELSE l.p2 END IGNORE NULLS) OVER b AS prev_2,
   CASE WHEN marked THEN shares_1 * (l.p1 - prev_1) + shares_2 * (l.p2 - prev_2) END AS pnl,
   CASE WHEN marked THEN abs(least(shares_1 * l.p1, 0)) + abs(least(shares_2 * l.p2, 0)) END AS short_value,
   CASE WHEN c.date = entry_date THEN entry_price_1 ELSE coalesce(l.p1, prev_1) END AS last_1,
   CASE WHEN c.date = entry_date THEN entry_price_2 ELSE coalesce(l.p2, prev_2) END AS last_2,
   exit_date IS NULL OR c.date < exit_date AS alive
 FROM {x}_positions p JOIN (SELECT run_id, max(date) AS sim_end FROM {x}_calendar GROUP BY run_id) USING (run_id)
 JOIN {x}_calendar c ON c.run_id = p.run_id AND c.date BETWEEN entry_date AND coalesce(exit_date, sim_end)
 LEFT JOIN legs l ON l.pair_id = p.pair_id AND l.date = c.date
 WINDOW b AS (PARTITION BY p.run_id, p.model, p.pair_id, entry_date ORDER BY c.date
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
    step(f"{x}_valued", f"""
 SELECT p.*, gross_pnl, borrow_base, holding_days, last_price_1, last_price_2, sim_end AS date,
   abs(shares_1 * entry_price_1) + abs(shares_2 * entry_price_2) AS entry_notional,
   abs(shares_1 * exit_price_1) + abs(shares_2 * exit_price_2) AS exit_notional
 FROM {x}_positions p JOIN (
   SELECT run_id, model, pair_id, entry_date, coalesce(sum(pnl), 0) AS gross_pnl, coalesce(sum(short_value), 0) AS borrow_base,
     count(*) FILTER (WHERE marked) AS holding_days, arg_max(last_1, date) AS last_price_1,
     arg_max(last_2, date) AS last_price_2, any_value(sim_end) AS sim_end
   FROM {x}_days GROUP BY run_id, model, pair_id, entry_date) USING (run_id, model, pair_id, entry_date)""")
    step(f"{x}_trades", f"""
 SELECT scenario_id, v.* EXCLUDE (exit_reason), (entry_notional + exit_notional) * commission_bps / 10000 AS commission_cost,
   (entry_notional + exit_notional) * slippage_bps / 10000 AS slippage_cost,
   borrow_base * borrow_bps / 10000 / 252 AS borrow_cost, commission_cost + slippage_cost + borrow_cost AS transaction_cost,
   gross_pnl - transaction_cost AS net_pnl,
   CASE WHEN trim(exit_reason) <> '' THEN trim(exit_reason) WHEN exit_action = 'force_exit_max_holding'
     THEN 'max_holding_days' ELSE exit_action END AS exit_reason
 FROM {x}_valued v JOIN {x}_costs USING (run_id) WHERE exit_date IS NOT NULL""")
    step(f"{x}_model_days", f"SELECT run_id, date, model FROM {x}_calendar JOIN (SELECT DISTINCT run_id, model "
                            f"FROM {x}_prepared) USING (run_id)")
    step(f"{x}_turnover", f"""
 SELECT run_id, model, date, sum(t) AS turnover FROM (
   SELECT run_id, model, entry_date AS date, entry_notional AS t FROM {x}_valued UNION ALL
   SELECT run_id, model, exit_date, exit_notional FROM {x}_valued WHERE exit_date IS NOT NULL)
 GROUP BY run_id, model, date""")
    step(f"{x}_daily", f"""
 SELECT *, gross_pnl - transaction_cost AS net_pnl,
   sum(gross_pnl - transaction_cost) OVER (PARTITION BY scenario_id, model ORDER BY date) AS cumulative_net_pnl,
   {BP.initial_capital} + cumulative_net_pnl AS equity FROM (
   SELECT scenario_id, run_id, date, model, coalesce(pnl, 0) AS gross_pnl,
     coalesce(turnover, 0) * (commission_bps + slippage_bps) / 10000
       + coalesce(short_value, 0) * borrow_bps / 10000 / 252 AS transaction_cost
   FROM {x}_model_days LEFT JOIN (SELECT run_id, model, date, sum(pnl) AS pnl, sum(short_value) AS short_value
       FROM {x}_days WHERE marked GROUP BY run_id, model, date) USING (run_id, model, date)
   LEFT JOIN {x}_turnover USING (run_id, model, date) JOIN {x}_costs USING (run_id))""")
    step(f"{x}_exposure", f"""
 SELECT scenario_id, run_id, date, model, coalesce(g, 0) AS gross_exposure, coalesce(n, 0) AS net_exposure,
   coalesce(lo, 0) AS long_exposure, coalesce(sh, 0) AS short_exposure, coalesce(k, 0) AS active_positions,
   coalesce(turnover, 0) AS turnover
 FROM {x}_model_days LEFT JOIN (
   SELECT run_id, model, date, sum(abs(shares_1 * last_1) + abs(shares_2 * last_2)) AS g,
     sum(shares_1 * last_1 + shares_2 * last_2) AS n, count(*) AS k,
     sum(greatest(shares_1 * last_1, 0) + greatest(shares_2 * last_2, 0)) AS lo,
     sum(abs(least(shares_1 * last_1, 0)) + abs(least(shares_2 * last_2, 0))) AS sh
   FROM {x}_days WHERE alive GROUP BY run_id, model, date) USING (run_id, model, date)
 LEFT JOIN {x}_turnover USING (run_id, model, date) JOIN {x}_costs USING (run_id)""")
    step(f"{x}_open", f"""
 SELECT scenario_id, v.*, abs(shares_1 * last_price_1) + abs(shares_2 * last_price_2) AS gross_exposure,
   shares_1 * last_price_1 + shares_2 * last_price_2 AS net_exposure, gross_pnl AS unrealized_gross_pnl,
   borrow_base * borrow_bps / 10000 / 252 AS accrued_borrow_cost
 FROM {x}_valued v JOIN {x}_costs USING (run_id) WHERE exit_date IS NULL""")
    rank = "CASE split WHEN 'validation' THEN 0 WHEN 'test' THEN 1 WHEN 'holdout_2025' THEN 2 WHEN 'all' THEN 3 ELSE 99 END"
    for name, keys in (("date_split", "run_id, model, execution_date"),
                       ("trade_split", "run_id, model, pair_id, execution_date")):
        step(f"{x}_{name}", f"""
 SELECT {keys}, split FROM (SELECT {keys}, split, count(*) AS n FROM (
   SELECT *, coalesce(target_date, feature_date) AS execution_date FROM {x}_signals) GROUP BY {keys}, split)
 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {rank}, split) = 1""")
    for name in ("daily", "exposure"):
        step(f"{x}_split_{name}", f"""
 SELECT f.*, s.split FROM {x}_{name} f LEFT JOIN {x}_date_split s
   ON s.run_id = f.run_id AND s.model = f.model AND s.execution_date = f.date""")
    step(f"{x}_split_trades", f"""
 SELECT f.*, s.split FROM {x}_trades f LEFT JOIN {x}_trade_split s ON s.run_id = f.run_id
   AND s.model = f.model AND s.pair_id = f.pair_id AND s.execution_date = f.entry_date""")
    metric_steps(x, "scenario_id, model", f"{x}_split_daily", f"{x}_split_trades", f"{x}_split_exposure")


AP = S.analytics
_days, _rf = float(AP.trading_days_per_year), AP.risk_free_rate / AP.trading_days_per_year


def scopes(table: str) -> str:
    return f"(SELECT * EXCLUDE (split), 'all' AS split FROM {table} UNION ALL BY NAME " \
           f"SELECT * FROM {table} WHERE split IS NOT NULL AND split <> 'all')"


def metric_steps(x: str, keys: str, daily: str, trades: str, exposure: str) -> None:
    by = f"PARTITION BY {keys}, split"
    step(f"{x}_drawdowns", f"""
 SELECT *, min(drawdown) OVER ({by} ORDER BY date) AS max_drawdown_to_date FROM (
   SELECT *, equity / nullif(running_peak_equity, 0) - 1 AS drawdown FROM (
     SELECT *, product(1 + daily_return) OVER ({by} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS cumulative_return,
       max(equity) OVER ({by} ORDER BY date) AS running_peak_equity FROM (
       SELECT date, {keys}, split, equity, coalesce(net_pnl / nullif(equity - net_pnl, 0), 0) AS daily_return
       FROM {scopes(daily)})))""")
    step(f"{x}_returns", f"""
 SELECT {keys}, split, total AS total_return, CASE WHEN total > -1 THEN (1 + total) ** ({_days} / n) - 1 END AS annualized_return,
   CASE WHEN n >= 2 THEN std * sqrt({_days}) END AS annualized_volatility,
   CASE WHEN n >= 2 THEN mean / nullif(std, 0) * sqrt({_days}) END AS sharpe_ratio,
   CASE WHEN downs >= 2 THEN mean / nullif(down_std, 0) * sqrt({_days}) END AS sortino_ratio,
   low AS max_drawdown, annualized_return / nullif(abs(low), 0) AS calmar_ratio, n AS observation_count
 FROM (SELECT {keys}, split, product(1 + daily_return) - 1 AS total, count(*) AS n, stddev_samp(daily_return) AS std,
     avg(daily_return - {_rf}) AS mean, count(*) FILTER (WHERE daily_return < {_rf}) AS downs,
     stddev_samp(daily_return - {_rf}) FILTER (WHERE daily_return < {_rf}) AS down_std, min(drawdown) AS low
   FROM {x}_drawdowns GROUP BY {keys}, split)""")
    step(f"{x}_trade_metrics", f"""
 SELECT {keys}, split, count(net_pnl) AS number_of_trades, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
   avg(net_pnl) AS average_trade_pnl, median(net_pnl) AS median_trade_pnl, avg(holding_days) AS average_holding_period,
   coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) AS gross_profit,
   coalesce(sum(net_pnl) FILTER (WHERE net_pnl < 0), 0) AS gross_loss,
   CASE WHEN gross_loss < 0 THEN gross_profit / abs(gross_loss) END AS profit_factor,
   concat_ws(';', {", ".join(f"CASE WHEN count(*) FILTER (WHERE exit_reason = '{r}') > 0 THEN '{r}:' || count(*) FILTER (WHERE exit_reason = '{r}') END" for r in ("exit_z", "max_holding_days", "stop_loss_z"))}) AS exit_reason_counts
 FROM {scopes(trades)} GROUP BY {keys}, split""")
    step(f"{x}_exposure_metrics", f"""
 SELECT {keys}, split, avg(gross_exposure) AS average_gross_exposure, avg(net_exposure) AS average_net_exposure,
   max(gross_exposure) AS max_gross_exposure, avg(active_positions) AS average_active_positions,
   sum(turnover) AS turnover, avg(turnover) AS average_daily_turnover, count(*) AS observation_count
 FROM {scopes(exposure)} GROUP BY {keys}, split""")
    step(f"{x}_metrics", f"""
 SELECT * EXCLUDE (number_of_trades, observation_count), coalesce(number_of_trades, 0) AS number_of_trades,
   coalesce(observation_count, 0) AS observation_count
 FROM {x}_returns FULL JOIN (SELECT {keys}, split, win_rate, profit_factor, average_holding_period, number_of_trades
     FROM {x}_trade_metrics) USING ({keys}, split)
 FULL JOIN (SELECT {keys}, split, turnover, average_gross_exposure, average_net_exposure FROM {x}_exposure_metrics)
   USING ({keys}, split)""")


backtest_steps("base")
backtest_steps("sweep")
step("robustness", "SELECT m.*, entry_z, exit_z, stop_loss_z, commission_bps, slippage_bps, zscore_window, "
                   "signal_model FROM sweep_metrics m JOIN grid USING (scenario_id)")

# --------------------------------------------------------------------------- regimes

EP = S.regimes
step("market_days", """
 SELECT date, adjusted_close, adjusted_close / lag(adjusted_close) OVER (ORDER BY date) - 1 AS market_return FROM proxy""")
step("market_vol", f"""
 SELECT *, CASE WHEN count(market_return) OVER v >= {EP.volatility_min_periods} THEN stddev_samp(market_return) OVER v
     * sqrt({_days}) END AS realized_volatility, lag(adjusted_close) OVER (ORDER BY date) AS price,
   CASE WHEN count(adjusted_close) OVER t >= {EP.trend_min_periods} THEN avg(adjusted_close) OVER t END AS mean
 FROM market_days WINDOW v AS (ORDER BY date ROWS BETWEEN {EP.volatility_window} PRECEDING AND 1 PRECEDING),
   t AS (ORDER BY date ROWS BETWEEN {EP.trend_window} PRECEDING AND 1 PRECEDING)""")
step("market_features", f"""
 SELECT date, market_return, realized_volatility,
   quantile_cont(realized_volatility, {EP.low_quantile}) OVER h AS low_volatility_threshold,
   quantile_cont(realized_volatility, {EP.high_quantile}) OVER h AS high_volatility_threshold,
   price > mean AS bull_market, price < mean AS bear_market
 FROM market_vol WINDOW h AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_flags = [n for n, _ in EP.regimes()]
_special = ", ".join(f"{between('date', p)} AS {label_name(n)}" for n, p in EP.special_periods)


def first_flag(*names: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} THEN '{n}'" for n in names) + " ELSE 'unclassified' END"


step("day_labels", f"""
 SELECT *, {first_flag('validation', 'test', 'holdout_2025')} AS split,
   {first_flag('high_volatility', 'low_volatility', 'normal_volatility')} AS volatility_regime,
   {first_flag('bull_market', 'bear_market')} AS market_trend_regime, '{MARKET}' AS market_proxy FROM (
 SELECT date, market_return, realized_volatility AS realized_volatility, low_volatility_threshold, high_volatility_threshold,
   {between('date', WALK.validation)} AS validation, {between('date', WALK.test)} AS test,
   {between('date', WALK.holdout)} AS holdout_2025,
   coalesce(realized_volatility > high_volatility_threshold, false) AS high_volatility,
   coalesce(realized_volatility < low_volatility_threshold, false) AND NOT high_volatility AS low_volatility,
   realized_volatility IS NOT NULL AND low_volatility_threshold IS NOT NULL AND high_volatility_threshold IS NOT NULL
     AND NOT high_volatility AND NOT low_volatility AS normal_volatility,
   coalesce(bull_market, false) AS bull_market, coalesce(bear_market, false) AS bear_market, {_special}
 FROM (SELECT DISTINCT date FROM base_daily) LEFT JOIN market_features USING (date))""")
step("regime_days", " UNION ALL ".join(f"SELECT date, '{n}' AS regime FROM day_labels WHERE {n}" for n in _flags))
step("regime_daily", "SELECT f.*, regime, NULL AS split FROM base_daily f JOIN regime_days USING (date)")
step("regime_exposure", "SELECT f.*, regime, NULL AS split FROM base_exposure f JOIN regime_days USING (date)")
step("regime_trades", "SELECT f.* EXCLUDE (date), regime, NULL AS split FROM base_trades f JOIN regime_days r ON r.date = f.exit_date")
metric_steps("regime", "model, regime", "regime_daily", "regime_trades", "regime_exposure")
step("regime_performance", f"""
 SELECT m.model, t.regime, t.regime_type, sp.start_date, sp.end_date, coalesce(sp.label_days, 0) AS label_days,
   coalesce(dd.days, 0) AS number_of_trading_days, {EP.minimum_observations} AS minimum_observations,
   coalesce(dd.days, 0) >= {EP.minimum_observations} AS meets_minimum_observations, r.total_return, r.annualized_return,
   r.annualized_volatility, r.sharpe_ratio, r.sortino_ratio, r.max_drawdown, r.calmar_ratio, dd.net_pnl,
   coalesce(tm.number_of_trades, 0)::DOUBLE AS number_of_trades,
   CASE WHEN sp.label_days IS NULL OR (SELECT count(*) FROM base_trades) = 0 THEN 'none' ELSE 'exit_date' END
     AS trade_attribution_method,
   x.average_gross_exposure, x.average_net_exposure, x.average_active_positions, x.turnover
 FROM (SELECT DISTINCT model FROM base_daily) m
 CROSS JOIN (VALUES {", ".join(f"('{n}', '{t}')" for n, t in EP.regimes())}) t(regime, regime_type)
 LEFT JOIN (SELECT regime, min(date) AS start_date, max(date) AS end_date, count(*) AS label_days FROM regime_days
   GROUP BY regime) sp ON sp.regime = t.regime
 LEFT JOIN (SELECT model, regime, count(DISTINCT date) AS days, sum(net_pnl) AS net_pnl FROM regime_daily
   GROUP BY model, regime) dd ON dd.model = m.model AND dd.regime = t.regime
 LEFT JOIN regime_returns r ON r.model = m.model AND r.regime = t.regime
 LEFT JOIN regime_trade_metrics tm ON tm.model = m.model AND tm.regime = t.regime
 LEFT JOIN regime_exposure_metrics x ON x.model = m.model AND x.regime = t.regime""")
