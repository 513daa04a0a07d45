"""The registered queries. Names start with the operator ids they cover."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.columns import by_date, count_business_days, float_text, general_text
from pairloom.operators import analytics as A
from pairloom.operators import backtest as B
from pairloom.operators import features as X
from pairloom.operators import forecast as M
from pairloom.operators import learned as L
from pairloom.operators import pairs as P
from pairloom.operators import panel as N
from pairloom.operators import quality as D
from pairloom.operators import regimes as E
from pairloom.operators import report as T
from pairloom.operators import robustness as R
from pairloom.operators import signals as G
from pairloom.operators import spreads as S
from pairloom.operators import universe as U
from pairloom.params import UniverseParams
from pairloom.plans.research import Settings
from pairloom.session import remove_folder
from pairloom.sources import driver, landing, tables

from .setup import DATA, FORMATION, SETTINGS
from .shape import Query
from .sql import FEATURES, TARGETS, audit_steps, between, candidate_sql, lag_test, step, tau_p

ALL: list[Query] = []
SPLITS = ("train", "validation", "test", "holdout_2025")


def add(name: str, run, columns: str, sql: str | None = None) -> None:
    ALL.append(Query(name, run, columns, sql))


def messy(df: DataFrame) -> DataFrame:
    """A table as untyped text with stray blanks and case, as it could come from files."""
    def column(name: str, kind: str):
        c = F.col(name)
        if kind == "string":
            return F.concat(F.lit("  "), F.lower(c), F.lit(" "))
        return c.cast("string")

    renamed = {n: f" {n.replace('_', ' ').title()} " for n in df.columns}
    return df.select([column(n, k).alias(renamed[n]) for n, k in df.dtypes])


# --------------------------------------------------------------------------- sources and quality

QP = SETTINGS.quality
BAR = "open:6 high:6 low:6 close:6 adjusted_close:6 volume:4"

add("s01_d01_d02_normalized_bars",
    lambda r, s, sf: D.normalize_bars(driver.vendor_rows(s, sf)),
    f"ticker date:d {BAR}", "SELECT * FROM vendor")
add("d03_period_filter",
    lambda r, s, sf: D.in_period(D.normalize_bars(driver.vendor_rows(s, sf)),
                                 replace(QP, period=FORMATION)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")),
    "ticker n:i first:d last:d",
    f"SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last FROM vendor "
    f"WHERE {between('date', FORMATION)} GROUP BY ticker")
add("d04_clean_bars", lambda r, s, sf: D.clean_bars(driver.vendor_rows(s, sf), QP),
    f"ticker date:d {BAR}", "SELECT * FROM vendor_clean")
REPORT = ("ticker valid row_count:i start_date:d end_date:d expected_observations:i missing_observations:i "
          "missing_observation_fraction:6 missing_adjusted_close:i missing_ohlcv_columns zero_volume_days:i "
          "duplicated_dates:i non_positive_price_rows:i insufficient_history excessive_missing_observations issues")
add("d06_d14_validation_report", lambda r, s, sf: D.validation_report(driver.vendor_rows(s, sf), QP), REPORT,
    "SELECT *, fraction AS missing_observation_fraction FROM quality_report")
add("d05_missing_columns_report",
    lambda r, s, sf: D.validation_report(driver.vendor_rows(s, sf).drop("Open", "Adj Close", "Volume"), QP),
    "ticker valid row_count:i missing_ohlcv_columns missing_adjusted_close:i zero_volume_days:i issues",
    """SELECT ticker, false AS valid, row_count, 'open,volume' AS missing_ohlcv_columns, 0 AS missing_adjusted_close,
       0 AS zero_volume_days, concat_ws('; ', 'Missing OHLCV columns: open, volume.', 'Missing adjusted_close column.',
       CASE WHEN duplicated_dates > 0 THEN 'Duplicated dates detected.' END,
       CASE WHEN low_rows > 0 THEN 'Non-positive prices detected.' END,
       CASE WHEN insufficient_history THEN 'Only ' || row_count || ' observations available; minimum is """
    + f"{QP.min_history_days}" + """.' END,
       CASE WHEN excessive_missing_observations THEN printf('Missing observation fraction %.2f%% exceeds threshold """
    + f"{QP.max_missing_fraction:.2%}" + """%.', 100 * fraction) END) AS issues
       FROM quality_report JOIN (SELECT ticker, count(*) FILTER (WHERE low <= 0) AS low_rows FROM vendor_in
       GROUP BY ticker) USING (ticker)""")

def _gated(r, s, sf):
    daily = driver.bars(s, sf)
    return D.valid_bars(daily, replace(QP, max_missing_fraction=0.52), unique=True)


add("d15_valid_ticker_gate", _gated, f"ticker date:d {BAR}",
    f"""SELECT * FROM ohlc WHERE {between('date', DATA)} AND ticker IN (SELECT ticker FROM ohlc
        WHERE {between('date', DATA)} GROUP BY ticker HAVING count(*) >= {QP.min_history_days}
        AND 1 - count(*) / {count_business_days(DATA.start, DATA.end)} <= 0.52)""")
add("s01_daily_bars", lambda r, s, sf: driver.bars(s, sf), f"ticker date:d {BAR}", "SELECT * FROM ohlc")

def supplier_listing(s, sf):
    """One listing row per supplier: repeated tickers, some blank, some without a sector."""
    sup, nat, reg = (driver.table(s, sf, t) for t in ("supplier", "nation", "region"))
    rows = sup.join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return rows.select(
        F.when(F.col("s_acctbal") < 0, F.lit(" ")).otherwise(F.lower("n_name")).alias("ticker"),
        F.col("s_name").alias("company_name"),
        F.when(F.col("s_acctbal") > 9000, F.lit(None)).otherwise(F.col("r_name")).alias("sector"),
        F.when(F.col("s_acctbal") > 8000, F.lit("")).otherwise(F.col("n_name")).alias("industry"),
        F.col("s_suppkey").alias("row_no"))


step("listing", """SELECT CASE WHEN s_acctbal < 0 THEN '' ELSE upper(n_name) END AS ticker, trim(s_name) AS company_name,
 CASE WHEN s_acctbal > 9000 THEN '' ELSE trim(r_name) END AS sector,
 CASE WHEN s_acctbal > 8000 THEN '' ELSE trim(n_name) END AS industry, s_suppkey AS row_no
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
add("s02_constituents", lambda r, s, sf: tables.normalize_constituents(supplier_listing(s, sf)),
    "ticker company_name sector industry row_no:i", "SELECT * FROM listing")
add("s03_clean_universe_scan", lambda r, s, sf: tables.normalize_clean_universe(supplier_listing(s, sf)),
    "ticker company_name sector industry row_no:i",
    "SELECT * FROM listing WHERE ticker <> '' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY row_no) = 1")


def trade_lanes(s, sf):
    """Supplier-nation to customer-nation lanes as a raw pair list."""
    li = driver.table(s, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = driver.table(s, sf, "orders").select("o_orderkey", "o_custkey")
    cust = driver.table(s, sf, "customer").select("c_custkey", "c_nationkey")
    sup = driver.table(s, sf, "supplier").select("s_suppkey", "s_nationkey")
    keys = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        cust, F.col("o_custkey") == F.col("c_custkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "s_nationkey", "c_nationkey").distinct()
    nat = driver.table(s, sf, "nation").select("n_nationkey", "n_name")
    name = lambda key, out: nat.select(F.col("n_nationkey").alias(key), F.lower("n_name").alias(out))
    return keys.join(F.broadcast(name("s_nationkey", "t1")), "s_nationkey").join(
        F.broadcast(name("c_nationkey", "t2")), "c_nationkey").select(
        F.col("t1").alias("Ticker 1"),
        F.when(F.col("s_nationkey") == F.col("c_nationkey"), F.lit(" ")).otherwise(F.col("t2")).alias("Ticker 2"))


add("s04_selected_pairs_scan", lambda r, s, sf: tables.normalize_selected_pairs(trade_lanes(s, sf)),
    "pair_id ticker_1 ticker_2",
    """SELECT DISTINCT upper(a.n_name) AS ticker_1, upper(b.n_name) AS ticker_2,
       upper(a.n_name) || '-' || upper(b.n_name) AS pair_id
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = s_nationkey
       JOIN nation b ON b.n_nationkey = c_nationkey WHERE s_nationkey <> c_nationkey""")
add("s05_spread_scan", lambda r, s, sf: tables.normalize_spreads(messy(r.spreads)),
    "date:d pair_id ticker_1 ticker_2 beta:6 spread:6", "SELECT * FROM spreads")
add("s05_zscore_scan", lambda r, s, sf: tables.normalize_zscores(messy(r.zscores)),
    "date:d pair_id z_score_window:i rolling_mean_lagged:6 rolling_std_lagged:6 z_score:6", "SELECT * FROM zscores")
add("s06_prediction_scan", lambda r, s, sf: tables.normalize_predictions(messy(r.predictions)),
    "pair_id model feature_date:d target_date:d split prediction:6 actual:6", "SELECT * FROM predictions")
add("s07_comparison_scan", lambda r, s, sf: tables.normalize_comparison(messy(r.comparison)),
    "model validation_rmse:6 test_mae:6 selected_by_validation selection_rank:i", "SELECT * FROM comparison")
add("s08_feature_split_scan",
    lambda r, s, sf: reduce(DataFrame.unionByName, [tables.normalize_features(
        messy(r.features.filter(F.col("split") == name)).withColumn(" Split ", F.lit(None).cast("string")),
        name, "target_next_day_spread") for name in SPLITS]),
    "date:d target_date:d pair_id split spread:6 target_next_day_spread:6", "SELECT * FROM features")
add("s09_signal_scan", lambda r, s, sf: tables.normalize_signals(messy(r.signals)),
    "pair_id ticker_1 ticker_2 model split signal_action feature_date:d target_date:d", "SELECT * FROM base_signals")
add("s09_diagnostics_scan", lambda r, s, sf: tables.normalize_diagnostics(messy(r.spread_diagnostics)),
    "pair_id ticker_1 ticker_2 hedge_ratio_beta:6", "SELECT *, beta AS hedge_ratio_beta FROM spread_diagnostics")
add("s09_backtest_spread_scan", lambda r, s, sf: tables.normalize_backtest_spreads(messy(r.spreads)),
    "date:d pair_id adjusted_close_1:6 adjusted_close_2:6 beta:6", "SELECT * FROM spreads")
add("s10_daily_pnl_scan", lambda r, s, sf: tables.normalize_daily_pnl(messy(r.daily_pnl)),
    "date:d model net_pnl:4 equity:4", "SELECT * FROM base_daily")
add("s10_equity_scan", lambda r, s, sf: tables.normalize_equity(messy(r.daily_pnl)),
    "date:d model cumulative_net_pnl:4 equity:4", "SELECT * FROM base_daily")
add("s10_trade_log_scan", lambda r, s, sf: tables.normalize_trade_log(messy(r.trade_log)),
    "model entry_date:d exit_date:d net_pnl:4 holding_days:i", "SELECT * FROM base_trades")
add("s10_exposure_scan", lambda r, s, sf: tables.normalize_exposure(messy(r.exposure)),
    "date:d model gross_exposure:4 active_positions:i turnover:4", "SELECT * FROM base_exposure")
add("s11_market_proxy", lambda r, s, sf: E.market_proxy(r.prices, driver.MARKET),
    "date:d adjusted_close:6", "SELECT * FROM proxy")
add("s13_price_panel",
    lambda r, s, sf: N.price_panel(D.normalize_bars(driver.vendor_rows(s, sf)), FORMATION),
    "ticker date:d adjusted_close:6 volume:4",
    f"""SELECT ticker, date, CASE WHEN adjusted_close > 0 THEN adjusted_close END AS adjusted_close, volume
        FROM vendor_clean WHERE {between('date', FORMATION)}""")
EXPLICIT = ("nation_3", " NATION_11 ", "", "Nation_3", "no such place")
add("s14_explicit_tickers",
    lambda r, s, sf: r.prices.join(N.listed_tickers(r.constituents, EXPLICIT), "ticker", "left_semi"),
    "ticker date:d adjusted_close:6 volume:4", "SELECT * FROM prices WHERE ticker IN ('NATION_3', 'NATION_11')")
add("s14_listed_tickers", lambda r, s, sf: N.listed_tickers(supplier_listing(s, sf)),
    "ticker", "SELECT DISTINCT ticker FROM listing WHERE ticker <> ''")
add("s16_land_new_rows",
    lambda r, s, sf: tables.land_new(r.prices, r.prices.filter(F.col("date") <= F.lit(FORMATION.end))),
    "ticker date:d adjusted_close:6 volume:4", f"SELECT * FROM prices WHERE date > DATE '{FORMATION.end}'")


def _landing(r, s, sf):
    """Prices landed in three steps, one of them broken off half-way and one repeated."""
    root = f"{r.folder}/{r.name}/landing"
    remove_folder(s, root)
    early = r.prices.filter(F.col("date") <= F.lit(FORMATION.end))
    landing.land(early, root)
    # What a landing leaves that broke off before its manifest: data that no reader may see.
    r.prices.filter(F.col("date") > F.lit(FORMATION.end)).filter(F.col("volume") > 0).write.parquet(f"{root}/data/batch=broken")
    landing.land(r.prices, root)
    return landing.land(r.prices, root)


add("s16_landing", _landing, "ticker date:d adjusted_close:6 volume:4", "SELECT * FROM prices")


def _sinks(r, s, sf):
    """Every table of every sink, read back whole."""
    root = f"{r.folder}/{r.name}/sinks"
    tables.write_bars(r.prices, f"{root}/bars")
    tables.write_features(r.features, f"{root}/features")
    tables.write_table(r.metrics, f"{root}/metrics_csv", "csv")
    tables.write_table(r.comparison, f"{root}/comparison_json", "json")

    def rows(df, sink, keys, a, b):
        return df.select(F.lit(sink).alias("sink"), F.concat_ws("|", *keys).alias("key"),
                         F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))

    features = reduce(DataFrame.unionByName, [tables.read_features(s, f"{root}/features", x) for x in SPLITS])
    return reduce(DataFrame.unionByName, [
        rows(s.read.parquet(f"{root}/bars"), "bars_parquet", ["ticker", "date"], "adjusted_close", "volume"),
        rows(features, "features_parquet", ["split", "pair_id", "date"], "spread", "target_next_day_spread"),
        rows(tables.read_table(s, f"{root}/metrics_csv", "csv"), "metrics_csv", ["model", "split"], "rmse", "bias"),
        rows(tables.read_table(s, f"{root}/comparison_json", "json"), "comparison_json", ["model"], "validation_rmse",
             "selection_rank")])


add("s17_sinks", _sinks, "sink key a:6 b:4",
    # metrics first: the steps of the twin are put in the order of their mention
    """SELECT 'metrics_csv' AS sink, concat_ws('|', model, split) AS key, rmse AS a, bias AS b FROM metrics
       UNION ALL SELECT 'bars_parquet', concat_ws('|', ticker, date::DATE), adjusted_close, volume FROM prices
       UNION ALL SELECT 'features_parquet', concat_ws('|', split, pair_id, date::DATE), spread, target_next_day_spread
         FROM features
       UNION ALL SELECT 'comparison_json', model, validation_rmse, selection_rank FROM comparison""")


def _price_files(r, s, sf):
    """Vendor rows written as CSV, one folder per ticker, and read back from the files."""
    root = f"{r.folder}/{r.name}/price_files"
    rows = driver.vendor_rows(s, sf).repartition("ticker").sortWithinPartitions("ticker", "ord")
    tables.write_table(rows.drop("ord"), root, "csv", ("ticker",))
    return D.clean_bars(tables.read_price_files(s, root), QP)


add("s01_price_files", _price_files, f"ticker date:d {BAR}",
    "SELECT * REPLACE (regexp_replace(ticker, '[^A-Za-z0-9_.-]+', '_', 'g') AS ticker) FROM vendor_clean")
LISTED = ("NATION_3", "  nation_14", "NATION_20 ", "NOWHERE")


def _listed_files(r, s, sf):
    root = f"{r.folder}/{r.name}/listed_files"
    rows = driver.vendor_rows(s, sf).repartition("ticker").sortWithinPartitions("ticker", "ord")
    tables.write_table(rows.drop("ord"), root, "csv", ("ticker",))
    return D.clean_bars(tables.read_price_files(s, root, LISTED), QP)


add("s01_listed_price_files", _listed_files, f"ticker date:d {BAR}",
    "SELECT * FROM vendor_clean WHERE ticker IN ('NATION_3', 'NATION_14', 'NATION_20')")
add("s02_numbered_listing",
    lambda r, s, sf: tables.normalize_constituents(supplier_listing(s, sf).repartitionByRange(4, "row_no")
                                                   .sortWithinPartitions("row_no").drop("row_no")),
    "ticker company_name sector industry row_no:i",
    "SELECT * REPLACE (row_number() OVER (ORDER BY row_no) - 1 AS row_no) FROM listing")

# --------------------------------------------------------------------------- universe

STRICT = UniverseParams(period=DATA, min_adjusted_close_price=30.0, min_average_daily_dollar_volume=60_000.0,
                        max_missing_data_ratio=0.2, max_zero_volume_days=3, min_history_days=700)
audit_steps("strict", "cons", "vendor_clean", STRICT)
audit_steps("listed", "listing", "stocks", SETTINGS.universe)
AUDIT = ("row_number:i ticker company_name sector industry included exclusion_reasons warnings has_price_data "
         "row_count:i expected_observations:i missing_data_ratio:6 min_adjusted_close:6 "
         "average_daily_dollar_volume:4 zero_volume_days:i")
add("u03_u04_tradability",
    lambda r, s, sf: U.universe_audit(r.constituents, D.clean_bars(driver.vendor_rows(s, sf), QP), STRICT, unique=True),
    AUDIT, "SELECT * FROM strict_audit")


def _listed_audit(r, s, sf):
    stocks = r.prices.filter(F.col("ticker") != driver.MARKET)
    return U.universe_audit(tables.normalize_constituents(supplier_listing(s, sf)), stocks, SETTINGS.universe,
                            unique=True)


add("u01_u02_listing_audit", _listed_audit, AUDIT, "SELECT * FROM listed_audit")


def with_indices(r, s, sf):
    """Nations plus their regions as listed indices, which have no prices of their own."""
    region = driver.table(s, sf, "region")
    name = F.upper(F.trim("r_name"))
    return r.constituents.unionByName(region.select(
        name.alias("ticker"), F.col("r_name").alias("company_name"), F.col("r_name").alias("sector"),
        F.lit("Index").alias("industry"), (F.col("r_regionkey") + 1000).cast("long").alias("row_no")))


step("cons_indices", """SELECT * FROM cons UNION ALL
 SELECT upper(trim(r_name)), r_name, r_name, 'Index', r_regionkey + 1000 FROM region""")
audit_steps("indexed", "cons_indices", "prices", SETTINGS.universe)
add("u05_missing_price_audit", lambda r, s, sf: U.universe_audit(with_indices(r, s, sf), r.prices, SETTINGS.universe, unique=True),
    AUDIT, "SELECT * FROM indexed_audit")
add("u06_clean_universe", lambda r, s, sf: r.universe,
    "ticker company_name sector industry has_price_data row_count:i missing_data_ratio:6 min_adjusted_close:6 "
    "average_daily_dollar_volume:4 zero_volume_days:i", "SELECT * FROM universe")

# --------------------------------------------------------------------------- pairs

IDENTITY = ("pair_id ticker_1 ticker_2 sector_1 sector_2 industry_1 industry_2 company_name_1 company_name_2 "
            "pair_liquidity:4")
DIAGNOSTIC = (f"{IDENTITY} formation_start:d formation_end:d same_sector_pair overlap_observations:i "
              "return_correlation:6 passes_correlation_filter cointegration_pvalue_raw:9 "
              "cointegration_test_statistic:6 hedge_ratio_beta:6 half_life_days:6 exclusion_reasons")
add("p01_p02_candidate_pairs", lambda r, s, sf: P.candidate_pairs(r.universe), IDENTITY, "SELECT * FROM candidates")
add("p01_all_pairs", lambda r, s, sf: P.candidate_pairs(r.universe, same_sector_only=False), IDENTITY,
    candidate_sql("universe", False))


add("p03_p05_p07_p08_p11_pair_statistics",
    lambda r, s, sf: P.pair_statistics(r.candidates, r.formation_vectors, FORMATION),
    "pair_id overlap_observations:i return_correlation:6 hedge_ratio_beta:6 alpha:6 df_statistic:6 half_life_days:6",
    """SELECT pair_id, n AS overlap_observations, rho AS return_correlation, beta AS hedge_ratio_beta, alpha,
       t AS df_statistic, CASE WHEN gamma < 0 THEN -ln(2) / gamma END AS half_life_days
       FROM pair_fit JOIN pair_df USING (pair_id)""")


def _with_missing_legs(r, s, sf):
    audit = U.universe_audit(with_indices(r, s, sf), r.prices, SETTINGS.universe, unique=True)
    listed = audit.filter(F.col("included") | (F.col("industry") == "Index"))
    return P.evaluate_candidates(P.candidate_pairs(listed), r.prices, SETTINGS.pairs, unique=True)


step("indexed_universe", "SELECT * FROM indexed_audit WHERE included OR industry = 'Index'")
step("indexed_candidates", candidate_sql("indexed_universe", True))
add("p04_missing_leg", _with_missing_legs,
    "pair_id overlap_observations:i return_correlation:6 passes_correlation_filter exclusion_reasons pair_liquidity:4",
    """SELECT c.pair_id, coalesce(e.overlap_observations, 0) AS overlap_observations, e.return_correlation,
       coalesce(e.passes_correlation_filter, false) AS passes_correlation_filter,
       coalesce(e.exclusion_reasons, 'missing_processed_price_data') AS exclusion_reasons, e.pair_liquidity
       FROM indexed_candidates c LEFT JOIN evaluated e USING (pair_id)""")
add("p06_p10_candidate_diagnostics", lambda r, s, sf: r.evaluated, DIAGNOSTIC, "SELECT * FROM evaluated")
def _engle_granger(r, max_lag):
    """Tests of every candidate: those that pass the correlation filter have a statistic."""
    p = replace(SETTINGS.pairs, variant="aic", max_lag=max_lag)
    return P.evaluate_candidates(r.candidates, r.prices, p, unique=True, keep=("lags",),
                                 stage=lambda _: r.formation_vectors)


ENGLE_GRANGER = ("pair_id overlap_observations:i passes_correlation_filter cointegration_pvalue_raw:9 "
                 "cointegration_test_statistic:6 lags:i")
# The lag of least AIC among all that the length allows: its numbers are tested against plain
# regressions; with few lags the same operator has a twin.
add("p09_engle_granger_aic", lambda r, s, sf: _engle_granger(r, None), ENGLE_GRANGER)
for _lag in (0, 1, 2):
    add(f"p09_engle_granger_lag_{_lag}", lambda r, s, sf, m=_lag: _engle_granger(r, m), ENGLE_GRANGER,
        f"""SELECT pair_id, overlap_observations, passes_correlation_filter, lags, stat AS cointegration_test_statistic,
            CASE WHEN stat IS NOT NULL THEN {tau_p('stat', 2)} END AS cointegration_pvalue_raw
            FROM (SELECT e.*, CASE WHEN passes_correlation_filter THEN lags END AS lags,
                CASE WHEN passes_correlation_filter THEN stat END AS stat
              FROM (SELECT pair_id, overlap_observations, passes_correlation_filter FROM evaluated) e
              LEFT JOIN ({lag_test('pair_residual_series', _lag, False)}) USING (pair_id))""")


def _line_prices(r, s, sf):
    """A large family of p-values: one per line item, with many repeats."""
    li = driver.table(s, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        (F.col("l_quantity") * F.col("l_quantity") / 2500.0 * (0.2 + F.col("l_discount"))).alias("p"))


add("p12_benjamini_hochberg_by_family",
    lambda r, s, sf: P.benjamini_hochberg(_line_prices(r, s, sf).withColumn(
        "raw", F.col("p")).drop("p"), "raw", "adjusted", ("l_returnflag",)),
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i raw:9 adjusted:9",
    """SELECT *, min(least(raw * total / rank, 1.0)) OVER (PARTITION BY l_returnflag ORDER BY raw DESC
         RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted FROM (
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
         l_quantity * l_quantity / 2500.0 * (0.2 + l_discount) AS raw, count(*) OVER (PARTITION BY l_returnflag) AS total,
         count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity * l_quantity / 2500.0 * (0.2 + l_discount)
           RANGE UNBOUNDED PRECEDING) AS rank FROM lineitem)""")
add("p12_p13_finalized", lambda r, s, sf: r.finalized,
    "pair_id cointegration_pvalue_adjusted:9 half_life_days:6 selected exclusion_reasons",
    "SELECT *, exclusion_reasons = '' AS selected FROM finalized")
SCORES = "p_value_score:6 correlation_score:6 half_life_score:6 liquidity_score:6 selection_score:6"
add("p14_scores", lambda r, s, sf: P.rank_pairs(r.finalized.filter("selected"), SETTINGS.pairs),
    f"pair_id {SCORES}", "SELECT * FROM scored")
add("p15_selected_pairs", lambda r, s, sf: P.select_pairs(r.finalized, SETTINGS.pairs),
    f"pair_id ticker_1 ticker_2 return_correlation:6 half_life_days:6 {SCORES}", "SELECT * FROM selected")
add("p16_pair_diagnostics", lambda r, s, sf: r.diagnostics,
    "pair_id selected exclusion_reasons cointegration_pvalue_adjusted:9", "SELECT * FROM diagnostics")

# --------------------------------------------------------------------------- spreads and features

add("x01_x03_x04_x06_spread_diagnostics", lambda r, s, sf: r.spread_diagnostics,
    "pair_id ticker_1 ticker_2 beta:6 alpha:6 spread_mean_formation:6 spread_std_formation:6 "
    "adf_p_value_formation:9 half_life_formation:6 observations:i formation_observations:i missing_ratio:6",
    "SELECT * FROM spread_diagnostics")
add("x02_spread_series", lambda r, s, sf: r.spreads,
    "date:d pair_id ticker_1 ticker_2 adjusted_close_1:6 adjusted_close_2:6 log_price_1:6 log_price_2:6 alpha:6 "
    "beta:6 spread:6", "SELECT * FROM spreads")
def _adf(r, max_lag):
    """Unit-root tests of the formation spreads beside their diagnostics."""
    p = replace(SETTINGS.spreads, variant="aic", max_lag=max_lag)
    rows = S.spread_diagnostics(r.selected, r.prices, r.vectors, p)
    tests = S.unit_root_tests(rows.select("pair_id", "ticker_1", "ticker_2", "alpha", "beta"), r.vectors, p)
    return rows.join(tests.select("pair_id", "stat", "lags"), "pair_id", "left")


ADF = "pair_id adf_p_value_formation:9 half_life_formation:6 stat:6 lags:i"
add("x05_adf_aic", lambda r, s, sf: _adf(r, None), ADF)
for _lag in (0, 1, 2):
    add(f"x05_adf_lag_{_lag}", lambda r, s, sf, m=_lag: _adf(r, m), ADF,
        f"""SELECT pair_id, half_life_formation, stat, lags, {tau_p('stat', 1)} AS adf_p_value_formation
            FROM (SELECT pair_id, half_life_formation FROM spread_diagnostics)
            JOIN ({lag_test('formation_spreads', _lag, True)}) USING (pair_id)""")
add("x07_lagged_zscores", lambda r, s, sf: S.lagged_zscores(r.spreads, SETTINGS.spreads.windows),
    "date:d pair_id ticker_1 ticker_2 z_score_window:i rolling_mean_lagged:6 rolling_std_lagged:6 z_score:6",
    "SELECT * FROM zscores")


def _features(r, **changes):
    return X.build_features(r.spreads, r.zscores, r.panel(), replace(SETTINGS.features, **changes), unique=True)


add("f01_f13_features", lambda r, s, sf: _features(r),
    "date:d pair_id ticker_1 ticker_2 spread:6 target_date:d split "
    + " ".join(f"{c}:6" for c in TARGETS + FEATURES), "SELECT * FROM features")
add("f12_split_labels", lambda r, s, sf: _features(r, drop_missing_rows=False).groupBy("split").agg(
    F.count(F.lit(1)).alias("n"), F.min("target_date").alias("first"), F.max("target_date").alias("last")),
    "split n:i first:d last:d",
    "SELECT split, count(*) AS n, min(target_date) AS first, max(target_date) AS last FROM feature_rows "
    "WHERE split IS NOT NULL GROUP BY split")
add("f14_split_extract",
    lambda r, s, sf: reduce(DataFrame.unionByName, [X.split_extract(r.features, x) for x in SPLITS]),
    "date:d pair_id split spread:6 " + " ".join(f"{c}:6" for c in FEATURES), "SELECT * FROM features")

# --------------------------------------------------------------------------- forecasts

FC = SETTINGS.forecasts
PREDICTION = ("pair_id ticker_1 ticker_2 model feature_date:d target_date:d split prediction:6 actual:6 "
              "forecast_error:6 training_split_source training_observation_count:i spread:6")
for _name, _model in (("m01_naive", "naive"), ("m02_rolling_mean", "rolling_mean"), ("m03_arima", "arima")):
    add(_name, lambda r, s, sf, m=_model: r.forecast(m), PREDICTION,
        f"SELECT * FROM predictions WHERE model = '{_model}'")
# Forecasts whose numbers SQL cannot follow: their rows, actuals and training counts have a
# twin, and whether each row has a finite forecast.
SHAPE = ("pair_id ticker_1 ticker_2 model feature_date:d target_date:d split actual:6 training_split_source "
         "training_observation_count:i spread:6 forecast")


def _finite(df):
    return df.withColumn("forecast", F.col("prediction").isNotNull() & ~F.isnan("prediction")
                         & (F.abs("prediction") < 1e9))


def _shape_sql(model: str, forecast: str = "true") -> str:
    return f"SELECT * REPLACE ('{model}' AS model), {forecast} AS forecast FROM predictions WHERE model = 'naive'"


def _by_state_space(r):
    rows = M.evaluation_rows(r.features).withColumns({
        "h": F.row_number().over(by_date("pair_id", "split")), "source": M.source_of(F.col("split"), FC)})
    paths = M.likelihood_paths(r.features, rows, FC)
    return M.prediction_table(rows.join(paths, ["pair_id", "source", "h"], "left"), "arima", r.features, FC)


# A sequence ends at each row: training rows of the pair come first, then the rows of the split.
_LONG = (f"(SELECT count(*) FROM train t WHERE t.pair_id = predictions.pair_id) + row_number() OVER "
         f"(PARTITION BY pair_id, split ORDER BY feature_date) >= {FC.sequence_length}")
for _name, _order in (("m03_arima_2_1_1", (2, 1, 1)), ("m03_arima_2_0_2", (2, 0, 2))):
    add(_name, lambda r, s, sf, o=_order: M.arima_forecast(r.features, replace(FC, arima_order=o)), PREDICTION)
# The state-space likelihood by its (1,0,0) case, which the closed form of the twin knows.
add("m03_arima_by_state_space", lambda r, s, sf: _by_state_space(r), PREDICTION,
    "SELECT * FROM predictions WHERE model = 'arima'")
for _name, _model in (("m04_boosted_trees", "boosted_trees"), ("m05_recurrent", "recurrent"),
                      ("m05_sequence_regression", "sequence_regression")):
    add(_name, lambda r, s, sf, m=_model: r.forecast(m), PREDICTION)
    add(f"{_name}_rows", lambda r, s, sf, m=_model: _finite(r.forecast(m)), SHAPE,
        _shape_sql(_model, "true" if _model == "boosted_trees" else _LONG))
add("m05_sequences", lambda r, s, sf: L.sequences(r.features, FC).select(
    "pair_id", "date", F.col("for_split").alias("split"), "phase",
    F.when(F.col("sequence").isNotNull(), F.size("sequence")).alias("length"),
    F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v).alias("total")),
    "pair_id date:d split phase:i length:i total:4",
    # Per row the sum of scaled inputs, then the sum over the sequence.
    "WITH scale AS MATERIALIZED (SELECT " + ", ".join(
        f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(["spread"] + FEATURES))
    + " FROM train), feed AS (SELECT pair_id, date, split, 1 AS phase, * EXCLUDE (pair_id, date, split) FROM eval_rows "
      "UNION ALL SELECT t.pair_id, t.date, s.split, 0, t.* EXCLUDE (pair_id, date, split) FROM train t "
      "CROSS JOIN (SELECT unnest(['validation', 'test', 'holdout_2025']) AS split) s), "
      "totals AS (SELECT pair_id, date, split, phase, " + " + ".join(
        f"({c} - m{i}) / d{i}" for i, c in enumerate(["spread"] + FEATURES)) + " AS v FROM feed, scale) "
    "SELECT pair_id, date, split, phase, CASE WHEN count(*) OVER f = %d THEN %d END AS length, "
    "CASE WHEN count(*) OVER f = %d THEN sum(v) OVER f END AS total FROM totals "
    "WINDOW f AS (PARTITION BY pair_id, split ORDER BY phase, date ROWS BETWEEN %d PRECEDING AND CURRENT ROW)"
    % (FC.sequence_length, FC.sequence_length * (1 + len(FEATURES)), FC.sequence_length, FC.sequence_length - 1))
INPUTS = ["spread"] + FEATURES
add("m06_m08_fitted_inputs", lambda r, s, sf: L.fitted_inputs(r.features, FC),
    "source column fill:6 mean:6 std:6",
    " UNION ALL ".join(
        f"SELECT 'train' AS source, '{c}' AS \"column\", median({c}) AS fill, avg({c}) AS mean, "
        f"stddev_pop({c}) AS std FROM train" for c in INPUTS))
add("m06_m08_inputs_with_gaps",
    lambda r, s, sf: L.fitted_inputs(_features(r, drop_missing_rows=False), FC),
    "source column fill:6 mean:6 std:6",
    " UNION ALL ".join(
        f"SELECT 'train' AS source, '{c}' AS \"column\", fill, avg(coalesce(x, fill)) AS mean, "
        f"stddev_pop(coalesce(x, fill)) AS std FROM (SELECT {c} AS x, median({c}) OVER () AS fill FROM feature_rows "
        "WHERE split = 'train' AND target_next_day_spread IS NOT NULL) GROUP BY fill" for c in INPUTS))
add("m09_train_validation_for_test",
    lambda r, s, sf: M.rolling_mean_forecast(r.features, replace(FC, train_validation_for_test=True)).filter(
        "split = 'test'"),
    "pair_id feature_date:d split prediction:6 training_split_source training_observation_count:i",
    f"""SELECT pair_id, feature_date, split, prediction, 'train+validation' AS training_split_source,
          (SELECT count(*) FROM features WHERE split IN ('train', 'validation')) AS training_observation_count FROM (
        SELECT pair_id, date AS feature_date, split, CASE WHEN count(spread) OVER f = {FC.rolling_window}
          THEN avg(spread) OVER f END AS prediction FROM features WHERE split IN ('train', 'validation', 'test')
        WINDOW f AS (PARTITION BY pair_id ORDER BY split = 'test', date
          ROWS BETWEEN {FC.rolling_window} PRECEDING AND 1 PRECEDING)) WHERE split = 'test'""")
def _all_models(r):
    return reduce(DataFrame.unionByName, [r.forecast(m) for m in Settings().models])


add("m10_all_models", lambda r, s, sf: _all_models(r), PREDICTION)
add("m10_all_models_rows", lambda r, s, sf: _finite(_all_models(r)),
    SHAPE, " UNION ALL ".join(_shape_sql(m, f) for m, f in (
        ("naive", "prediction IS NOT NULL"), ("arima", "true"), ("boosted_trees", "true"), ("recurrent", _LONG)))
    + " UNION ALL SELECT *, prediction IS NOT NULL FROM predictions WHERE model = 'rolling_mean'")
add("m10_predictions", lambda r, s, sf: r.predictions, PREDICTION, "SELECT * FROM predictions")
METRIC = ("model split rmse:6 mae:6 directional_accuracy:6 prediction_correlation:6 bias:6 observation_count:i")
add("m11_m13_forecast_metrics", lambda r, s, sf: M.forecast_metrics(r.predictions), METRIC, "SELECT * FROM metrics")
COMPARISON = ("model validation_rmse:6 validation_mae:6 validation_directional_accuracy:6 test_rmse:6 test_mae:6 "
              "test_directional_accuracy:6 holdout_2025_rmse:6 holdout_2025_mae:6 "
              "holdout_2025_directional_accuracy:6 selected_by_validation selection_rank:i")
add("m14_m15_model_comparison", lambda r, s, sf: M.compare_models(r.metrics, FC), COMPARISON, "SELECT * FROM comparison")
add("m15_rank_maximize",
    lambda r, s, sf: M.rank_models(r.metrics, replace(FC, selection_metric="directional_accuracy",
                                                      selection_direction="maximize")),
    "model selected_by_validation selection_rank:i",
    """SELECT model, selection_rank = 1 AS selected_by_validation, selection_rank FROM (
       SELECT model, row_number() OVER (ORDER BY directional_accuracy DESC, model) AS selection_rank
       FROM metrics WHERE split = 'validation')""")
add("m16_resolved_model", lambda r, s, sf: M.resolve_model("best_validation", r.comparison, FC), "model",
    "SELECT * FROM best_model")
add("m17_refreshed_comparison", lambda r, s, sf: M.refresh(r.predictions, FC)[2], COMPARISON, "SELECT * FROM comparison")

# --------------------------------------------------------------------------- signals

SIGNAL = ("pair_id ticker_1 ticker_2 model feature_date:d target_date:d split current_spread:6 predicted_spread:6 "
          "current_zscore:6 predicted_zscore:6")


def _signal_input(r):
    return G.signal_input(r.predictions, r.spreads, r.zscores, r.selected,
                          G.single_run(r.traded_models(), SETTINGS.signals), SETTINGS.signals, unique=True)


add("g01_g05_signal_input", lambda r, s, sf: _signal_input(r), SIGNAL, "SELECT * FROM base_input")


def _twice(df, value):
    """Every row, and before it one of the same key with another value."""
    early = df.withColumns({value: F.col(value) + 1.0, "ord": F.lit(0)})
    return early.unionByName(df.withColumn("ord", F.lit(1)))


add("g01_g05_last_context_row",
    lambda r, s, sf: G.signal_input(r.predictions, _twice(r.spreads, "spread"), _twice(r.zscores, "z_score"), r.selected,
                                    G.single_run(r.traded_models(), SETTINGS.signals), SETTINGS.signals),
    SIGNAL, "SELECT * FROM base_input")
add("f01_f13_last_context_row",
    lambda r, s, sf: X.build_features(_twice(r.spreads, "spread"), _twice(r.zscores, "z_score"), r.panel(), SETTINGS.features),
    "date:d pair_id split spread:6 " + " ".join(f"{c}:6" for c in FEATURES), "SELECT * FROM features")
add("g06_signals", lambda r, s, sf: G.generate_signals(_signal_input(r)),
    f"{SIGNAL} signal_action signal_state entry_z:6 exit_z:6 stop_loss_z:6 holding_days:i exit_reason",
    "SELECT * FROM base_signals")
COUNTS = [f"{a}_count" for a in G.ACTIONS]
add("g07_signal_summary", lambda r, s, sf: G.signal_summary(r.signals),
    "model split pair_count:i signal_rows:i " + " ".join(f"{c}:i" for c in COUNTS) + " final_open_positions:i",
    "SELECT model, split, count(DISTINCT pair_id) AS pair_count, count(*) AS signal_rows, "
    + ", ".join(f"count(*) FILTER (WHERE signal_action = '{a}') AS {a}_count" for a in G.ACTIONS)
    + """, count(DISTINCT pair_id) FILTER (WHERE last AND signal_state <> 'flat') AS final_open_positions
       FROM (SELECT *, rn = max(rn) OVER (PARTITION BY model, split, pair_id) AS last FROM base_signals)
       GROUP BY model, split""")

# --------------------------------------------------------------------------- backtest

BT = SETTINGS.backtest
add("b01_b02_prepared_signals", lambda r, s, sf: B.prepare_signals(r.signals, r.selected, BT),
    "execution_date:d model pair_id split signal_action exit_reason", "SELECT * FROM base_prepared")
add("b03_hedge_ratios", lambda r, s, sf: B.hedge_ratios(r.spread_diagnostics, r.spreads, r.selected),
    "pair_id hedge_ratio_beta:6", "SELECT * FROM ratios")
add("b04_leg_prices", lambda r, s, sf: B.pair_prices(r.selected, r.prices, r.spreads, DATA, unique=True),
    "pair_id date:d p1:6 p2:6", "SELECT * FROM legs")
add("b05_simulation_calendar", lambda r, s, sf: r.backtest.calendar, "date:d", "SELECT * FROM base_calendar")


def _admitted(r):
    return B.admit(B.priced_events(r.backtest.prepared, r.leg_prices), BT)


add("b06_admitted_trades", lambda r, s, sf: _admitted(r),
    "model pair_id side entry_date:d exit_date:d entry_price_1:6 entry_price_2:6 exit_price_1:6 exit_price_2:6 exit_reason",
    "SELECT * FROM base_positions")
add("b07_position_sizes", lambda r, s, sf: r.backtest.positions,
    "model pair_id side entry_date:d hedge_ratio_beta:6 shares_1:6 shares_2:6", "SELECT * FROM base_positions")
add("b08_b09_marks", lambda r, s, sf: r.backtest.days.filter("marked"),
    "model pair_id entry_date:d date:d pnl:4 short_value:4", "SELECT * FROM base_days WHERE marked")
add("b10_b11_trade_log", lambda r, s, sf: r.trade_log,
    "pair_id ticker_1 ticker_2 model side entry_date:d exit_date:d entry_price_1:6 entry_price_2:6 exit_price_1:6 "
    "exit_price_2:6 hedge_ratio_beta:6 gross_pnl:4 commission_cost:4 slippage_cost:4 borrow_cost:4 transaction_cost:4 "
    "net_pnl:4 holding_days:i exit_reason", "SELECT * FROM base_trades")
add("b12_daily_pnl", lambda r, s, sf: r.daily_pnl,
    "date:d model gross_pnl:4 transaction_cost:4 net_pnl:4 cumulative_net_pnl:4 equity:4", "SELECT * FROM base_daily")
add("b12_equity_curves", lambda r, s, sf: B.equity_curves(r.backtest.daily_pnl),
    "date:d model cumulative_net_pnl:4 equity:4", "SELECT * FROM base_daily")
add("b13_exposure", lambda r, s, sf: r.exposure,
    "date:d model gross_exposure:4 net_exposure:4 long_exposure:4 short_exposure:4 active_positions:i turnover:4",
    "SELECT * FROM base_exposure")
add("b14_open_positions", lambda r, s, sf: r.backtest.open_positions,
    "date:d model pair_id ticker_1 ticker_2 side entry_date:d entry_price_1:6 entry_price_2:6 last_price_1:6 "
    "last_price_2:6 hedge_ratio_beta:6 shares_1:6 shares_2:6 gross_exposure:4 net_exposure:4 unrealized_gross_pnl:4 "
    "accrued_borrow_cost:4 holding_days:i", "SELECT * FROM base_open")

# --------------------------------------------------------------------------- analytics

RETURNS = " ".join(f"{c}:{4 if c == 'total_return' else 6}" for c in A.RETURN_METRICS)
CORE = (f"{RETURNS} win_rate:6 profit_factor:6 average_holding_period:6 turnover:4 average_gross_exposure:4 "
        "average_net_exposure:4 number_of_trades:i observation_count:i")
add("a01_a03_drawdown_series",
    lambda r, s, sf: A.drawdown_series(A.equity_frame(r.split_frames["daily_pnl"], r.daily_pnl.drop("net_pnl"))),
    "date:d model split equity:4 daily_return:6 cumulative_return:6 running_peak_equity:4 drawdown:6 "
    "max_drawdown_to_date:6", "SELECT * FROM base_drawdowns")
add("a02_equity_only_returns",
    lambda r, s, sf: A.drawdown_series(A.equity_frame(None, r.daily_pnl.select("date", "model", "equity"))),
    "date:d model split daily_return:6 drawdown:6",
    """SELECT date, model, 'all' AS split, coalesce(equity / nullif(lag(equity) OVER w, 0) - 1, 0) AS daily_return,
       equity / nullif(max(equity) OVER w, 0) - 1 AS drawdown
       FROM base_daily WINDOW w AS (PARTITION BY model ORDER BY date)""")
add("a05_a09_return_metrics", lambda r, s, sf: A.return_metrics(r.drawdowns, SETTINGS.analytics),
    f"model split {RETURNS} observation_count:i", "SELECT * FROM base_returns")
TRADE = ("model split number_of_trades:i win_rate:6 average_trade_pnl:4 median_trade_pnl:4 profit_factor:6 "
         "average_holding_period:6 gross_profit:4 gross_loss:4 exit_reason_counts")
def _trade_metrics(trades):
    return A.trade_metrics(trades).withColumn(
        "no_loss", F.coalesce(F.col("profit_factor") == float("inf"), F.lit(False)))


add("a10_a11_trade_metrics", lambda r, s, sf: _trade_metrics(r.split_frames["trade_log"]), f"{TRADE} no_loss",
    "SELECT *, gross_loss = 0 AND gross_profit > 0 AS no_loss FROM base_trade_metrics")
add("a10_infinite_profit_factor",
    lambda r, s, sf: _trade_metrics(r.split_frames["trade_log"].filter("net_pnl > 0")),
    "model split number_of_trades:i gross_profit:4 no_loss",
    """SELECT model, split, count(*) AS number_of_trades, sum(net_pnl) AS gross_profit, true AS no_loss FROM (
       SELECT model, 'all' AS split, net_pnl FROM base_split_trades UNION ALL
       SELECT model, split, net_pnl FROM base_split_trades WHERE split IS NOT NULL AND split <> 'all')
       WHERE net_pnl > 0 GROUP BY model, split""")
add("a12_exposure_metrics", lambda r, s, sf: A.exposure_metrics(r.split_frames["exposure"]),
    "model split average_gross_exposure:4 average_net_exposure:4 max_gross_exposure:4 average_active_positions:6 "
    "turnover:4 average_daily_turnover:4 observation_count:i", "SELECT * FROM base_exposure_metrics")
add("a04_a13_backtest_metrics",
    lambda r, s, sf: A.backtest_metrics(r.drawdowns, r.split_frames["trade_log"], r.split_frames["exposure"],
                                        SETTINGS.analytics),
    f"model split {CORE}", "SELECT * FROM base_metrics")
step("summary", """SELECT *, row_number() OVER (ORDER BY sharpe_ratio DESC NULLS LAST, total_return DESC NULLS LAST, model)
 AS performance_rank FROM base_metrics WHERE split = 'all'""")
add("a14_performance_summary", lambda r, s, sf: A.performance_summary(r.backtest_metrics),
    f"model {CORE} performance_rank:i".replace(" observation_count:i", ""), "SELECT * FROM summary")

# --------------------------------------------------------------------------- robustness

GRID = ("scenario_id entry_z:6 exit_z:6 stop_loss_z:6 commission_bps:6 slippage_bps:6 zscore_window:i signal_model")


def _grid_coverage(r):
    best = M.best_validation_model(r.metrics, FC)
    _, resolved = R.scenario_runs(r.grid, best, SETTINGS.signals)
    counts = r.predictions.groupBy("model").agg(F.count(F.lit(1)).alias("forecast_rows"))
    return resolved.join(counts, "model", "left")


add("r01_r02_scenario_grid", lambda r, s, sf: _grid_coverage(r), f"{GRID} model forecast_rows:i",
    """SELECT r.*, n AS forecast_rows FROM resolved r LEFT JOIN (SELECT model, count(*) AS n FROM predictions
       GROUP BY model) USING (model)""")
add("r03_r06_robustness_results", lambda r, s, sf: r.robustness_results,
    f"scenario_id model split {CORE} {GRID.replace('scenario_id ', '')}", "SELECT * FROM robustness")
add("r04_r05_split_daily_pnl", lambda r, s, sf: r.split_frames["daily_pnl"], "date:d model split net_pnl:4",
    "SELECT * FROM base_split_daily")
add("r04_r05_split_trades", lambda r, s, sf: r.split_frames["trade_log"],
    "entry_date:d model pair_id split net_pnl:4", "SELECT * FROM base_split_trades")
RB = SETTINGS.robustness
step("valid_results", f"SELECT * FROM robustness WHERE split = '{RB.selection_split}'")
add("r07_r09_headline_scenarios",
    lambda r, s, sf: r.robustness_summary.filter(F.col("summary_item").isin(*R.ITEMS[:3])),
    f"summary_item selection_split selection_metric scenario_id model split value:6 notes {CORE.replace(':i', ':6')}",
    f"""SELECT * FROM (SELECT 'best_validation_scenario' AS summary_item, 'validation' AS selection_split,
          '{RB.selection_metric}' AS selection_metric, {RB.selection_metric} AS value,
          'Selected using validation {RB.selection_metric}.' AS notes, * FROM valid_results
          WHERE {RB.selection_metric} IS NOT NULL ORDER BY {RB.selection_metric} DESC, scenario_id, model LIMIT 1)
        UNION ALL BY NAME SELECT * FROM (SELECT 'worst_validation_drawdown_scenario' AS summary_item,
          'validation' AS selection_split, '{RB.selection_metric}' AS selection_metric, max_drawdown AS value,
          'Most negative validation drawdown across scenarios.' AS notes, * FROM valid_results
          WHERE max_drawdown IS NOT NULL ORDER BY max_drawdown, scenario_id, model LIMIT 1)
        UNION ALL BY NAME SELECT 'median_validation_performance' AS summary_item, 'validation' AS selection_split,
          'validation' AS split, '{RB.selection_metric}' AS selection_metric, median({RB.selection_metric}) AS value,
          'Median across validation scenario rows.' AS notes,
          {", ".join(f"median({c}) AS {c}" for c in A.CORE_METRICS)} FROM valid_results""")
add("r10_cost_sensitivity",
    lambda r, s, sf: r.robustness_summary.filter(F.col("summary_item") == R.ITEMS[3]),
    "summary_item split value:6 notes",
    f"""SELECT 'transaction_cost_sensitivity' AS summary_item, 'validation' AS split, hi - lo AS value,
        format('Validation {RB.selection_metric} median changed from {{:.6g}} at {{:.6g}} bps to {{:.6g}} at {{:.6g}} bps.',
          lo, b0, hi, b1) AS notes FROM (
        SELECT arg_min(m, bps) AS lo, arg_max(m, bps) AS hi, min(bps) AS b0, max(bps) AS b1 FROM (
          SELECT commission_bps + slippage_bps AS bps, median({RB.selection_metric}) AS m FROM valid_results
          WHERE {RB.selection_metric} IS NOT NULL GROUP BY 1))""")
_vary = ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in R.PARAMETERS)
_tight = ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) FILTER (WHERE place <= top) = 1 "
                   f"THEN '{c}' END" for c in R.PARAMETERS)
add("r11_parameter_concentration",
    lambda r, s, sf: r.robustness_summary.filter(F.col("summary_item") == R.ITEMS[4]),
    "summary_item split value:6 notes",
    f"""SELECT 'parameter_concentration' AS summary_item, 'validation' AS split,
        len(string_split(nullif(narrow, ''), ',')) AS k, coalesce(k, 0) / len(string_split(varied, ',')) AS value,
        'concentrated=' || CASE WHEN value >= 0.75 AND top < total THEN 'true' ELSE 'false' END || '; top_rows=' || top
          || '; narrow_parameters=' || coalesce(nullif(narrow, ''), 'none') AS notes
        FROM (SELECT concat_ws(',', {_vary}) AS varied, concat_ws(',', {_tight}) AS narrow, max(top) AS top,
          max(total) AS total FROM (
          SELECT *, greatest(1, ceil(total * {RB.concentration_top_fraction}))::BIGINT AS top FROM (
          SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY {RB.selection_metric} DESC, scenario_id, model)
            AS place FROM valid_results WHERE {RB.selection_metric} IS NOT NULL)))""")
add("r12_robustness_summary", lambda r, s, sf: r.robustness_summary,
    "summary_item selection_split selection_metric value:6 notes",
    " UNION ALL ".join(
        f"SELECT summary_item, 'validation' AS selection_split, '{RB.selection_metric}' AS selection_metric, value, notes "
        f"FROM ({q.sql}) i" for q in ALL if q.name in (
            "r07_r09_headline_scenarios", "r10_cost_sensitivity", "r11_parameter_concentration")))


def _number_texts(r, s, sf):
    """Prices over many powers of ten, as the notes and ids write them."""
    powers = F.array(*[F.lit(x) for x in POWERS])
    value = F.sqrt("l_extendedprice") * F.element_at(powers, F.col("l_linenumber").cast("int"))
    rows = driver.table(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, -value).otherwise(value).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", general_text(F.col("v")).alias("six"), float_text(F.col("v")).alias("whole"))


POWERS = (1e-9, 1e-6, 1e-4, 1e-2, 1.0, 1e4, 1e15)
add("r10_e14_number_text", _number_texts, "l_orderkey:i l_linenumber:i six whole",
    f"""SELECT l_orderkey, l_linenumber, printf('%.6g', v) AS six, v::VARCHAR AS whole FROM (
        SELECT l_orderkey, l_linenumber, sqrt(l_extendedprice) * list_extract({list(POWERS)}::DOUBLE[], l_linenumber)
          * CASE WHEN l_discount > 0.05 THEN -1 ELSE 1 END AS v FROM lineitem)""")

# --------------------------------------------------------------------------- regimes

RG = SETTINGS.regimes
FLAGS = " ".join(n for n, _ in RG.regimes())
add("e03_e06_market_features", lambda r, s, sf: E.market_features(r.proxy, RG),
    "date:d market_return:6 realized_volatility:6 low_volatility_threshold:6 high_volatility_threshold:6 "
    "bull_market bear_market", "SELECT * FROM market_features")
add("e04_full_sample_thresholds",
    lambda r, s, sf: E.market_features(r.proxy, replace(RG, quantile_method="full_sample")),
    "date:d realized_volatility:6 low_volatility_threshold:6 high_volatility_threshold:6",
    f"""SELECT date, realized_volatility, quantile_cont(realized_volatility, {RG.low_quantile}) OVER () AS
        low_volatility_threshold, quantile_cont(realized_volatility, {RG.high_quantile}) OVER () AS
        high_volatility_threshold FROM market_vol""")
add("e01_e08_regime_labels", lambda r, s, sf: r.labels,
    "date:d split market_proxy market_return:6 realized_volatility:6 low_volatility_threshold:6 "
    f"high_volatility_threshold:6 volatility_regime market_trend_regime {FLAGS}", "SELECT * FROM day_labels")
PERFORMANCE = ("model regime regime_type start_date:d end_date:d label_days:i number_of_trading_days:i "
               f"minimum_observations:i meets_minimum_observations {RETURNS} net_pnl:4 number_of_trades:i "
               "trade_attribution_method average_gross_exposure:4 average_net_exposure:4 "
               "average_active_positions:6 turnover:4")
add("e09_e10_regime_performance", lambda r, s, sf: r.regime_performance, PERFORMANCE, "SELECT * FROM regime_performance")
add("e11_special_periods", lambda r, s, sf: r.regime_performance.filter("regime_type = 'special_period'"), PERFORMANCE,
    "SELECT * FROM regime_performance WHERE regime_type = 'special_period'")
_m = RG.ranking_metric
_vols = "('high_volatility', 'low_volatility', 'normal_volatility')"
step("eligible", "SELECT * FROM regime_performance WHERE meets_minimum_observations")
_cols = ", ".join(A.RETURN_METRICS) + ", net_pnl, number_of_trading_days, number_of_trades, average_gross_exposure, average_active_positions"
step("share", f"""SELECT *, abs(net_pnl) / sum(abs(net_pnl)) OVER (PARTITION BY model) AS part FROM eligible
 WHERE regime IN {_vols}""")
NUMBER = r"=(-?[0-9][0-9.e+-]*|nan)(;|\.$)"


def _note_numbers():
    names = {"hv": f"high_volatility {_m}", "lv": f"low_volatility {_m}", "hp": "high_net_pnl", "lp": "low_net_pnl"}
    return {k: F.when(F.col("summary_item") == "high_vs_low_volatility", F.regexp_extract(
        "notes", f"{name}{NUMBER}", 1).try_cast("double")) for k, name in names.items()}


def _of_regime(column: str, regime: str) -> str:
    return f"max({column}) FILTER (WHERE regime = '{regime}_volatility')"


add("e12_e14_regime_summary",
    # Numbers of the volatility note are compared as numbers, its words as text.
    lambda r, s, sf: r.regime_summary.withColumns(_note_numbers() | {"notes": F.regexp_replace(
        "notes", NUMBER, "=#$2")}),
    f"summary_item model regime metric value:6 notes hv:6 lv:6 hp:4 lp:4 {RETURNS} net_pnl:4 number_of_trading_days:i number_of_trades:i "
    "average_gross_exposure:4 average_active_positions:6",
    f"""SELECT u.*, hv, lv, hp, lp FROM (SELECT * FROM (SELECT 'best_regime' AS summary_item, model, regime, '{_m}' AS metric, {_m} AS value,
          'Best regime by {_m} among rows meeting minimum observations.' AS notes, {_cols} FROM eligible
          WHERE {_m} IS NOT NULL ORDER BY {_m} DESC, model, regime LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'worst_drawdown_regime', model, regime, 'max_drawdown', max_drawdown,
          'Most negative max drawdown among rows meeting minimum observations.', {_cols} FROM eligible
          WHERE max_drawdown IS NOT NULL ORDER BY max_drawdown, model, regime LIMIT 1)
        UNION ALL SELECT 'performance_concentration', model, regime, 'absolute_net_pnl_share', part,
          printf('concentrated=%s; top volatility regime %s accounts for %.2f%% of absolute net PnL across high/low/normal volatility buckets.',
            CASE WHEN part >= 0.6 THEN 'true' ELSE 'false' END, regime, part * 100), {_cols} FROM (
          SELECT * FROM share QUALIFY row_number() OVER (PARTITION BY model ORDER BY part DESC, regime) = 1)
        UNION ALL SELECT 'holdout_2025_performance', model, regime, '{_m}', {_m}, 'Evaluation-only 2025 holdout performance.',
          {_cols} FROM regime_performance WHERE regime = 'holdout_2025'
        UNION ALL SELECT 'high_vs_low_volatility', model, 'high_vs_low_volatility', '{_m}',
          max({_m}) FILTER (WHERE regime = 'high_volatility') - max({_m}) FILTER (WHERE regime = 'low_volatility'),
          'high_volatility {_m}=#; low_volatility {_m}=#; high_net_pnl=#; low_net_pnl=#.',
          {", ".join("NULL" for _ in _cols.split(","))} FROM regime_performance GROUP BY model) u
        LEFT JOIN (SELECT model, 'high_vs_low_volatility' AS summary_item,
            {_of_regime(_m, "high")} AS hv, {_of_regime(_m, "low")} AS lv, {_of_regime("net_pnl", "high")} AS hp,
            {_of_regime("net_pnl", "low")} AS lp FROM regime_performance GROUP BY model) n
          ON n.model = u.model AND n.summary_item = u.summary_item""")

# --------------------------------------------------------------------------- report tables

add("t01_selected_model", lambda r, s, sf: T.selected_model(r.comparison, r.metrics, FC), "model", "SELECT * FROM best_model")
add("t01_ranked_model",
    lambda r, s, sf: T.selected_model(r.comparison.withColumn("selected_by_validation", F.lit(False)), r.metrics, FC),
    "model", "SELECT * FROM best_model")
add("t01_measured_model",
    lambda r, s, sf: T.selected_model(r.comparison.withColumns({
        "selected_by_validation": F.lit(False), "selection_rank": F.lit(None).cast("int")}), r.metrics, FC),
    "model", "SELECT * FROM best_model")
add("t02_holdout_table",
    lambda r, s, sf: T.holdout_table(r.backtest_metrics, r.regime_performance,
                                     r.regime_performance.filter("regime_type = 'special_period'"), r.comparison),
    "source model split regime total_return:6 sharpe_ratio:6 max_drawdown:6 number_of_trades:i",
    "SELECT *, 'backtest_metrics' AS source, '' AS regime FROM base_metrics WHERE split = 'holdout_2025'")
add("t02_holdout_table_fallback",
    lambda r, s, sf: T.holdout_table(r.backtest_metrics.filter("split = 'all'"), r.regime_performance,
                                     r.regime_performance.filter("regime_type = 'special_period'"), r.comparison),
    "source model split regime total_return:6 sharpe_ratio:6 max_drawdown:6 number_of_trades:i",
    "SELECT *, 'regime_performance' AS source, '' AS split FROM regime_performance WHERE regime = 'holdout_2025'")
add("t02_holdout_from_special_periods",
    lambda r, s, sf: T.holdout_table(r.backtest_metrics.filter("split = 'all'"), r.regime_performance.filter(F.lit(False)),
                                     r.regime_performance.filter("regime = 'holdout_2025'"), r.comparison),
    "source model split regime total_return:6 sharpe_ratio:6 max_drawdown:6 number_of_trades:i",
    "SELECT *, 'special_period_performance' AS source, '' AS split FROM regime_performance WHERE regime = 'holdout_2025'")
add("t02_holdout_from_comparison",
    lambda r, s, sf: T.holdout_table(r.backtest_metrics.filter("split = 'all'"), r.regime_performance.filter(F.lit(False)),
                                     r.regime_performance.filter(F.lit(False)), r.comparison),
    "source model split regime total_return:6 holdout_2025_rmse:6 holdout_2025_mae:6",
    """SELECT *, 'model_comparison' AS source, 'holdout_2025' AS split, '' AS regime, NULL AS total_return
       FROM comparison""")
add("t03_metric_row",
    lambda r, s, sf: T.metric_row(r.backtest_metrics, T.selected_model(r.comparison, r.metrics, FC), "test"),
    f"model split {CORE}", """SELECT * FROM base_metrics WHERE split = 'test'
       ORDER BY model = (SELECT model FROM best_model) DESC, sharpe_ratio DESC NULLS LAST,
         total_return DESC NULLS LAST, model LIMIT 1""")
add("t04_risk_row",
    lambda r, s, sf: T.risk_row(r.backtest_metrics, r.drawdowns, T.selected_model(r.comparison, r.metrics, FC)),
    "model split date:d drawdown:6",
    """SELECT model, split, NULL::DATE AS date, max_drawdown AS drawdown FROM base_metrics WHERE split = 'all'
       ORDER BY model = (SELECT model FROM best_model) DESC, sharpe_ratio DESC NULLS LAST,
         total_return DESC NULLS LAST, model LIMIT 1""")
add("t04_exposure_row",
    lambda r, s, sf: T.exposure_row(A.exposure_metrics(r.split_frames["exposure"]),
                                    T.selected_model(r.comparison, r.metrics, FC)),
    "model split average_gross_exposure:4 average_net_exposure:4 max_gross_exposure:4 average_active_positions:6",
    """SELECT * FROM base_exposure_metrics WHERE split = 'all'
       ORDER BY model = (SELECT model FROM best_model) DESC, model LIMIT 1""")
add("t04_best_scenario",
    lambda r, s, sf: T.headline(r.robustness_summary, R.ITEMS[0], "scenario_id", "model", "selection_metric", "value"),
    "scenario_id model selection_metric value:6",
    f"""SELECT scenario_id, model, '{RB.selection_metric}' AS selection_metric, {RB.selection_metric} AS value
        FROM valid_results WHERE {RB.selection_metric} IS NOT NULL
        ORDER BY {RB.selection_metric} DESC, scenario_id, model LIMIT 1""")
add("t04_best_regime",
    lambda r, s, sf: T.headline(r.regime_summary, "best_regime", "regime", "model", "metric", "value"),
    "regime model metric value:6",
    f"""SELECT regime, model, '{_m}' AS metric, {_m} AS value FROM eligible WHERE {_m} IS NOT NULL
        ORDER BY {_m} DESC, model, regime LIMIT 1""")
add("t05_top_scenarios", lambda r, s, sf: T.top_scenarios(r.robustness_results, 20),
    f"scenario_id model split sharpe_ratio:6",
    "SELECT * FROM valid_results WHERE sharpe_ratio IS NOT NULL ORDER BY sharpe_ratio DESC, scenario_id, model LIMIT 20")
add("t05_top_regimes", lambda r, s, sf: T.top_regimes(r.regime_performance, 20),
    "model regime sharpe_ratio:6",
    "SELECT * FROM regime_performance WHERE sharpe_ratio IS NOT NULL ORDER BY sharpe_ratio DESC, model, regime LIMIT 20")
add("t05_models_by_rmse", lambda r, s, sf: T.top_rows(r.comparison, "validation_rmse", 20, "model", ascending=True),
    "model validation_rmse:6", "SELECT * FROM comparison WHERE validation_rmse IS NOT NULL ORDER BY validation_rmse, model LIMIT 20")
