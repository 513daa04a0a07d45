"""Candidate pairs, their formation statistics, and the selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import clip01, ratio, reasons
from ..functions.lagtest import unit_root, with_tau_p
from ..functions.stats import spread_test, two_sided_normal
from ..params import PairParams
from .panel import price_panel, price_vectors, with_vectors
from .tiles import pair_moments

IDENTITY = ("pair_id", "ticker_1", "ticker_2", "sector_1", "sector_2", "industry_1",
            "industry_2", "company_name_1", "company_name_2", "pair_liquidity")


def candidate_pairs(universe: DataFrame, same_sector_only: bool = True,
                    block_size: int = 64) -> DataFrame:
    """Ticker pairs in alphabetical order, within a sector or over the whole universe.

    An equi-join on (sector, cell). A ticker hashes to one of n blocks, n growing with its
    sector (about ``block_size`` tickers each), and meets block ``j`` in cell (i, j), i <= j,
    so even one sector holding most tickers is spread over n*(n+1)/2 cells. The inequality
    keeps each pair once. Only tickers and liquidity go through that join; names and
    industries are attached by ticker.
    """
    base = universe.select(
        "ticker", F.trim("sector").alias("key"),
        F.col("average_daily_dollar_volume").cast("double").alias("liquidity"))
    if same_sector_only:
        base = base.filter(F.col("key") != "")
    else:
        base = base.withColumn("key", F.lit("*"))
    sizes = base.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("blocks"))
    base = base.join(sizes, "key").withColumn(
        "block", F.pmod(F.xxhash64("ticker"), F.col("blocks")).cast("int"))
    sides = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*",
        F.least("block", "other").alias("row"), F.greatest("block", "other").alias("column"),
    )

    def side(n: int) -> DataFrame:
        return sides.select("key", "row", "column", *[
            F.col(c).alias(f"{c}_{n}") for c in ("ticker", "liquidity", "block")
        ])

    def names(n: int) -> DataFrame:
        return universe.select(*[F.col(c).alias(f"{c}_{n}") for c in ("ticker", "company_name", "sector", "industry")])

    # Two tickers of one block share several cells; only the diagonal one counts.
    matched = side(1).join(side(2), ["key", "row", "column"]).filter(
        (F.col("ticker_1") < F.col("ticker_2"))
        & ((F.col("block_1") != F.col("block_2")) | (F.col("row") == F.col("column")))
    )
    both = F.col("liquidity_1").isNotNull() & F.col("liquidity_2").isNotNull()
    return matched.join(names(1), "ticker_1").join(names(2), "ticker_2").select(
        F.concat_ws("-", "ticker_1", "ticker_2").alias("pair_id"),
        *IDENTITY[1:9],
        F.when(both, F.least("liquidity_1", "liquidity_2")).alias("pair_liquidity"),
    )


def pair_statistics(pairs: DataFrame, vectors: DataFrame, period) -> DataFrame:
    """Overlap, return correlation, hedge ratio, Dickey-Fuller t and half-life per pair, from the
    moments that tiles of price vectors give.
    """
    sums = pair_moments(pairs, vectors).withColumns({
        "rho": ratio(F.col("r_yx"), F.sqrt(F.col("r_yy") * F.col("r_xx"))),
        "beta": ratio(F.col("c_yx"), F.col("v_x")),
    })
    test = spread_test(F.col("beta"))
    enough = (F.col("overlap_observations") >= 3) & (F.col("m_n") >= 2)
    return sums.select(
        "pair_id", "overlap_observations",
        F.when(enough, F.col("rho")).alias("return_correlation"),
        F.when(F.col("overlap_observations") >= 3, F.col("beta")).alias("hedge_ratio_beta"),
        F.when(F.col("overlap_observations") >= 3,
               F.col("mean_y") - F.col("beta") * F.col("mean_x")).alias("alpha"),
        F.col("mean_y").alias("mean_1"),
        test.statistic.alias("df_statistic"),
        F.when(F.col("overlap_observations") >= 3, test.half_life).alias("half_life_days"),
    )


def evaluate_candidates(candidates: DataFrame, prices: DataFrame, p: PairParams,
                        unique: bool = False, stage=None, keep: tuple = ()) -> DataFrame:
    """Pre-correction diagnostics of every candidate (statistics, correlation filter).

    ``keep`` names further columns of the test (``lags``) to show.

    ``unique`` says that ``prices`` already has one row per (ticker, date). ``stage`` writes
    the price vectors once: both legs read them, and their size is known to the joins.
    """
    panel = price_panel(prices, p.formation, unique=unique)
    vectors = price_vectors(panel, p.formation)
    if stage is not None:
        vectors = stage(vectors)
    listed = prices.select("ticker").distinct()
    stats = pair_statistics(candidates, vectors, p.formation)
    known = (
        candidates
        .join(listed.select(F.col("ticker").alias("ticker_1"), F.lit(True).alias("k1")),
              "ticker_1", "left")
        .join(listed.select(F.col("ticker").alias("ticker_2"), F.lit(True).alias("k2")),
              "ticker_2", "left")
        .join(stats, "pair_id", "left")
        .withColumn("priced", F.col("k1").isNotNull() & F.col("k2").isNotNull())
    )
    overlap = F.coalesce("overlap_observations", F.lit(0)).cast("long")
    rho = F.col("return_correlation")
    why = reasons([
        (~F.col("priced"), "missing_processed_price_data"),
        (F.col("priced") & (overlap < p.min_overlap_days), "insufficient_overlapping_history"),
        (F.col("priced") & rho.isNull(), "missing_return_correlation"),
        (F.col("priced") & (rho < p.min_return_correlation), "below_min_return_correlation"),
    ])
    rows = known.withColumns({"why": why, "overlap": overlap})
    clear = F.size("why") == 0
    short = clear & (F.col("overlap") < 10)
    rows = rows.withColumn("why", F.when(
        short, F.array(F.lit("At least ten overlapping observations are required.")),
    ).otherwise(F.col("why"))).withColumn("passes", F.size("why") == 0)
    rows = rows.withColumns({
        "beta": F.when(F.col("passes"), F.col("hedge_ratio_beta")),
        "hl": F.when(F.col("passes"), F.col("half_life_days")),
    })
    if p.variant == "df":
        rows = rows.withColumn("stat", F.when(F.col("passes"), F.col("df_statistic")))
        rows = rows.withColumn("p_raw", two_sided_normal("stat"))
    else:
        rows = rows.join(cointegration_tests(rows.filter("passes"), vectors, p), "pair_id", "left")
    return rows.select(
        *IDENTITY[:9],
        F.when(F.col("priced"), F.col("pair_liquidity")).alias("pair_liquidity"),
        F.lit(p.formation.start).alias("formation_start"),
        F.lit(p.formation.end).alias("formation_end"),
        (F.col("sector_1") == F.col("sector_2")).alias("same_sector_pair"),
        F.col("overlap").alias("overlap_observations"), "return_correlation",
        F.col("passes").alias("passes_correlation_filter"),
        F.col("p_raw").alias("cointegration_pvalue_raw"),
        F.lit(None).cast("double").alias("cointegration_pvalue_adjusted"),
        F.col("stat").alias("cointegration_test_statistic"),
        F.col("beta").alias("hedge_ratio_beta"), F.col("hl").alias("half_life_days"),
        F.lit(False).alias("selected"),
        F.array_join("why", ";").alias("exclusion_reasons"), *keep,
    )


def cointegration_tests(pairs: DataFrame, vectors: DataFrame, p: PairParams) -> DataFrame:
    """Engle-Granger statistic (``stat``), p-value (``p_raw``) and chosen lags of pairs with their
    statistics (``pair_statistics``). A pair whose legs fit each other exactly has p-value 0 and no statistic of
    its own (minus infinity).
    """
    fit = pairs.select("pair_id", "ticker_1", "ticker_2", F.coalesce("hedge_ratio_beta", F.lit(0.0)).alias("beta"),
                       F.coalesce("alpha", "mean_1").alias("alpha"))
    arrays = aligned_arrays(fit, vectors, p.formation, keep=("alpha", "beta"))
    series = arrays.select("pair_id", "y", F.zip_with(
        "y", "x", lambda a, b: (a - F.col("alpha")) - F.col("beta") * b).alias("s"))

    def total(name, of):
        return F.aggregate(name, F.lit(0.0), lambda s, v: s + of(v))

    varied = total("y", lambda v: v * v) - F.pow(total("y", lambda v: v), F.lit(2)) / F.size("y")
    exact = series.select("pair_id", (total("s", lambda v: v * v) <= varied * (100 * math.sqrt(2.0 ** -52))).alias("exact"))
    tests = unit_root(series.select("pair_id", "s"), False, p.formation.days, p.max_lag)
    found = with_tau_p(exact.join(tests, "pair_id", "left"), "statistic", "p", 2)
    return found.select(
        "pair_id", F.when(F.col("exact"), F.lit(float("-inf"))).otherwise(F.col("statistic")).alias("stat"),
        F.when(F.col("exact"), F.lit(0.0)).otherwise(F.col("p")).alias("p_raw"),
        F.when(~F.col("exact"), F.col("lags")).alias("lags"))


def aligned_arrays(pairs: DataFrame, vectors: DataFrame, period, keep: tuple = ()) -> DataFrame:
    """Aligned log-price arrays, one row per pair, without unfolding the dates."""
    both = F.filter(F.arrays_zip("c1", "c2"), lambda v: v["c1"].isNotNull() & v["c2"].isNotNull())
    return with_vectors(pairs, vectors, ["pair_id", "ticker_1", "ticker_2", *keep]).select(
        "pair_id", *keep, both.alias("v")
    ).select(
        "pair_id", *keep,
        F.transform("v", lambda v: F.ln(v["c1"])).alias("y"),
        F.transform("v", lambda v: F.ln(v["c2"])).alias("x"),
    )


def benjamini_hochberg(df: DataFrame, p_col: str, out: str, family: tuple = ()) -> DataFrame:
    """Adjusted p-values over all non-NULL ``p_col`` of a family.

    The global ranking never runs in one task. Equal p-values share one result, so
    they are counted first; distinct values fall into ordered buckets (linear above
    2^-10, by powers of two below); ranks and suffix minima are taken inside buckets
    and carried across the small bucket table.
    """
    keys = list(family)
    p = F.col("p")
    bucket = F.when(p >= 2.0 ** -10, F.floor(p * 1024)).when(
        p > 0, F.floor(F.log2(p)).cast("long")).otherwise(F.lit(-2000))
    distinct = (
        df.filter(F.col(p_col).isNotNull()).groupBy(*keys, F.col(p_col).alias("p"))
        .agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket.cast("long"))
    )
    buckets = distinct.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"))
    up = Window.partitionBy(*keys).orderBy("bucket")
    buckets = buckets.select(
        *keys, "bucket",
        (F.sum("bn").over(up) - F.col("bn")).alias("before"),
        F.sum("bn").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("p")
    ranked = _same_bucket(distinct, buckets, keys).withColumn(
        "rank", F.col("before") + F.sum("n").over(inside)
    ).withColumn("raw", F.least(p * F.col("total") / F.col("rank"), F.lit(1.0)))
    # Suffix minima as growing frames over the reverse order: linear, not quadratic.
    suffix = Window.partitionBy(*keys, "bucket").orderBy(F.desc("p")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    carried = ranked.groupBy(*keys, "bucket").agg(F.min("raw").alias("low")).withColumn(
        "beyond", F.coalesce(F.min("low").over(later), F.lit(1.0))).drop("low")
    adjusted = _same_bucket(ranked, carried, keys).select(
        *keys, "p", F.least(F.min("raw").over(suffix), F.col("beyond")).alias(out))
    kept = df.drop(out) if out in df.columns else df
    renamed = adjusted.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("p").alias("_p_value"), out)
    # Rows without a p-value take no part: most rows can be such, and one key would hold them all.
    tested = kept.filter(F.col(p_col).isNotNull())
    match = tested[p_col] == renamed["_p_value"]
    for k in keys:
        match = match & tested[k].eqNullSafe(renamed[f"_{k}"])
    found = tested.join(renamed, match).select(*[tested[c] for c in kept.columns], out)
    rest = kept.filter(F.col(p_col).isNull()).withColumn(out, F.lit(None).cast("double"))
    return found.unionByName(rest)


def _same_bucket(rows: DataFrame, table: DataFrame, keys: list) -> DataFrame:
    """Join bucket figures to rows.

    The null-safe comparison adds no filters of its own below the join, so all uses of
    the counted p-values stay the same plan and share one shuffle.
    """
    on = [*keys, "bucket"]
    other = table.select(*[F.col(c).alias(f"_{c}") for c in on],
                         *[c for c in table.columns if c not in on])
    match = rows[on[0]].eqNullSafe(other[f"_{on[0]}"])
    for c in on[1:]:
        match = match & rows[c].eqNullSafe(other[f"_{c}"])
    return rows.join(other, match).drop(*[f"_{c}" for c in on])


def finalize(diagnostics: DataFrame, p: PairParams) -> DataFrame:
    """Append significance and half-life reasons; a pair without any is eligible."""
    order = diagnostics.columns
    adjusted, half_life = F.col("cointegration_pvalue_adjusted"), F.col("half_life_days")
    passed = F.col("passes_correlation_filter")
    added = reasons([
        (passed & (adjusted.isNull() | (adjusted > p.fdr_alpha)),
         "cointegration_fdr_not_significant"),
        (passed & half_life.isNull(), "missing_half_life"),
        (passed & ~half_life.between(p.half_life_min_days, p.half_life_max_days),
         "half_life_out_of_range"),
    ])
    before = F.filter(F.split("exclusion_reasons", ";"), lambda r: r != "")
    found = F.concat(before, added)
    return diagnostics.withColumn("found", found).withColumns({
        "selected": F.size("found") == 0,
        "exclusion_reasons": F.array_join("found", ";"),
    }).select(*order)


def rank_pairs(eligible: DataFrame, p: PairParams) -> DataFrame:
    """Score parts and the weighted score of eligible pairs."""
    middle = (p.half_life_min_days + p.half_life_max_days) / 2.0
    half_range = max((p.half_life_max_days - p.half_life_min_days) / 2.0, 1.0)
    liquidity = F.when(F.col("pair_liquidity") > 0, F.log1p("pair_liquidity"))
    # The largest liquidity of the run: a one-row aggregate keyed by the formation end.
    top = eligible.groupBy("formation_end").agg(F.max(liquidity).alias("top"))
    rows = eligible.join(F.broadcast(top), "formation_end")
    scored = rows.withColumns({
        "p_value_score": clip01(1.0 - F.col("cointegration_pvalue_adjusted") / p.fdr_alpha),
        "correlation_score": clip01(ratio(
            F.col("return_correlation") - p.min_return_correlation,
            F.lit(1.0 - p.min_return_correlation))),
        "half_life_score": clip01(1.0 - F.abs(F.col("half_life_days") - middle) / half_range),
        "liquidity_score": F.when(
            F.col("top") > 0, clip01(F.coalesce(liquidity / F.col("top"), F.lit(0.5)))
        ).otherwise(F.lit(0.5)),
    })
    return scored.withColumn(
        "selection_score",
        0.40 * F.col("p_value_score") + 0.25 * F.col("correlation_score")
        + 0.25 * F.col("half_life_score") + 0.10 * F.col("liquidity_score"),
    ).select(*eligible.columns, "p_value_score", "correlation_score", "half_life_score",
             "liquidity_score", "selection_score")


def rank_order() -> tuple:
    return (F.desc_nulls_last("selection_score"),
            F.asc_nulls_last("cointegration_pvalue_adjusted"),
            F.desc_nulls_last("return_correlation"), F.asc("pair_id"))


def select_pairs(finalized: DataFrame, p: PairParams) -> DataFrame:
    """Best ``top_n_pairs`` eligible pairs (a top-k, not a full sort)."""
    return rank_pairs(finalized.filter("selected"), p).orderBy(*rank_order()).limit(p.top_n_pairs)


def final_diagnostics(finalized: DataFrame, selected: DataFrame) -> DataFrame:
    """Diagnostics after ranking: eligible pairs below the cut get their reason."""
    order = finalized.columns
    # At most top_n_pairs keys, so the broadcast is bounded by that parameter.
    chosen = F.broadcast(selected.select("pair_id", F.lit(True).alias("chosen")))
    rows = finalized.join(chosen, "pair_id", "left").withColumn(
        "chosen", F.coalesce("chosen", F.lit(False)))
    return rows.withColumns({
        "exclusion_reasons": F.when(
            F.col("selected") & ~F.col("chosen"), F.lit("ranked_below_top_n")
        ).otherwise(F.col("exclusion_reasons")),
        "selected": F.col("chosen"),
    }).select(*order)


def adjust_and_finalize(evaluated: DataFrame, p: PairParams) -> DataFrame:
    """Correct over the pairs that passed the correlation filter, then finalize.

    ``evaluated`` is read several times, so pass it as a stage table.
    """
    corrected = benjamini_hochberg(
        evaluated.withColumn("_p", F.when(F.col("passes_correlation_filter"),
                                          F.col("cointegration_pvalue_raw"))),
        "_p", "cointegration_pvalue_adjusted", ("formation_end",),
    )
    return finalize(corrected.select(*evaluated.columns), p)
