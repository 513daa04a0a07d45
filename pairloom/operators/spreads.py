"""Hedge-ratio spreads of selected pairs and their lagged z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import business_days, by_date, full_window, ratio
from ..functions.lagtest import unit_root, with_tau_p
from ..functions.stats import ar1_moments, spread_test, two_sided_normal
from ..params import SpreadParams
from .pairs import aligned_arrays
from .panel import aligned_prices

SERIES = ("date", "pair_id", "ticker_1", "ticker_2", "adjusted_close_1", "adjusted_close_2",
          "log_price_1", "log_price_2", "alpha", "beta", "spread")


def spread_diagnostics(selected: DataFrame, prices: DataFrame, vectors: DataFrame,
                       p: SpreadParams) -> DataFrame:
    """Formation-window fit and quality of each selected pair.

    One aggregate over the aligned rows; formation figures are conditional, so the
    full history is scanned once. Lags run over formation rows only.
    """
    listed = prices.select("ticker").distinct()
    rows = aligned_prices(selected, vectors, p.data)
    inside = F.col("date").between(F.lit(p.formation.start), F.lit(p.formation.end))
    w = Window.partitionBy("pair_id", "inside").orderBy("date")
    rows = rows.withColumn("inside", inside).withColumns({
        "ly": F.ln("adjusted_close_1"), "lx": F.ln("adjusted_close_2"),
    }).withColumns({
        "y": F.when(F.col("inside"), F.col("ly")), "x": F.when(F.col("inside"), F.col("lx")),
        "y1": F.when(F.col("inside"), F.lag("ly").over(w)),
        "x1": F.when(F.col("inside"), F.lag("lx").over(w)),
    })
    sums = rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count("y").alias("n_in"),
        F.min("date").alias("first"), F.max("date").alias("last"),
        ratio(F.covar_samp("y", "x"), F.var_samp("x")).alias("beta"),
        F.avg("y").alias("my"), F.avg("x").alias("mx"),
        F.var_samp("y").alias("vy"), F.var_samp("x").alias("vx"),
        F.covar_samp("y", "x").alias("cyx"), *ar1_moments("y", "x", "y1", "x1"),
    )
    beta = F.col("beta")
    test = spread_test(beta)
    p_df = F.when(F.col("n_in") >= 4, F.when(
        test.gamma.isNull(), F.lit(None)).otherwise(test.statistic))
    fitted = sums.select(
        "pair_id", "beta", (F.col("my") - beta * F.col("mx")).alias("alpha"),
        (F.col("my") - beta * F.col("mx")).alias("mean"),
        F.sqrt(F.greatest(F.col("vy") - 2 * beta * F.col("cyx") + beta * beta * F.col("vx"),
                          F.lit(0.0))).alias("std"),
        p_df.alias("t"), test.half_life.alias("hl"),
        "n_all", "n_in", business_days(F.col("first"), F.col("last")).alias("expected"),
    )
    if p.variant == "df":
        fitted = fitted.withColumn("adf", two_sided_normal("t"))
    else:
        tested = unit_root_tests(selected.join(fitted.select("pair_id", "alpha", "beta"), "pair_id"), vectors, p)
        fitted = fitted.join(tested.select("pair_id", F.col("p_raw").alias("adf")), "pair_id", "left")
    missing = F.when(F.col("expected") > 0, F.greatest(
        F.col("expected") - F.col("n_all"), F.lit(0)) / F.col("expected").cast("double")
    ).otherwise(F.lit(0.0))
    known = (
        selected.select("pair_id", "ticker_1", "ticker_2")
        .join(listed.select(F.col("ticker").alias("ticker_1"), F.lit(1).alias("k1")), "ticker_1", "left")
        .join(listed.select(F.col("ticker").alias("ticker_2"), F.lit(1).alias("k2")), "ticker_2", "left")
        .join(fitted, "pair_id", "left")
    )
    priced = F.col("k1").isNotNull() & F.col("k2").isNotNull()
    good = priced & (F.coalesce("n_in", F.lit(0)) >= 3)

    def kept(column):
        return F.when(good, column)

    return known.select(
        "pair_id", "ticker_1", "ticker_2",
        F.lit(p.formation.start).alias("formation_start"),
        F.lit(p.formation.end).alias("formation_end"),
        kept(beta).alias("beta"), kept(F.col("alpha")).alias("alpha"),
        kept(F.col("mean")).alias("spread_mean_formation"),
        kept(F.col("std")).alias("spread_std_formation"),
        kept(F.col("adf")).alias("adf_p_value_formation"),
        kept(F.col("hl")).alias("half_life_formation"),
        F.coalesce(kept(F.col("n_all")), F.lit(0)).alias("observations"),
        F.coalesce(kept(F.col("n_in")), F.lit(0)).alias("formation_observations"),
        kept(F.round(missing, 6)).alias("missing_ratio"),
        F.when(~priced, F.lit("missing_processed_price_data"))
        .when(~good, F.lit("insufficient_formation_observations"))
        .otherwise(F.lit("")).alias("exclusion_reasons"),
    )


def unit_root_tests(pairs: DataFrame, vectors: DataFrame, p: SpreadParams) -> DataFrame:
    """Statistic (``stat``), p-value (``p_raw``) and chosen lags of the formation spreads of pairs
    with ``alpha`` and ``beta``; spreads of fewer than four rows have none.
    """
    inside = vectors.select("ticker", F.slice(
        "closes", (p.formation.start - p.data.start).days + 1, p.formation.days).alias("closes"))
    arrays = aligned_arrays(pairs, inside, p.formation, keep=("alpha", "beta")).filter(F.size("y") >= 4)
    spread = arrays.select("pair_id", F.zip_with(
        "y", "x", lambda y, x: (y - F.col("alpha")) - F.col("beta") * x).alias("s"))
    found = with_tau_p(unit_root(spread, True, p.formation.days, p.max_lag), "statistic", "p_raw", 1)
    return found.select("pair_id", F.col("statistic").alias("stat"), "p_raw", "lags")


def spread_series(diagnostics: DataFrame, vectors: DataFrame, p: SpreadParams) -> DataFrame:
    """Full-history spread with the frozen formation hedge ratio."""
    fitted = diagnostics.filter(F.col("exclusion_reasons") == "")
    rows = aligned_prices(fitted, vectors, p.data, keep=("alpha", "beta"))
    rows = rows.withColumns({
        "log_price_1": F.ln("adjusted_close_1"), "log_price_2": F.ln("adjusted_close_2"),
    })
    return rows.withColumn(
        "spread", F.col("log_price_1") - F.col("beta") * F.col("log_price_2")
    ).select(*SERIES)


def lagged_zscores(spreads: DataFrame, windows: tuple) -> DataFrame:
    """Mean and deviation of the ``W`` rows before today, and today's z-score.

    All windows share one sort of the pair; their results unfold afterwards.
    """
    spec = by_date("pair_id")

    def stats(w: int):
        before = spec.rowsBetween(-w, -1)
        return F.struct(
            F.lit(w).alias("z_score_window"),
            full_window(F.avg("spread"), F.col("spread"), before, w).alias("rolling_mean_lagged"),
            full_window(F.stddev_samp("spread"), F.col("spread"), before, w)
            .alias("rolling_std_lagged"),
        )

    named = {f"w{w}": stats(w) for w in windows}
    wide = spreads.select("date", "pair_id", "ticker_1", "ticker_2", "spread",
                          *[c.alias(n) for n, c in named.items()])
    rows = wide.select("date", "pair_id", "ticker_1", "ticker_2", "spread",
                       F.inline(F.array(*[F.col(n) for n in named])))
    return rows.select(
        "date", "pair_id", "ticker_1", "ticker_2", "z_score_window",
        "rolling_mean_lagged", "rolling_std_lagged",
        ratio(F.col("spread") - F.col("rolling_mean_lagged"), F.col("rolling_std_lagged"))
        .alias("z_score"),
    )
