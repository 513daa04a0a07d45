"""Report tables: one-row headlines and top-k extracts of the result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..params import ForecastParams

HOLDOUT_NAMES = ("holdout_2025", "final_holdout_2025", "2025_holdout")
HOLDOUT_COLUMNS = ("source", "model", "split", "regime", "total_return", "sharpe_ratio",
                   "max_drawdown", "number_of_trades", "holdout_2025_rmse", "holdout_2025_mae",
                   "holdout_2025_directional_accuracy")


def first_available(frames: list[DataFrame]) -> DataFrame:
    """Rows of the first frame that has any: tag by priority, keep the lowest."""
    tagged = reduce(DataFrame.unionByName,
                    [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)])
    lowest = tagged.select(F.min("_p").alias("m")).scalar()
    return tagged.filter(F.col("_p") == lowest).drop("_p")


def selected_model(comparison: DataFrame, metrics: DataFrame, p: ForecastParams) -> DataFrame:
    """The reported model: flagged, else best ranked, else best validation metric."""
    order = F.asc(p.selection_metric) if p.selection_direction == "minimize" else F.desc(p.selection_metric)
    flagged = comparison.filter("selected_by_validation").orderBy("model").limit(1).select("model")
    ranked = comparison.filter(F.col("selection_rank").isNotNull()).orderBy(
        "selection_rank", "model").limit(1).select("model")
    scored = metrics.filter((F.lower("split") == p.selection_split) & F.col(p.selection_metric).isNotNull())
    return first_available([flagged, ranked, scored.orderBy(order, "model").limit(1).select("model")])


def _as_holdout(df: DataFrame, source: str, **fixed) -> DataFrame:
    text = {"source", "model", "split", "regime"}
    def column(c):
        if c == "source":
            return F.lit(source)
        if c in fixed:
            return F.lit(fixed[c])
        if c in df.columns:
            return F.col(c)
        return F.lit(None)
    return df.select(*[column(c).cast("string" if c in text else "double").alias(c)
                       for c in HOLDOUT_COLUMNS])


def holdout_table(metrics: DataFrame, performance: DataFrame, special: DataFrame,
                  comparison: DataFrame) -> DataFrame:
    """Holdout rows from the best source that has them."""
    return first_available([
        _as_holdout(metrics.filter(F.lower("split").isin("holdout_2025", "2025_holdout")),
                    "backtest_metrics", regime=""),
        _as_holdout(performance.filter(F.lower("regime").isin(*HOLDOUT_NAMES)),
                    "regime_performance", split=""),
        _as_holdout(special.filter(F.lower("regime").isin(*HOLDOUT_NAMES)),
                    "special_period_performance", split=""),
        _as_holdout(comparison, "model_comparison", split="holdout_2025", regime=""),
    ])


def metric_row(frame: DataFrame, model: DataFrame, split: str) -> DataFrame:
    """Row of the named model in a split, else of the best model there.

    Without rows of that split the whole frame is the scope.
    """
    named = model.limit(1).select("model").scalar()
    in_split = frame.filter(F.lower("split") == split) if "split" in frame.columns else frame
    scope = first_available([in_split, frame])
    order = [F.desc_nulls_last(c) for c in ("sharpe_ratio", "total_return") if c in frame.columns]
    return scope.orderBy(F.desc_nulls_last(F.col("model") == named), *order, F.asc("model")).limit(1)


def risk_row(metrics: DataFrame, drawdowns: DataFrame, model: DataFrame) -> DataFrame:
    """Max drawdown of the metric row, else the worst drawdown day."""
    from_metrics = metric_row(metrics, model, "all").filter(F.col("max_drawdown").isNotNull()).select(
        "model", "split", F.lit(None).cast("date").alias("date"), F.col("max_drawdown").alias("drawdown"))
    named = model.limit(1).select("model").scalar()
    seen = drawdowns.filter(F.col("drawdown").isNotNull())
    worst = seen.orderBy(F.desc_nulls_last(F.col("model") == named), F.asc("drawdown"), F.asc("date")).limit(1)
    return first_available([from_metrics, worst.select("model", "split", "date", "drawdown")])


def exposure_row(exposure_metrics: DataFrame, model: DataFrame) -> DataFrame:
    return metric_row(exposure_metrics, model, "all").select(
        "model", "split", "average_gross_exposure", "average_net_exposure", "max_gross_exposure",
        "average_active_positions")


def headline(summary: DataFrame, item: str, *columns: str) -> DataFrame:
    """The summary row of one item."""
    return summary.filter(F.col("summary_item") == item).select(*columns).limit(1)


def top_rows(frame: DataFrame, metric: str, rows: int, *ties: str, ascending: bool = False) -> DataFrame:
    """Best rows by a metric (a top-k, not a full sort)."""
    order = F.asc(metric) if ascending else F.desc(metric)
    return frame.filter(F.col(metric).isNotNull()).orderBy(order, *[F.asc(t) for t in ties]).limit(rows)


def top_scenarios(results: DataFrame, rows: int = 20) -> DataFrame:
    """Best validation scenarios by Sharpe; all splits when none is validation."""
    scope = first_available([results.filter(F.lower("split") == "validation"), results])
    return top_rows(scope, "sharpe_ratio", rows, "scenario_id", "model", "split")


def top_regimes(performance: DataFrame, rows: int = 20) -> DataFrame:
    return top_rows(performance, "sharpe_ratio", rows, "model", "regime")
