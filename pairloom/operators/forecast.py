"""Baseline forecasts, forecast metrics and validation-only model selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import by_date, ratio, top1
from ..functions.statespace import forecast_paths
from ..functions.stats import ar1_fit
from ..params import EVALUATION_SPLITS, ForecastParams

PREDICTIONS = ("pair_id", "ticker_1", "ticker_2", "model", "feature_date", "target_date", "split",
               "prediction", "actual", "forecast_error", "training_split_source",
               "training_observation_count", "spread")
METRICS = ("rmse", "mae", "directional_accuracy", "prediction_correlation", "bias")
COMPARED = ("rmse", "mae", "directional_accuracy")


def evaluation_rows(features: DataFrame) -> DataFrame:
    return features.filter(F.col("split").isin(*EVALUATION_SPLITS))


def training_sources(p: ForecastParams) -> dict:
    """Training set -> evaluation splits it serves. Each set is fitted once."""
    if p.train_validation_for_test:
        return {"train": ("validation", "holdout_2025"), "train+validation": ("test",)}
    return {"train": EVALUATION_SPLITS}


def source_of(split, p: ForecastParams):
    """Training set that serves an evaluation split."""
    out = F.lit("train")
    for source, served in training_sources(p).items():
        out = F.when(split.isin(*served), F.lit(source)).otherwise(out)
    return out


def served_splits(rows: DataFrame, p: ForecastParams, out: str) -> DataFrame:
    """Rows tagged with a training set, repeated for every split it serves."""
    listed = F.create_map(*[x for source, served in training_sources(p).items()
                            for x in (F.lit(source), F.array(*[F.lit(v) for v in served]))])
    return rows.withColumn(out, F.explode(listed[F.col("source")]))


def training_rows(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Training rows tagged with their set (``source``).

    Every split is fitted on the training range; the test split may add the
    validation rows when that is switched on.
    """
    if not p.train_validation_for_test:
        return features.filter(F.col("split") == "train").withColumn("source", F.lit("train"))
    sources = F.when(F.col("split") == "train", F.array(*[F.lit(v) for v in training_sources(p)])).when(
        F.col("split") == "validation", F.array(F.lit("train+validation")))
    rows = features.filter(F.col("split").isin("train", "validation"))
    return rows.withColumn("source", F.explode(sources))


def prediction_table(rows: DataFrame, model: str, features: DataFrame, p: ForecastParams) -> DataFrame:
    """Standard prediction columns of ``rows`` (evaluation rows with ``prediction``)."""
    counts = training_rows(features, p).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("source", source_of(F.col("split"), p))
    rows = rows.join(F.broadcast(counts), "source", "left")  # one row per training set
    return rows.select(
        "pair_id", "ticker_1", "ticker_2", F.lit(model).alias("model"),
        F.col("date").alias("feature_date"), "target_date", "split",
        F.col("prediction").cast("double"), F.col(p.target).alias("actual"),
        (F.col(p.target) - F.col("prediction")).alias("forecast_error"),
        F.col("source").alias("training_split_source"),
        F.coalesce("n", F.lit(0)).alias("training_observation_count"), "spread",
    )


def naive_forecast(features: DataFrame, p: ForecastParams) -> DataFrame:
    rows = evaluation_rows(features).withColumn("prediction", F.col("spread"))
    return prediction_table(rows, "naive", features, p)


def rolling_mean_forecast(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Mean of the last W spreads known before the row.

    History is the training rows plus earlier rows of the same evaluation split; of
    the training rows only the last W known ones can matter. Missing spreads are not
    history, so the frame runs over numbered known values.
    """
    recent = Window.partitionBy("pair_id", "source").orderBy(F.desc("date"))
    train = training_rows(features, p).filter(F.col("spread").isNotNull()).select(
        "pair_id", "source", "date", "spread").withColumn("back", F.row_number().over(recent))
    train = served_splits(train.filter(F.col("back") <= p.rolling_window), p, "split").select(
        "pair_id", "split", "date", "spread", F.lit(0).alias("phase"))
    evaluated = evaluation_rows(features)
    later = evaluated.select("pair_id", "split", "date", "spread", F.lit(1).alias("phase"),
                             "ticker_1", "ticker_2", "target_date", p.target)
    rows = later.unionByName(train, allowMissingColumns=True)
    order = Window.partitionBy("pair_id", "split").orderBy("phase", "date")
    known = F.count("spread").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Rank by known values: the last W known before this row lie in [known-W, known-1].
    rows = rows.withColumn("known", known)
    frame = Window.partitionBy("pair_id", "split").orderBy("known").rangeBetween(-p.rolling_window, -1)
    mean = F.avg("spread").over(frame)
    rows = rows.withColumn("prediction", F.when(F.col("known") >= p.rolling_window, mean))
    return prediction_table(rows.filter("phase = 1").drop("phase", "known"), "rolling_mean", features, p)


def ar1_parameters(features: DataFrame, p: ForecastParams) -> DataFrame:
    """phi, mean and last training value per (pair, training set).

    Spark sums the series; the likelihood search sees one row per pair.
    """
    rows = training_rows(features, p).filter(F.col("spread").isNotNull()).select(
        "pair_id", "source", "date", "spread")
    w = by_date("pair_id", "source")
    rows = rows.withColumn("prior", F.lag("spread").over(w))
    sums = rows.groupBy("pair_id", "source").agg(
        F.count("spread").alias("n"), F.avg("spread").alias("m"),
        F.var_pop("spread").alias("v"), F.covar_pop("spread", "prior").alias("c"),
        F.avg(F.when(F.col("prior").isNotNull(), F.col("spread"))).alias("m1"),
        F.avg("prior").alias("m0"),
        F.min_by("spread", "date").alias("first"), F.max_by("spread", "date").alias("last"),
    )
    steps = F.col("n") - 1
    fit = ar1_fit(
        F.col("n").cast("double"), F.col("n") * F.col("v"),
        steps * (F.col("c") + (F.col("m1") - F.col("m")) * (F.col("m0") - F.col("m"))),
        F.col("first") - F.col("m"), F.col("last") - F.col("m"),
    )
    enough = F.col("n") >= max(3, sum(p.arima_order) + 2)
    fitted = sums.filter(enough & (F.col("v") > 0)).select("pair_id", "source", "m", fit.alias("f"))
    return sums.select("pair_id", "source", "last").join(
        fitted.select("pair_id", "source", F.col("f.phi").alias("phi"),
                      (F.col("m") + F.col("f.mu")).alias("mean")),
        ["pair_id", "source"], "left")


def arima_forecast(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Forecast h = 1..n steps from the end of training, per pair and split.

    For the default order (1,0,0) the likelihood needs six sums per pair and its path has a
    closed form. Any other order goes through the state-space likelihood, all series of a batch
    at once; it gives the same numbers for (1,0,0).
    """
    rows = evaluation_rows(features)
    steps = by_date("pair_id", "split")
    rows = rows.withColumns({"h": F.row_number().over(steps), "source": source_of(F.col("split"), p)})
    if tuple(p.arima_order) == (1, 0, 0):
        rows = rows.join(ar1_parameters(features, p), ["pair_id", "source"], "left")
        path = F.col("mean") + F.pow(F.col("phi"), F.col("h")) * (F.col("last") - F.col("mean"))
        rows = rows.withColumn("prediction", F.coalesce(path, F.col("last")))
        return prediction_table(rows, "arima", features, p)
    rows = rows.join(likelihood_paths(features, rows, p), ["pair_id", "source", "h"], "left")
    return prediction_table(rows, "arima", features, p)


def likelihood_paths(features: DataFrame, rows: DataFrame, p: ForecastParams) -> DataFrame:
    """(pair_id, source, h, prediction) by the exact likelihood fit of each training series.

    A series is a pair's daily history, bounded by the calendar, and travels as one array.
    """
    order = tuple(p.arima_order)
    horizon = rows.groupBy("pair_id", "source").agg(F.max("h").alias("horizon"))
    series = training_rows(features, p).filter(F.col("spread").isNotNull()).groupBy("pair_id", "source").agg(
        F.array_sort(F.collect_list(F.struct("date", "spread"))).alias("days"))
    series = series.join(horizon, ["pair_id", "source"]).select(
        "pair_id", "source", "horizon", F.transform("days", lambda v: v["spread"].cast("double")).alias("series"))

    def run(batches):
        for batch in batches:
            values = [np.asarray(v.as_py(), float) for v in batch.column("series")]
            paths = forecast_paths(values, np.array(batch.column("horizon").to_pylist(), int), order)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pair_id"), batch.column("source"), pa.array(paths, pa.list_(pa.float64()))],
                ["pair_id", "source", "path"])

    paths = series.mapInArrow(run, "pair_id string, source string, path array<double>")
    return paths.select("pair_id", "source", F.posexplode("path").alias("at", "prediction")).select(
        "pair_id", "source", (F.col("at") + 1).alias("h"), "prediction")


# --------------------------------------------------------------------------- metrics

def _changes(predictions: DataFrame):
    have = set(predictions.columns)
    if {"actual_spread_change", "predicted_spread_change"} <= have:
        return F.col("actual_spread_change"), F.col("predicted_spread_change")
    for name in ("prior_spread", "spread", "current_spread"):
        if name in have:
            return F.col("actual") - F.col(name), F.col("prediction") - F.col(name)
    return F.lit(None).cast("double"), F.lit(None).cast("double")


def forecast_metrics(predictions: DataFrame) -> DataFrame:
    """Error metrics per (model, split), one aggregate; empty groups keep a row."""
    actual_change, predicted_change = _changes(predictions)
    valid = F.col("prediction").isNotNull() & F.col("actual").isNotNull()
    error = F.when(valid, F.col("actual") - F.col("prediction"))
    directed = valid & actual_change.isNotNull() & predicted_change.isNotNull()
    hit = F.when(directed, F.when(
        F.signum(actual_change) == F.signum(predicted_change), 1.0).otherwise(0.0))
    prediction, actual = F.when(valid, F.col("prediction")), F.when(valid, F.col("actual"))
    spread_out = (F.min(prediction) < F.max(prediction)) & (F.min(actual) < F.max(actual))
    corr = F.when(spread_out, ratio(
        F.covar_samp(prediction, actual), F.sqrt(F.var_samp(prediction) * F.var_samp(actual))))
    return predictions.groupBy("model", "split").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.avg(hit).alias("directional_accuracy"), corr.alias("prediction_correlation"),
        F.avg(error).alias("bias"), F.count(error).alias("observation_count"),
    )


def rank_models(metrics: DataFrame, p: ForecastParams) -> DataFrame:
    """Rank models by their validation metric; models without one stay unranked."""
    metric = p.selection_metric.strip().lower()
    if metric not in metrics.columns:
        raise ValueError(f"selection metric '{metric}' is not available")
    scored = metrics.filter(F.col("split") == "validation").groupBy("model").agg(
        F.avg(metric).alias("score")).filter(F.col("score").isNotNull())
    direction = F.asc("score") if p.selection_direction == "minimize" else F.desc("score")
    # One row per model: the single window group is as small as the model list.
    ranked = scored.withColumn("selection_rank", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(direction, F.asc("model"))).cast("long"))
    models = metrics.select("model").distinct()
    return models.join(ranked, "model", "left").select(
        "model", F.coalesce(F.col("selection_rank") == 1, F.lit(False)).alias("selected_by_validation"),
        "selection_rank")


def compare_models(metrics: DataFrame, p: ForecastParams) -> DataFrame:
    """One row per model: metrics by split, validation rank, selected flag."""
    cells = [
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
        for s in EVALUATION_SPLITS for m in COMPARED
    ]
    wide = metrics.groupBy("model").agg(*cells)
    return wide.join(rank_models(metrics, p), "model", "left")


def best_validation_model(metrics: DataFrame, p: ForecastParams) -> DataFrame:
    """One row, or none: the model ranked first."""
    return rank_models(metrics, p).filter("selected_by_validation").select("model")


def resolve_model(configured: str, comparison: DataFrame, p: ForecastParams) -> DataFrame:
    """One-row frame with the model to trade: a named one, or the validation best.

    It stays a DataFrame and is joined, so nothing is collected to decide.
    """
    name = str(configured).strip().lower()
    if name != "best_validation":
        return comparison.sparkSession.range(1).select(F.lit(name).alias("model"))
    column = f"{p.selection_split}_{p.selection_metric}"
    if column not in comparison.columns:
        raise ValueError(f"model comparison is missing {column}")
    direction = F.asc(column) if p.selection_direction == "minimize" else F.desc(column)
    return top1(comparison.filter(F.col(column).isNotNull()), direction, F.asc("model")).select("model")


def refresh(predictions: DataFrame, p: ForecastParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recompute errors, metrics and comparison from stored predictions."""
    again = predictions.withColumn("forecast_error", F.col("actual") - F.col("prediction"))
    metrics = forecast_metrics(again)
    return again, metrics, compare_models(metrics, p)
