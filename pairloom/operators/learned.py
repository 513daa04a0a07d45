"""Learned forecasts: boosted trees, a recurrent cell, and lagged-sequence regression."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import passes
from ..functions.columns import number
from ..functions.recurrent import Adam, Cell
from ..functions.stats import exact_median
from ..params import ForecastParams
from ..session import stage_table
from . import boosting
from .forecast import (
    evaluation_rows, prediction_table, served_splits, source_of, training_rows, training_sources,
)

# Identifier and bookkeeping columns that are never model inputs.
NOT_INPUTS = {
    "pair_id", "ticker_1", "ticker_2", "date", "feature_date", "target_date", "split", "model",
    "prediction", "actual", "forecast_error", "current_spread", "training_observation_count",
    "training_split_source",
}


def input_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in NOT_INPUTS and not c.startswith("target_")]


def fitted_inputs(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Per input column and training set: fill value, mean and deviation of training.

    One long row per (set, column). Columns without any training value are left
    out. The table has a handful of rows, whatever the data volume.
    """
    columns = input_columns(features)
    train = training_rows(features, p).filter(F.col(p.target).isNotNull()).select(
        "source", *[number(F.col(c)).alias(c) for c in columns])
    long = train.select("source", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns])))
    keys = ["source", "column"]
    stats = long.groupBy(*keys).agg(
        F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"),
        F.avg("x").alias("avg"), F.var_pop("x").alias("var"))
    if p.missing_strategy == "median":
        stats = stats.join(exact_median(long, keys, "x", "fill"), keys, "left")
    else:
        stats = stats.withColumn("fill", F.lit(0.0))
    stats = stats.withColumn("fill", F.coalesce("fill", F.lit(0.0)))
    # Filled training rows: mean and variance with the gaps counted at the fill value.
    share, avg = F.col("n") / F.col("rows"), F.coalesce("avg", F.lit(0.0))
    mean = share * avg + (1 - share) * F.col("fill")
    spread = share * (F.coalesce("var", F.lit(0.0)) + F.pow(avg - mean, F.lit(2))) \
        + (1 - share) * F.pow(F.col("fill") - mean, F.lit(2))
    std = F.sqrt(spread)
    return stats.filter("n > 0").select(
        "source", "column", "fill", mean.alias("mean"),
        F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"))


def prepared(rows: DataFrame, features: DataFrame, p: ForecastParams, scale: bool) -> DataFrame:
    """Rows (with their training set as ``source``) whose ``inputs`` array is filled and maybe scaled.

    A column without training values becomes the constant 0, which no model can use:
    the same as leaving it out, with one fixed vector length.
    """
    columns = input_columns(features)
    params = fitted_inputs(features, p).groupBy("source").agg(F.map_from_entries(
        F.collect_list(F.struct("column", F.struct("fill", "mean", "std")))).alias("fit"))
    joined = rows.join(F.broadcast(params), "source")  # one row per training set

    def value(c: str):
        s = F.col("fit")[c]
        filled = F.coalesce(number(F.col(c)), s["fill"], F.lit(0.0))
        scaled = (filled - s["mean"]) / s["std"] if scale else filled
        return F.when(s.isNull(), F.lit(0.0)).otherwise(scaled)

    return joined.withColumn("inputs", F.array(*[value(c) for c in columns])).drop("fit")


def _fit_predict(estimator, train: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    flat = [F.col("inputs")[i].alias(f"f{i}") for i in range(size)]
    names = [f"f{i}" for i in range(size)]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="vector"), estimator]).fit(
        train.select("label", *flat))
    scored = model.transform(rows.select("*", *flat))
    return scored.drop("vector", "inputs", *names)


def boosted_tree_forecast(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Gradient-boosted trees on all numeric features, fitted on training rows only.

    Splits that share their training rows share a model.
    """
    size = len(input_columns(features))
    rows = evaluation_rows(features).withColumn("source", source_of(F.col("split"), p))
    train = prepared(training_rows(features, p).filter(F.col(p.target).isNotNull()),
                     features, p, scale=False).withColumn("label", F.col(p.target))
    out = None
    for source, served in training_sources(p).items():
        model = boosting.fit(train.filter(F.col("source") == source), size, p)
        part = boosting.predicted(
            prepared(rows.filter(F.col("split").isin(*served)), features, p, scale=False), model)
        out = part if out is None else out.unionByName(part)
    return prediction_table(out, "boosted_trees", features, p)


def sequences(features: DataFrame, p: ForecastParams) -> DataFrame:
    """The last L scaled input vectors ending at each row, flattened.

    Evaluation rows continue from the end of their training history; rows with
    fewer than L vectors get NULL.
    """
    train = training_rows(features, p).filter(F.col(p.target).isNotNull())
    train = served_splits(train, p, "for_split").withColumn("phase", F.lit(0))
    later = evaluation_rows(features).withColumns({
        "for_split": F.col("split"), "phase": F.lit(1), "source": source_of(F.col("split"), p)})
    rows = prepared(train.unionByName(later), features, p, scale=p.scale_features)
    w = Window.partitionBy("pair_id", "for_split").orderBy("phase", "date").rowsBetween(
        -(p.sequence_length - 1), 0)
    return rows.withColumn("steps", F.collect_list("inputs").over(w)).withColumn(
        "sequence", F.when(F.size("steps") == p.sequence_length, F.flatten("steps"))
    ).drop("steps", "inputs")


def sequence_forecast(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Linear regression on the flattened sequence."""
    size = len(input_columns(features)) * p.sequence_length
    rows = sequences(features, p).withColumnRenamed("sequence", "inputs")
    usable = rows.filter(F.col("inputs").isNotNull())
    out = None
    for served in training_sources(p).values():
        estimator = LinearRegression(featuresCol="vector", labelCol="label",
                                     predictionCol="prediction", regParam=0.1, maxIter=50)
        part = _fit_predict(
            estimator,
            usable.filter((F.col("phase") == 0) & (F.col("for_split") == served[0]))
            .withColumn("label", F.col(p.target)),
            usable.filter((F.col("phase") == 1) & F.col("for_split").isin(*served)), size)
        out = part if out is None else out.unionByName(part)
    early = rows.filter((F.col("phase") == 1) & F.col("inputs").isNull()).drop("inputs")
    out = out.unionByName(early.withColumn("prediction", F.lit(None).cast("double")))
    return prediction_table(out.drop("for_split", "phase"), "sequence_regression", features, p)


def _arrays(batch: pa.RecordBatch, name: str, steps: int) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, steps, -1)


def _descend(gradient, cell: Cell, n: int, p: ForecastParams) -> np.ndarray:
    """Parameters of the best round; ``gradient(flat)`` gives loss and slope over all rows.

    Ends after ``rounds``, or when the loss has not improved for ``patience`` rounds.
    """
    flat, adam = cell.initial(p.seed), Adam(cell.size, p.recurrent_rate)
    best, least, since = flat, np.inf, 0
    for _ in range(p.rounds + 1):
        loss, slope = gradient(flat)
        if loss < least * (1 - 1e-4):
            best, least, since = flat, loss, 0
        else:
            since += 1
            if since > p.patience:
                break
        flat = adam.step(flat, slope / n)
    return best


def fit_recurrent(train: DataFrame, cell: Cell, p: ForecastParams) -> tuple[np.ndarray, float, float] | None:
    """Parameters of the cell and the target's centre and scale, from rows (sequence, label).

    Gradients are summed where the rows are and only vectors of the parameters' size, which does
    not depend on the data, go out and come back. A round is one job over blocks that executors keep.
    """
    train = stage_table(train.select("sequence", F.col("label").cast("double").alias("label")), f"recurrent-{uuid.uuid4().hex[:12]}")
    n, centre, scale = train.agg(F.count("label"), F.avg("label"), F.stddev_pop("label")).first()
    if not n:
        return None
    scale, steps = scale or 1.0, p.sequence_length
    kept = passes.blocks(train, n, lambda b: (_arrays(b, "sequence", steps), b.column("label")),
                         [("<f8", (steps, cell.inputs)), ("<f8", ())])

    def gradient(flat):
        def sums(x, y):
            loss, slope = cell.gradient(flat, x, (y - centre) / scale)
            return np.concatenate([[loss], slope])

        out = passes.total(kept, sums)
        return out[0], out[1:]

    best = _descend(gradient, cell, n, p)
    kept.unpersist()
    return best, centre, scale


def recurrent_forecast(features: DataFrame, p: ForecastParams) -> DataFrame:
    """Long short-term memory over the last L input vectors, trained on training rows only."""
    width = len(input_columns(features))
    cell = Cell(width, p.hidden_size)
    rows = sequences(features, p)
    usable = rows.filter(F.col("sequence").isNotNull())
    later = rows.filter("phase = 1")
    out = None
    for served in training_sources(p).values():
        fit = fit_recurrent(usable.filter((F.col("phase") == 0) & (F.col("for_split") == served[0]))
                            .withColumn("label", F.col(p.target)), cell, p)
        part = later.filter(F.col("for_split").isin(*served))
        part = part.select(F.struct(*[c for c in part.columns if c != "sequence"]).alias("row"), "sequence")
        kind = part.schema["row"].dataType.simpleString()

        def run(batches, fit=fit):
            for batch in batches:
                known = batch.column("sequence").is_valid().to_numpy(zero_copy_only=False)
                made = np.full(batch.num_rows, np.nan)
                if fit is not None and known.any():
                    flat, centre, scale = fit
                    made[known] = centre + scale * cell.predict(
                        flat, _arrays(batch.filter(pa.array(known)), "sequence", p.sequence_length))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, from_pandas=True)], ["row", "prediction"])

        part = part.mapInArrow(run, f"row {kind}, prediction double").select("row.*", "prediction")
        out = part if out is None else out.unionByName(part)
    return prediction_table(out.drop("for_split", "phase"), "recurrent", features, p)
