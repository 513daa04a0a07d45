"""Parameter sweeps: every scenario in one job, keyed by scenario and run.

A *run* is a distinct set of signal parameters; scenarios that only differ in costs
share its signals, trades and marks.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import general_text
from ..params import BacktestParams, RobustnessParams, SignalParams
from .analytics import CORE_METRICS

PARAMETERS = ("entry_z", "exit_z", "stop_loss_z", "commission_bps", "slippage_bps",
              "zscore_window", "signal_model")
GRID = ("scenario_id", *PARAMETERS)
RESULTS = ("scenario_id", "model", "split", *CORE_METRICS, *PARAMETERS)
SUMMARY = ("summary_item", "selection_split", "selection_metric", "scenario_id", "model", "split",
           "value", "notes", *CORE_METRICS, *PARAMETERS)
KEYS = ("scenario_id", "model")
# Split priority for ties, lowest first.
PRIORITY = {"validation": 0, "test": 1, "holdout_2025": 2, "all": 3}
ITEMS = ("best_validation_scenario", "median_validation_performance",
         "worst_validation_drawdown_scenario", "transaction_cost_sensitivity",
         "parameter_concentration")


def scenario_grid(spark: SparkSession, p: RobustnessParams) -> DataFrame:
    """Ordered product of the parameter lists with stable ids.

    All of it, unless the caller chose a number of scenarios. An id is the hash of the
    parameters as canonical JSON, whose number texts are fixed by the listed values.
    """
    values = (p.entry_z_values, p.exit_z_values, p.stop_loss_z_values, p.commission_bps_values,
              p.slippage_bps_values, p.zscore_window_values, p.signal_model_values)
    casts = (float, float, float, float, float, int, lambda v: str(v).strip().lower())
    grid = spark.range(1).select()
    for name, listed, cast in zip(PARAMETERS, values, casts):
        options = F.array(*[F.struct(F.lit(cast(v)).alias("v"), F.lit(_json(cast(v))).alias("t")) for v in listed])
        grid = grid.select("*", F.posexplode(options).alias(f"o_{name}", f"x_{name}")).withColumn(
            name, F.col(f"x_{name}.v"))
    if p.max_scenarios is not None:
        grid = grid.orderBy(*[f"o_{n}" for n in PARAMETERS]).limit(p.max_scenarios)
    fields = [F.concat(F.lit(f'"{n}":'), F.col(f"x_{n}.t")) for n in sorted(PARAMETERS)]
    payload = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return grid.withColumn("scenario_id", F.concat(
        F.lit("scenario_"), F.substring(F.sha1(payload.cast("binary")), 1, 12))).select(*GRID)


def _json(value) -> str:
    return json.dumps(round(value, 10) if isinstance(value, float) else value)


def scenario_runs(grid: DataFrame, best: DataFrame, s: SignalParams) -> tuple[DataFrame, DataFrame]:
    """(run table, scenario-to-run table): models resolved, equal signal settings merged."""
    named = best.select("model").limit(1).scalar()
    resolved = grid.withColumn("model", F.when(
        F.col("signal_model") == "best_validation", named).otherwise(F.col("signal_model")))
    resolved = resolved.filter(F.col("model").isNotNull()).withColumn("run_id", F.sha1(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in
               ("entry_z", "exit_z", "stop_loss_z", "zscore_window", "model")])))
    runs = resolved.select(
        "run_id", "model", "entry_z", "exit_z", "stop_loss_z",
        F.lit(int(s.max_holding_days)).alias("max_holding_days"),
        F.col("zscore_window").alias("z_score_window")).distinct()
    return runs, resolved


def scenario_costs(resolved: DataFrame, b: BacktestParams) -> DataFrame:
    return resolved.select("scenario_id", "run_id", "commission_bps", "slippage_bps",
                           F.lit(float(b.borrow_cost_bps)).alias("borrow_bps"))


def dominant_split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent split per key; ties by priority, then by name."""
    counts = rows.filter(F.col("split").isNotNull()).groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n"))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("split")],
                      F.lit(99))
    return counts.groupBy(*keys).agg(
        F.min_by("split", F.struct(-F.col("n"), rank, F.col("split"))).alias("split"))


def attach_splits(frames: dict, signals: DataFrame, costs: DataFrame, execution: Column) -> dict:
    """Daily, exposure and trade tables with the split their signals came from."""
    tagged = signals.select("run_id", "model", "pair_id", "split", execution.alias("on"))
    tagged = tagged.filter(F.col("on").isNotNull())
    scenario = costs.select("scenario_id", "run_id")
    by_date = dominant_split(tagged, ["run_id", "model", "on"]).join(scenario, "run_id").select(
        "scenario_id", "model", F.col("on").alias("date"), "split")
    by_trade = dominant_split(tagged, ["run_id", "model", "pair_id", "on"]).join(
        scenario, "run_id").select("scenario_id", "model", "pair_id",
                                   F.col("on").alias("entry_date"), "split")
    keyed = {"trade_log": (by_trade, ["scenario_id", "model", "pair_id", "entry_date"])}
    default = (by_date, ["scenario_id", "model", "date"])
    return {
        name: df.join(keyed.get(name, default)[0], keyed.get(name, default)[1], "left")
        for name, df in frames.items()
    }


def attach_parameters(metrics: DataFrame, grid: DataFrame) -> DataFrame:
    return metrics.join(grid, "scenario_id").select(*RESULTS)


def _row(df: DataFrame, item: str, p: RobustnessParams, value: Column, notes: Column,
         keep: tuple) -> DataFrame:
    """Shape a one-row frame as a summary row; columns outside ``keep`` are NULL."""
    fixed = {"summary_item": F.lit(item), "selection_split": F.lit(p.selection_split),
             "selection_metric": F.lit(p.selection_metric), "value": value.cast("double"),
             "notes": notes}
    types = dict(_types())
    return df.select(*[
        fixed[c].alias(c) if c in fixed else
        (F.col(c) if c in keep else F.lit(None)).cast(types[c]).alias(c) for c in SUMMARY
    ])


def _types():
    text = {"summary_item", "selection_split", "selection_metric", "scenario_id", "model", "split",
            "notes", "signal_model"}
    for c in SUMMARY:
        yield c, "string" if c in text else "int" if c == "zscore_window" else "double"


def robustness_summary(results: DataFrame, p: RobustnessParams) -> DataFrame:
    """Validation-only headline rows. ``results`` has one row per scenario, model and split."""
    metric = p.selection_metric
    valid = results.filter(F.lower(F.trim("split")) == p.selection_split)
    ranked = valid.filter(F.col(metric).isNotNull())
    best_order = (F.desc(metric), F.asc("scenario_id"), F.asc("model"))
    everything = ("scenario_id", "model", "split", *CORE_METRICS, *PARAMETERS)

    best = _row(ranked.orderBy(*best_order).limit(1), ITEMS[0], p, F.col(metric),
                F.lit(f"Selected using validation {metric}."), everything)
    middle = valid.groupBy("split").agg(
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in CORE_METRICS])
    median = _row(middle.withColumn("split", F.lit(p.selection_split)).limit(1), ITEMS[1], p,
                  F.col(metric), F.lit("Median across validation scenario rows."),
                  ("split", *CORE_METRICS))
    fallen = valid.filter(F.col("max_drawdown").isNotNull())
    worst = _row(
        fallen.orderBy(F.asc("max_drawdown"), F.asc("scenario_id"), F.asc("model")).limit(1),
        ITEMS[2], p, F.col("max_drawdown"),
        F.lit("Most negative validation drawdown across scenarios."), everything)
    rows = [best, median, worst, _cost_row(ranked, p), _concentration_row(ranked, p, best_order)]
    found = reduce(DataFrame.unionByName, rows)

    # Every item keeps a row: items without data say why.
    missing = {
        ITEMS[0]: "No validation metrics were available; no scenario was selected.",
        ITEMS[1]: "No validation metrics were available for median calculation.",
        ITEMS[2]: "No validation drawdown metrics were available.",
        ITEMS[4]: "No validation metrics were available for concentration analysis.",
    }
    any_valid = valid.select((F.count(F.lit(1)) > 0).alias("v")).scalar()
    items = results.limit(1).select(F.explode(F.array(*[F.lit(i) for i in ITEMS])).alias("summary_item"))
    note = F.create_map(*[F.lit(x) for kv in missing.items() for x in kv])[F.col("summary_item")]
    note = F.coalesce(note, F.when(any_valid, F.lit("Fewer than two transaction cost levels were available."))
                      .otherwise(F.lit("No validation metrics were available for cost sensitivity.")))
    joined = items.join(found, "summary_item", "left")
    return joined.withColumns({
        "notes": F.coalesce("notes", note),
        "selection_split": F.lit(p.selection_split), "selection_metric": F.lit(metric),
    }).select(*SUMMARY)


def _cost_row(ranked: DataFrame, p: RobustnessParams) -> DataFrame:
    metric = p.selection_metric
    levels = ranked.withColumn("bps", F.col("commission_bps") + F.col("slippage_bps")).groupBy("bps").agg(
        F.percentile(metric, F.lit(0.5)).alias("m"))
    ends = levels.agg(
        F.count(F.lit(1)).alias("n"), F.min("bps").alias("low"), F.max("bps").alias("high"),
        F.min_by("m", "bps").alias("at_low"), F.max_by("m", "bps").alias("at_high")).filter("n >= 2")
    notes = F.concat(
        F.lit(f"Validation {metric} median changed from "), general_text(F.col("at_low")), F.lit(" at "),
        general_text(F.col("low")), F.lit(" bps to "), general_text(F.col("at_high")), F.lit(" at "),
        general_text(F.col("high")), F.lit(" bps."))
    return _row(ends.withColumn("split", F.lit(p.selection_split)), ITEMS[3], p,
                F.col("at_high") - F.col("at_low"), notes, ("split",))


def _concentration_row(ranked: DataFrame, p: RobustnessParams, order: tuple) -> DataFrame:
    # Scenario rows of one split: bounded by the listed parameters and models.
    w = Window.partitionBy("split").orderBy(*order)
    numbered = ranked.withColumns({
        "place": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy("split"))})
    top = F.greatest(F.lit(1), F.ceil(F.col("total") * p.concentration_top_fraction))
    numbered = numbered.withColumn("top", top).withColumn("in_top", F.col("place") <= F.col("top"))
    sums = numbered.agg(
        F.max("top").alias("top"), F.max("total").alias("total"),
        F.count(F.lit(1)).alias("n"),
        *[F.count_distinct(c).alias(f"all_{c}") for c in PARAMETERS],
        *[F.count_distinct(F.when(F.col("in_top"), F.col(c))).alias(f"top_{c}") for c in PARAMETERS],
    ).filter("n > 0")
    varied = sum([F.when(F.col(f"all_{c}") > 1, 1).otherwise(0) for c in PARAMETERS], F.lit(0))
    narrow = F.array_compact(F.array(*[
        F.when((F.col(f"all_{c}") > 1) & (F.col(f"top_{c}") == 1), F.lit(c)) for c in PARAMETERS]))
    rows = sums.withColumns({"varied": varied, "narrow": narrow}).withColumn(
        "share", F.when(F.col("varied") > 0, F.size("narrow") / F.col("varied")).otherwise(F.lit(0.0)))
    flagged = (F.col("share") >= 0.75) & (F.col("top") < F.col("total"))
    names = F.when(F.size("narrow") > 0, F.array_join("narrow", ",")).otherwise(F.lit("none"))
    notes = F.when(F.col("varied") == 0, F.lit(
        "Only one tested value was available for each robustness parameter.",
    )).otherwise(F.concat(F.lit("concentrated="), flagged.cast("string"), F.lit("; top_rows="),
                          F.col("top").cast("string"), F.lit("; narrow_parameters="), names))
    return _row(rows.withColumn("split", F.lit(p.selection_split)), ITEMS[4], p, F.col("share"), notes,
                ("split",))
