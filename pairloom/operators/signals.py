"""Trading signals: context joins, the per-pair state machine, and its summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import latest, ratio
from ..params import EVALUATION_SPLITS, SignalParams

# The signal actions.
ENTER = ("enter_long_spread", "enter_short_spread")
LEAVE = ("exit", "stop_loss", "force_exit_max_holding")
ACTIONS = (*ENTER, "hold_long_spread", "hold_short_spread", *LEAVE, "no_action")
DIRECT_Z = ("predicted_zscore", "predicted_z_score", "prediction_zscore", "prediction_z_score")

#: What tells the chunks of all pairs apart, and the calendar days of a chunk.
CHUNK = ("run_id", "model", "pair_id", "chunk")
CHUNK_DAYS = 180

STATE = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("pair_id", T.StringType()),
    T.StructField("ticker_1", T.StringType()), T.StructField("ticker_2", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("feature_date", T.DateType()),
    T.StructField("target_date", T.DateType()), T.StructField("split", T.StringType()),
    T.StructField("current_spread", T.DoubleType()), T.StructField("predicted_spread", T.DoubleType()),
    T.StructField("current_zscore", T.DoubleType()), T.StructField("predicted_zscore", T.DoubleType()),
    T.StructField("signal_action", T.StringType()), T.StructField("signal_state", T.StringType()),
    T.StructField("entry_z", T.DoubleType()), T.StructField("exit_z", T.DoubleType()),
    T.StructField("stop_loss_z", T.DoubleType()), T.StructField("holding_days", T.LongType()),
    T.StructField("exit_reason", T.StringType()),
])


def single_run(models: DataFrame, p: SignalParams, run_id: str = "base") -> DataFrame:
    """The run table of one parameter set: a row per model to trade."""
    return models.select(
        F.lit(run_id).alias("run_id"), "model", F.lit(float(p.entry_z)).alias("entry_z"),
        F.lit(float(p.exit_z)).alias("exit_z"), F.lit(float(p.stop_loss_z)).alias("stop_loss_z"),
        F.lit(int(p.max_holding_days)).alias("max_holding_days"),
        F.lit(int(p.z_score_window)).alias("z_score_window"))


def only_selected(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of selected pairs; an empty selection keeps every row."""
    none = selected.select((F.count(F.lit(1)) == 0).alias("none")).scalar()
    marked = df.join(selected.select("pair_id", F.lit(True).alias("listed")).distinct(),
                     "pair_id", "left")
    return marked.filter(F.col("listed") | none).drop("listed")


def signal_input(predictions: DataFrame, spreads: DataFrame, zscores: DataFrame,
                 selected: DataFrame, runs: DataFrame, p: SignalParams, unique: bool = False) -> DataFrame:
    """Forecast rows of each run with current spread and z-score context.

    Of several context rows of one (pair, date[, window]) the last source row (``ord``)
    counts; ``unique`` says that there is one.
    """
    spreads = latest(spreads, ["pair_id", "date"], unique, "spreads")
    zscores = latest(zscores, ["pair_id", "date", "z_score_window"], unique, "z-scores")
    splits = EVALUATION_SPLITS + (("train",) if p.generate_train_signals else ())
    rows = only_selected(predictions.filter(F.col("split").isin(*splits)), selected)
    have = set(rows.columns)
    predicted = F.col("predicted_spread" if "predicted_spread" in have else "prediction")
    direct = next((F.col(c) for c in DIRECT_Z if c in have), None)
    if direct is None or not p.use_predicted_zscore:
        direct = F.lit(None).cast("double")
    own = F.col("spread") if "spread" in have else F.lit(None).cast("double")
    rows = rows.select(
        "pair_id", "ticker_1", "ticker_2", "model", "feature_date", "target_date", "split",
        predicted.alias("predicted_spread"), direct.alias("direct"), own.alias("own"))
    rows = rows.join(runs, "model")
    context = spreads.select("pair_id", F.col("date").alias("feature_date"), F.col("spread").alias("cs"))
    z = zscores.select("pair_id", F.col("date").alias("feature_date"), "z_score_window", "z_score",
                       "rolling_mean_lagged", "rolling_std_lagged")
    rows = rows.join(context, ["pair_id", "feature_date"], "left").join(
        z, ["pair_id", "feature_date", "z_score_window"], "left")
    rows = rows.withColumn("current_spread", F.coalesce("cs", "own"))

    def score(value):
        return ratio(F.col(value) - F.col("rolling_mean_lagged"), F.col("rolling_std_lagged"))

    predicted_z = F.coalesce("direct", score("predicted_spread")) \
        if p.use_predicted_spread else F.col("direct")
    return rows.select(
        "run_id", "pair_id", "ticker_1", "ticker_2", "model", "feature_date", "target_date", "split",
        "current_spread", "predicted_spread",
        F.coalesce("z_score", score("current_spread")).alias("current_zscore"),
        predicted_z.alias("predicted_zscore"),
        "entry_z", "exit_z", "stop_loss_z", "max_holding_days")


class Walk:
    """The state machine over the ordered rows of a chunk, from trade to trade.

    A trade is where it was entered: row ``start`` of this chunk, or -1 - k if it was carried into
    the chunk after k days. It ends at the first row from then on that stops or leaves it, and at
    the latest one row after it was held as long as allowed.
    """

    def __init__(self, predicted, current, entry_z: float, exit_z: float, stop_z: float, hold: int):
        size = np.abs(current)
        usable = np.isfinite(size)
        self.n, self.hold = len(size), hold
        self.stop = usable & (size > stop_z)
        self.leave = np.flatnonzero(self.stop | (usable & (size < exit_z)))
        self.enter = np.flatnonzero(np.isfinite(predicted) & (np.abs(predicted) > entry_z))
        self.short = predicted > 0

    def end(self, start: int) -> tuple[int, int]:
        """First row that would leave the trade, and the row that forces it out."""
        k = np.searchsorted(self.leave, max(start + 1, 0))
        return int(self.leave[k]) if k < len(self.leave) else self.n, start + self.hold + 1

    def table(self) -> list[int]:
        """State after the chunk for every state before it (flat, held 0, 1, ... days).

        0 is flat, 1 + 2 * days + side a trade entered here, -1 - days one that came in and still runs.
        """
        after = [0] * (len(self.enter) + 1)

        def flat(at: int) -> int:
            return after[int(np.searchsorted(self.enter, at))]

        for k in range(len(self.enter) - 1, -1, -1):
            start = int(self.enter[k])
            end = min(self.end(start))
            after[k] = flat(end + 1) if end < self.n else 1 + 2 * (self.n - 1 - start) + int(self.short[start])
        out = [flat(0)]
        for days in range(self.hold + 1):
            end = min(self.end(-1 - days))
            out.append(flat(end + 1) if end < self.n else -1 - (days + self.n))
        return out

    def labels(self, before: int) -> tuple[np.ndarray, ...]:
        """Action, state, days held and exit reason of every row, from the state before the chunk."""
        n = self.n
        action, state = np.full(n, "no_action", dtype=object), np.full(n, "flat", dtype=object)
        reason, held = np.full(n, "", dtype=object), np.zeros(n, dtype=np.int64)
        at, carried = 0, before > 0
        while True:
            if carried:
                start, short = -1 - (before - 1) // 2, (before - 1) % 2 == 1
                carried = False
            else:
                k = np.searchsorted(self.enter, at)
                if k == len(self.enter):
                    return action, state, held, reason
                start = int(self.enter[k])
                short = bool(self.short[start])
            side = "short_spread" if short else "long_spread"
            natural, forced = self.end(start)
            end = min(natural, forced)
            first, last = max(start, 0), min(end, n)
            if start >= 0:
                action[start] = f"enter_{side}"
            action[max(start + 1, 0):last] = f"hold_{side}"
            state[first:last] = side
            till = min(end + 1, n)
            held[max(start + 1, 0):till] = np.arange(max(start + 1, 0), till) - start
            if end < n:
                if natural <= forced:
                    action[end], reason[end] = ("stop_loss", "stop_loss_z") if self.stop[end] else ("exit", "exit_z")
                else:
                    action[end], reason[end] = "force_exit_max_holding", "max_holding_days"
            at = end + 1


def _walk(rows: pa.Table) -> tuple[pa.Table, Walk]:
    """A chunk's rows in order, and their machine."""
    rows = rows.sort_by([("feature_date", "ascending"), ("target_date", "ascending")])
    numbers = [rows.column(c).to_numpy().astype(float) for c in ("predicted_zscore", "current_zscore")]
    return rows, Walk(*numbers, *(rows.column(c)[0].as_py() for c in ("entry_z", "exit_z", "stop_loss_z", "max_holding_days")))


def _table_of(rows: pa.Table) -> pa.Table:
    _, walk = _walk(rows)
    return pa.table({**{c: rows.column(c).slice(0, 1) for c in CHUNK}, "codes": pa.array([walk.table()], pa.list_(pa.int32()))})


def _labels_of(rows: pa.Table) -> pa.Table:
    rows, walk = _walk(rows)
    action, state, held, reason = walk.labels(rows.column("before")[0].as_py())
    made = {"signal_action": pa.array(action, pa.string()), "signal_state": pa.array(state, pa.string()),
            "holding_days": pa.array(held), "exit_reason": pa.array(reason, pa.string())}
    return pa.table({c: made[c] if c in made else rows.column(c) for c in STATE.fieldNames()})


def generate_signals(inputs: DataFrame, days: int = CHUNK_DAYS) -> DataFrame:
    """States and actions of every row, per (run, model, pair) in date order.

    A pair's rows are cut into chunks of ``days`` calendar days. A chunk is a function from the
    state before it to the state after it: one small table, made without knowing the past. The
    tables of a pair are composed in order, which tells every chunk the state it starts from, and
    each chunk then labels its own rows. So a pair is as many tasks as it has chunks.
    """
    span = F.floor(F.datediff("feature_date", F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("int")
    rows = inputs.withColumn("chunk", F.coalesce(span, F.lit(2 ** 31 - 1)))  # no date comes last
    needed = [*CHUNK, "feature_date", "target_date", "predicted_zscore", "current_zscore", "entry_z", "exit_z",
              "stop_loss_z", "max_holding_days"]
    tables = rows.select(*needed).groupBy(*CHUNK).applyInArrow(
        _table_of, "run_id string, model string, pair_id string, chunk int, codes array<int>")

    def after(before, codes):
        code = F.get(codes, F.when(before > 0, 1 + F.floor((before - 1) / 2)).otherwise(0).cast("int"))
        carried = 1 + 2 * (-1 - code) + F.pmod(before - 1, F.lit(2))
        return F.when(code < 0, carried).otherwise(code).cast("int")

    listed = tables.groupBy(*CHUNK[:3]).agg(F.array_sort(F.collect_list(F.struct("chunk", "codes"))).alias("chunks"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<chunk:int,before:int>>").alias("seen"))
    told = F.aggregate("chunks", start, lambda a, c: F.struct(
        after(a["state"], c["codes"]).alias("state"),
        F.concat(a["seen"], F.array(F.struct(c["chunk"].alias("chunk"), a["state"].alias("before")))).alias("seen")))
    entries = listed.select(*CHUNK[:3], F.inline(told["seen"]))
    return rows.join(entries, list(CHUNK)).groupBy(*CHUNK).applyInArrow(_labels_of, STATE)


def signal_summary(signals: DataFrame) -> DataFrame:
    """Counts per (model, split); final open positions from the last row per pair.

    Two aggregates: (model, split, pair) first, which spreads a model over its pairs.
    """
    keys = [c for c in ("run_id",) if c in signals.columns] + ["model", "split"]
    pairs = signals.groupBy(*keys, "pair_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("signal_action") == a).alias(a) for a in ACTIONS],
        F.max_by("signal_state", F.struct("feature_date", "target_date")).alias("final"))
    return pairs.groupBy(*keys).agg(
        F.count("pair_id").alias("pair_count"), F.sum("rows").alias("signal_rows"),
        *[F.sum(a).alias(f"{a}_count") for a in ACTIONS],
        F.count_if(F.col("final") != "flat").alias("final_open_positions"))
