"""Portfolio backtest of the signals, as joins and windows over trade intervals.

Only the slot-constrained admission is sequential. It runs where the slot limit can
bind, as a streaming fold over sorted events; everything after it is set-based.
Costs are linear in notionals, so cost settings multiply daily sums, not trades.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import last_row
from ..params import EVALUATION_SPLITS, BacktestParams, Period
from .panel import price_panel
from .signals import ACTIONS, ENTER, LEAVE, only_selected

POSITION = ("run_id", "model", "pair_id", "entry_date")
TRADE_LOG = ("pair_id", "ticker_1", "ticker_2", "model", "side", "entry_date", "exit_date",
             "entry_price_1", "entry_price_2", "exit_price_1", "exit_price_2", "hedge_ratio_beta",
             "gross_pnl", "commission_cost", "slippage_cost", "borrow_cost", "transaction_cost",
             "net_pnl", "holding_days", "exit_reason")


def execution_date(columns: list[str]) -> Column:
    """First present of target, feature and plain date."""
    names = [c for c in ("target_date", "feature_date", "date") if c in columns]
    if not names:
        raise ValueError("signals need target_date, feature_date or date")
    return F.coalesce(*names) if len(names) > 1 else F.col(names[0])


def prepare_signals(signals: DataFrame, selected: DataFrame, p: BacktestParams) -> DataFrame:
    """Tradable signal rows, the last one per (run, execution date, model, pair)."""
    splits = EVALUATION_SPLITS + (("train",) if p.generate_train_backtest else ())
    rows = signals if "run_id" in signals.columns else signals.withColumn("run_id", F.lit("base"))
    rows = rows.filter(F.col("split").isin(*splits) & F.col("signal_action").isin(*ACTIONS))
    rows = only_selected(rows, selected)
    rows = rows.withColumn("execution_date", execution_date(rows.columns))
    rows = rows.filter(F.col("execution_date").isNotNull() & (F.col("model") != "")
                       & (F.col("pair_id") != ""))
    order = [c for c in ("target_date", "feature_date", "date", "signal_action") if c in rows.columns]
    rows = rows.select("run_id", "execution_date", "model", "pair_id", "ticker_1", "ticker_2",
                       "split", "signal_action", F.coalesce("exit_reason", F.lit("")).alias("exit_reason"),
                       *[c for c in order if c != "signal_action"])
    return last_row(rows, ["run_id", "execution_date", "model", "pair_id"], order).drop(
        *[c for c in order if c != "signal_action"])


def hedge_ratios(diagnostics: DataFrame, spreads: DataFrame, selected: DataFrame) -> DataFrame:
    """Positive hedge ratio per pair: diagnostics, else the last spread row, else 1.

    A diagnostics row blocks the spread fallback even when its own value is unusable.
    """
    def usable(c):
        return F.when((c > 0) & (c < float("inf")), c).otherwise(F.lit(1.0))

    name = "hedge_ratio_beta" if "hedge_ratio_beta" in diagnostics.columns else "beta"
    own = diagnostics.groupBy("pair_id").agg(F.last(name).alias("own"), F.lit(True).alias("has"))
    rows = selected.select("pair_id").distinct().join(own, "pair_id", "full_outer")
    fallback = F.lit(1.0)
    if "beta" in spreads.columns:
        last = spreads.filter(F.col("beta").isNotNull()).groupBy("pair_id").agg(
            F.max_by("beta", "date").alias("last_beta"))
        rows = rows.join(last, "pair_id", "full_outer")
        fallback = usable(F.col("last_beta"))
    return rows.select("pair_id", F.when(F.col("has"), usable(F.col("own"))).otherwise(fallback)
                       .alias("hedge_ratio_beta"))


def pair_prices(pairs: DataFrame, prices: DataFrame, spreads: DataFrame, period: Period,
                unique: bool = False) -> DataFrame:
    """Both leg prices per (pair, date): from the price table, else from the spread
    series, never one leg of each."""
    legs = pairs.select(F.col("ticker_1").alias("ticker")).union(pairs.select("ticker_2"))
    panel = price_panel(prices, period, legs, unique).filter(F.col("adjusted_close").isNotNull())

    def leg(n: int) -> DataFrame:
        return panel.select(F.col("ticker").alias(f"ticker_{n}"), "date",
                            F.col("adjusted_close").alias(f"p{n}"))

    listed = pairs.select("pair_id", "ticker_1", "ticker_2").join(leg(1), "ticker_1").join(
        leg(2), ["ticker_2", "date"]).select("pair_id", "date", F.struct("p1", "p2").alias("a"))
    if {"adjusted_close_1", "adjusted_close_2"} <= set(spreads.columns):
        own = spreads.filter((F.col("adjusted_close_1") > 0) & (F.col("adjusted_close_2") > 0)).select(
            "pair_id", "date",
            F.struct(F.col("adjusted_close_1").alias("p1"), F.col("adjusted_close_2").alias("p2")).alias("b"))
        listed = listed.join(own, ["pair_id", "date"], "full_outer").withColumn("a", F.coalesce("a", "b"))
    return listed.select("pair_id", "date", "a.p1", "a.p2")


def simulation_calendar(prepared: DataFrame, prices: DataFrame, period: Period,
                        selected: DataFrame) -> DataFrame:
    """Execution dates plus all price dates between the first and last of them, per run."""
    tickers = None
    for frame in (prepared, selected):
        for c in ("ticker_1", "ticker_2"):
            part = frame.select(F.col(c).alias("ticker")).distinct()
            tickers = part if tickers is None else tickers.union(part)
    traded = prepared.select("run_id", F.col("execution_date").alias("date")).distinct()
    bounds = traded.groupBy("run_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    dates = prices.filter(F.col("date").between(F.lit(period.start), F.lit(period.end))).join(
        tickers.distinct(), "ticker", "left_semi").select("date").distinct()
    # One row per run against one row per calendar day: a small range join.
    between = dates.join(bounds, F.col("date").between(F.col("first"), F.col("last")))
    return traded.union(between.select("run_id", "date")).distinct()


def priced_events(prepared: DataFrame, px: DataFrame) -> DataFrame:
    """Entries and exits on days with both prices; the others have no effect."""
    rows = prepared.filter(F.col("signal_action").isin(*ENTER, *LEAVE)).join(
        px.withColumnRenamed("date", "execution_date"), ["pair_id", "execution_date"])
    return rows.withColumn("enters", F.col("signal_action").isin(*ENTER))


def admit(events: DataFrame, p: BacktestParams) -> DataFrame:
    """Trade intervals under the slot limit, one row per opened position.

    Without the limit, a pair's state before an event is what its previous event
    left, a window per pair. Those unlimited positions contain the limited ones at
    any time, so wherever they cannot exceed the limit they are the answer. Days on
    which nothing is open cut a model's history into independent segments; only
    segments where the limit can bind go through the ordered fold.
    """
    keys = ["run_id", "model"]
    by_pair = Window.partitionBy(*keys, "pair_id").orderBy("execution_date")
    # Descending order, so "the next leave" is a growing frame and costs one step a row.
    later = Window.partitionBy(*keys, "pair_id").orderBy(F.desc("execution_date")).rowsBetween(
        Window.unboundedPreceding, -1)
    leave = F.when(~F.col("enters"), F.struct(
        F.col("execution_date").alias("exit_date"), F.col("p1").alias("exit_price_1"),
        F.col("p2").alias("exit_price_2"), F.col("signal_action").alias("exit_action"), "exit_reason"))
    rows = events.withColumns({
        "was_in": F.coalesce(F.lag("enters").over(by_pair), F.lit(False)),
        "leave": F.last(leave, ignorenulls=True).over(later),
    })
    rows = rows.withColumn("change", F.when(F.col("enters") & ~F.col("was_in"), 1)
                           .when(~F.col("enters") & F.col("was_in"), -1).otherwise(0))
    daily = rows.groupBy(*keys, "execution_date").agg(
        F.sum("change").alias("net"), F.count_if(F.col("change") == 1).alias("opened"))
    by_day = Window.partitionBy(*keys).orderBy("execution_date")
    daily = daily.withColumn("open", F.sum("net").over(by_day)).withColumns({
        "peak": F.col("open") - F.col("net") + F.col("opened"),
        "segment": F.coalesce(F.sum(F.when(F.col("open") == 0, 1).otherwise(0)).over(
            by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    tight = F.max("peak").over(Window.partitionBy(*keys, "segment")) > p.max_active_pairs
    days = daily.select(*keys, "execution_date", "segment", tight.alias("tight"))
    rows = rows.join(days, [*keys, "execution_date"])
    free = rows.filter(~F.col("tight") & (F.col("change") == 1)).select(*ENTRY, "leave.*")
    # A leave of a pair that is out without the limit is out with it, too.
    ordered = rows.filter("tight").filter(F.col("enters") | F.col("was_in")).select(
        *keys, "segment", "execution_date", "pair_id", "ticker_1", "ticker_2", "signal_action",
        "enters", "p1", "p2", "exit_reason",
    ).repartition(*keys, "segment").sortWithinPartitions(
        *keys, "segment", "execution_date", "pair_id")
    folded = ordered.mapInPandas(_slot_fold(p.max_active_pairs), TRADES).select(*ENTRY, *EXIT)
    return free.unionByName(folded).select(
        *keys, "pair_id", "ticker_1", "ticker_2",
        F.when(F.col("signal_action") == ENTER[0], F.lit("long_spread")).otherwise(F.lit("short_spread")).alias("side"),
        F.col("execution_date").alias("entry_date"), F.col("p1").alias("entry_price_1"),
        F.col("p2").alias("entry_price_2"), *EXIT)


ENTRY = ("run_id", "model", "pair_id", "ticker_1", "ticker_2", "signal_action", "execution_date", "p1", "p2")
EXIT = ("exit_date", "exit_price_1", "exit_price_2", "exit_action", "exit_reason")
_TYPES = {"execution_date": T.DateType(), "exit_date": T.DateType(), "p1": T.DoubleType(),
          "p2": T.DoubleType(), "exit_price_1": T.DoubleType(), "exit_price_2": T.DoubleType()}
TRADES = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in ENTRY + EXIT])


def _slot_fold(slots: int):
    """Fold sorted events with at most ``slots`` open positions as state.

    Batches stream through in order; the rows of the open positions are carried in front of
    the next batch, so memory holds one batch and the open slots, however long a segment is.
    A step moves row numbers only; the trades' columns are taken from the batch at its end.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in batches:
            start = 0 if carried is None else len(carried)
            rows = batch if not start else pd.concat([carried, batch], ignore_index=True)
            group = rows.groupby(["run_id", "model", "segment"], sort=False, dropna=False).ngroup().to_numpy()
            held = dict(zip(rows["pair_id"].iloc[:start], range(start)))
            opened, closed = [], []
            steps = zip(range(start, len(rows)), group[start:].tolist(), rows["enters"].tolist()[start:],
                        rows["pair_id"].tolist()[start:])
            current = group[0] if len(group) else 0
            for at, key, enters, pair in steps:
                if key != current:
                    opened += held.values()
                    closed += [-1] * len(held)
                    current, held = key, {}
                if enters:
                    if len(held) < slots:
                        held.setdefault(pair, at)
                elif pair in held:
                    opened.append(held.pop(pair))
                    closed.append(at)
            yield trades(rows, opened, closed)
            carried = rows.iloc[list(held.values())]
        if carried is not None and len(carried):
            yield trades(carried, range(len(carried)), [-1] * len(carried))

    def trades(rows: pd.DataFrame, opened, closed) -> pd.DataFrame:
        entry = rows.iloc[list(opened)][list(ENTRY)].reset_index(drop=True)
        leave = rows[["execution_date", "p1", "p2", "signal_action", "exit_reason"]].set_axis(list(EXIT), axis=1)
        return pd.concat([entry, leave.reset_index(drop=True).reindex(list(closed)).reset_index(drop=True)], axis=1)

    return fold


def size_positions(trades: DataFrame, ratios: DataFrame, p: BacktestParams) -> DataFrame:
    """Shares per leg: the slot budget split by hedge ratio, signed by side."""
    budget = p.initial_capital / p.max_active_pairs
    rows = trades.join(ratios, "pair_id", "left").withColumn(
        "hedge_ratio_beta", F.coalesce("hedge_ratio_beta", F.lit(1.0)))
    beta = F.col("hedge_ratio_beta")
    sign = F.when(F.col("side") == "long_spread", 1.0).otherwise(-1.0)
    return rows.withColumns({
        "shares_1": sign * (F.lit(budget) / (1.0 + beta)) / F.col("entry_price_1"),
        "shares_2": -sign * (F.lit(budget) * beta / (1.0 + beta)) / F.col("entry_price_2"),
    })


def _gross(p1, p2) -> Column:
    return F.abs(F.col("shares_1") * p1) + F.abs(F.col("shares_2") * p2)


def position_days(positions: DataFrame, px: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per position and simulation day it lives, with marks and exposure prices.

    An interval unfolds to its own days and joins by equality, so work grows with
    days held, not with positions times calendar.
    """
    ends = calendar.groupBy("run_id").agg(F.max("date").alias("sim_end"))
    rows = positions.join(F.broadcast(ends), "run_id")  # one row per run
    rows = rows.withColumn("date", F.explode(F.sequence(
        F.col("entry_date"), F.coalesce("exit_date", "sim_end"))))
    rows = rows.join(calendar, ["run_id", "date"]).join(px, ["pair_id", "date"], "left")
    w = Window.partitionBy(*POSITION).orderBy("date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = {n: F.when(F.col("date") == F.col("entry_date"), F.col(f"entry_price_{n}"))
            .otherwise(F.col(f"p{n}")) for n in (1, 2)}
    rows = rows.withColumns({"s1": seen[1], "s2": seen[2]}).withColumns({
        "prev_1": F.last("s1", ignorenulls=True).over(before),
        "prev_2": F.last("s2", ignorenulls=True).over(before),
    })
    marked = (F.col("date") > F.col("entry_date")) & F.col("p1").isNotNull()
    return rows.withColumns({
        "marked": marked,
        "pnl": F.when(marked, F.col("shares_1") * (F.col("p1") - F.col("prev_1"))
                      + F.col("shares_2") * (F.col("p2") - F.col("prev_2"))),
        "short_value": F.when(marked, F.abs(F.least(F.col("shares_1") * F.col("p1"), F.lit(0.0)))
                              + F.abs(F.least(F.col("shares_2") * F.col("p2"), F.lit(0.0)))),
        "last_1": F.coalesce("s1", "prev_1"), "last_2": F.coalesce("s2", "prev_2"),
        "alive": F.col("exit_date").isNull() | (F.col("date") < F.col("exit_date")),
    })


def valued_trades(positions: DataFrame, days: DataFrame) -> DataFrame:
    """Positions with their summed marks: gross pnl, borrow base, holding days."""
    sums = days.groupBy(*POSITION).agg(
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("gross_pnl"),
        F.coalesce(F.sum("short_value"), F.lit(0.0)).alias("borrow_base"),
        F.count_if("marked").alias("holding_days"),
        F.max_by("last_1", "date").alias("last_price_1"), F.max_by("last_2", "date").alias("last_price_2"),
        F.max("sim_end").alias("date"))
    return positions.join(sums, list(POSITION))


def cost_table(spark, p: BacktestParams, scenario_id: str = "base", run_id: str = "base") -> DataFrame:
    return spark.range(1).select(
        F.lit(scenario_id).alias("scenario_id"), F.lit(run_id).alias("run_id"),
        F.lit(float(p.commission_bps)).alias("commission_bps"),
        F.lit(float(p.slippage_bps)).alias("slippage_bps"),
        F.lit(float(p.borrow_cost_bps)).alias("borrow_bps"))


def trade_log(valued: DataFrame, costs: DataFrame) -> DataFrame:
    """Closed trades with costs, per scenario of the cost table."""
    rows = valued.filter(F.col("exit_date").isNotNull()).join(costs, "run_id")
    turnover = _gross(F.col("entry_price_1"), F.col("entry_price_2")) + _gross(
        F.col("exit_price_1"), F.col("exit_price_2"))
    rows = rows.withColumns({
        "commission_cost": turnover * F.col("commission_bps") / 10000.0,
        "slippage_cost": turnover * F.col("slippage_bps") / 10000.0,
        "borrow_cost": F.col("borrow_base") * F.col("borrow_bps") / 10000.0 / 252.0,
    }).withColumn("transaction_cost",
                  F.col("commission_cost") + F.col("slippage_cost") + F.col("borrow_cost"))
    default = F.when(F.col("exit_action") == "force_exit_max_holding", F.lit("max_holding_days")).otherwise(
        F.col("exit_action"))
    return rows.withColumns({
        "net_pnl": F.col("gross_pnl") - F.col("transaction_cost"),
        "exit_reason": F.when(F.trim("exit_reason") != "", F.trim("exit_reason")).otherwise(default),
    }).select("scenario_id", *TRADE_LOG)


def daily_flows(valued: DataFrame, days: DataFrame) -> DataFrame:
    """Per (run, model, date): gross pnl, borrow base and turnover."""
    marks = days.filter("marked").groupBy("run_id", "model", "date").agg(
        F.sum("pnl").alias("gross"), F.sum("short_value").alias("short_value"),
        F.lit(0.0).alias("turnover"))
    opened = valued.select("run_id", "model", F.col("entry_date").alias("date"),
                           _gross(F.col("entry_price_1"), F.col("entry_price_2")).alias("t"))
    closed = valued.filter(F.col("exit_date").isNotNull()).select(
        "run_id", "model", F.col("exit_date").alias("date"),
        _gross(F.col("exit_price_1"), F.col("exit_price_2")).alias("t"))
    turned = opened.union(closed).groupBy("run_id", "model", "date").agg(
        F.lit(0.0).alias("gross"), F.lit(0.0).alias("short_value"), F.sum("t").alias("turnover"))
    return marks.unionByName(turned).groupBy("run_id", "model", "date").agg(
        F.sum("gross").alias("gross"), F.sum("short_value").alias("short_value"),
        F.sum("turnover").alias("turnover"))


def _model_calendar(prepared: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every (run, date, model): days times the few models of a run."""
    return calendar.join(prepared.select("run_id", "model").distinct(), "run_id")


def daily_pnl(prepared: DataFrame, flows: DataFrame, calendar: DataFrame, costs: DataFrame,
              p: BacktestParams) -> DataFrame:
    """PnL, cost and equity for every simulation day, days without trades included."""
    rows = _model_calendar(prepared, calendar).join(flows, ["run_id", "model", "date"], "left").na.fill(
        0.0, ["gross", "short_value", "turnover"]).join(costs, "run_id")
    cost = F.col("turnover") * (F.col("commission_bps") + F.col("slippage_bps")) / 10000.0 \
        + F.col("short_value") * F.col("borrow_bps") / 10000.0 / 252.0
    w = Window.partitionBy("scenario_id", "model").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("scenario_id", "date", "model", F.col("gross").alias("gross_pnl"),
                       cost.alias("transaction_cost")).withColumn(
        "net_pnl", F.col("gross_pnl") - F.col("transaction_cost")).withColumn(
        "cumulative_net_pnl", F.sum("net_pnl").over(w))
    return rows.withColumn("equity", F.lit(p.initial_capital) + F.col("cumulative_net_pnl"))


def equity_curves(daily: DataFrame) -> DataFrame:
    return daily.select("scenario_id", "date", "model", "cumulative_net_pnl", "equity")


def exposure(prepared: DataFrame, days: DataFrame, flows: DataFrame, calendar: DataFrame,
             costs: DataFrame) -> DataFrame:
    """End-of-day exposure of the positions still open after the day's events."""
    n1, n2 = F.col("shares_1") * F.col("last_1"), F.col("shares_2") * F.col("last_2")
    zero = F.lit(0.0)
    sums = days.filter("alive").groupBy("run_id", "model", "date").agg(
        F.sum(F.abs(n1) + F.abs(n2)).alias("gross_exposure"), F.sum(n1 + n2).alias("net_exposure"),
        F.sum(F.greatest(n1, zero) + F.greatest(n2, zero)).alias("long_exposure"),
        F.sum(F.abs(F.least(n1, zero)) + F.abs(F.least(n2, zero))).alias("short_exposure"),
        F.count(F.lit(1)).alias("active_positions"))
    keys = ["run_id", "model", "date"]
    rows = _model_calendar(prepared, calendar).join(sums, keys, "left").join(
        flows.select(*keys, "turnover"), keys, "left")
    measures = ["gross_exposure", "net_exposure", "long_exposure", "short_exposure"]
    rows = rows.na.fill(0.0, [*measures, "turnover"]).na.fill(0, ["active_positions"])
    return rows.join(costs.select("scenario_id", "run_id"), "run_id").select(
        "scenario_id", "date", "model", *measures, "active_positions", "turnover")


def open_positions(valued: DataFrame, costs: DataFrame) -> DataFrame:
    """Positions never closed, valued at the last simulation day."""
    rows = valued.filter(F.col("exit_date").isNull()).join(costs, "run_id")
    return rows.select(
        "scenario_id", "date", "model", "pair_id", "ticker_1", "ticker_2", "side", "entry_date",
        "entry_price_1", "entry_price_2", "last_price_1", "last_price_2", "hedge_ratio_beta",
        "shares_1", "shares_2",
        _gross(F.col("last_price_1"), F.col("last_price_2")).alias("gross_exposure"),
        (F.col("shares_1") * F.col("last_price_1") + F.col("shares_2") * F.col("last_price_2"))
        .alias("net_exposure"),
        F.col("gross_pnl").alias("unrealized_gross_pnl"),
        (F.col("borrow_base") * F.col("borrow_bps") / 10000.0 / 252.0).alias("accrued_borrow_cost"),
        "holding_days")
