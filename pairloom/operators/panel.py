"""Price panels: the de-duplicated daily view of the long price table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import latest
from ..params import Period


def price_panel(prices: DataFrame, period: Period, tickers: DataFrame | None = None,
                unique: bool = False) -> DataFrame:
    """One row per (ticker, date): adjusted close and volume.

    The date range and the ticker list filter before the shuffle, the last
    source row of a day wins, and a price that is not positive is missing.
    With ``unique`` (one row per key already, as after cleaning) nothing shuffles.
    """
    rows = prices.filter(F.col("date").between(F.lit(period.start), F.lit(period.end)))
    if tickers is not None:
        rows = rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    rows = latest(rows.select("ticker", "date", "adjusted_close", "volume",
                              *[c for c in ("ord",) if c in rows.columns]), ["ticker", "date"], unique, "prices")
    return rows.select(
        "ticker", "date",
        F.when(F.col("adjusted_close") > 0, F.col("adjusted_close")).alias("adjusted_close"),
        "volume",
    )


def listed_tickers(constituents: DataFrame, explicit: tuple = ()) -> DataFrame:
    """Tickers to load: the explicit list when given, else the constituents."""
    if explicit:
        names = F.array(*[F.lit(str(t)) for t in explicit])
        source = constituents.sparkSession.range(1).select(F.explode(names).alias("ticker"))
    else:
        source = constituents.select("ticker")
    source = source.select(F.upper(F.trim("ticker")).alias("ticker"))
    return source.filter(F.col("ticker") != "").distinct()


def price_vectors(panel: DataFrame, period: Period) -> DataFrame:
    """One row per ticker: adjusted close by day offset from the period start.

    ``closes[i]`` is the price ``i`` days after ``period.start`` or NULL. A vector
    is as long as the period, whatever the data volume, and two of them align by
    position. Shipping a vector to a pair moves 8 bytes a day instead of a keyed row.
    """
    packed = (
        panel.filter(F.col("adjusted_close").isNotNull())
        .filter(F.col("date").between(F.lit(period.start), F.lit(period.end)))
        .groupBy("ticker")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.datediff("date", F.lit(period.start)).alias("i"),
            F.col("adjusted_close").alias("px"),
        ))).alias("points"))
    )
    # Gaps become NULL runs between neighbours: one pass over the points, no lookups.
    size = F.size("points")
    first_gap = F.array_repeat(F.lit(None).cast("double"), F.col("points")[0]["i"])
    runs = F.transform(
        "points",
        lambda p, k: F.concat(
            F.array(p["px"]),
            F.array_repeat(
                F.lit(None).cast("double"),
                F.when(k + 1 < size, F.get(F.col("points"), k + 1)["i"])
                .otherwise(F.lit(period.days)) - p["i"] - 1,
            ),
        ),
    )
    return packed.select("ticker", F.concat(first_gap, F.flatten(runs)).alias("closes"))


def with_vectors(pairs: DataFrame, vectors: DataFrame, keys: list) -> DataFrame:
    """Pair keys with both legs' vectors (``c1``, ``c2``).

    The keys are dealt over the tasks first. While the vectors' table is small enough to
    broadcast by its measured size, no vector is shuffled; beyond that the joins shuffle
    by ticker.
    """
    v1 = vectors.select(F.col("ticker").alias("ticker_1"), F.col("closes").alias("c1"))
    v2 = vectors.select(F.col("ticker").alias("ticker_2"), F.col("closes").alias("c2"))
    return pairs.select(*keys).repartition("pair_id").join(v1, "ticker_1").join(v2, "ticker_2")


def aligned_prices(pairs: DataFrame, vectors: DataFrame, period: Period,
                   keep: tuple = ()) -> DataFrame:
    """Dates on which both legs of a pair have a price."""
    keys = ["pair_id", "ticker_1", "ticker_2", *keep]
    return (
        with_vectors(pairs, vectors, keys)
        .select(*keys, F.posexplode(F.arrays_zip("c1", "c2")).alias("i", "c"))
        .filter(F.col("c.c1").isNotNull() & F.col("c.c2").isNotNull())
        .select(
            *keys,
            F.date_add(F.lit(period.start), F.col("i")).alias("date"),
            F.col("c.c1").alias("adjusted_close_1"),
            F.col("c.c2").alias("adjusted_close_2"),
        )
    )
