"""Moments of many pairs at once: blocks of price vectors meet in tiles.

Tickers hash into blocks of about ``BLOCK`` within their sector. A tile is a pair of blocks that
some pair spans. A block's vectors are sent once to each of its tiles, never to a pair: the
exchanges that hold a vector are keyed by block and by tile, and what is keyed by pair or ticker
is names and numbers. A tile takes the moments of all its pairs together, two-pass, in numpy:
tickers with prices on the same dates by products of centred matrices, other pairs of a ticker
in one masked pass along the dates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 64

#: Moments of a pair: y and x are the log prices of its legs on their common dates, l the value on
#: the common date before, d the change, r the return.
MOMENTS = ("mean_y", "mean_x", "v_x", "c_yx", "r_yy", "r_xx", "r_yx", "m_yy", "m_xx", "m_yx", "m_dyy", "m_dyx", "m_dxy",
           "m_dxx", "m_vdy", "m_vdx", "m_vdyx")
SCHEMA = "pair_id string, overlap_observations long, m_n long, " + ", ".join(f"{m} double" for m in MOMENTS)


def _blocks(pairs: DataFrame, size: int) -> DataFrame:
    """(ticker, block) of every ticker of ``pairs``; blocks lie inside a sector where pairs have one."""
    sector = [F.trim(f"sector_{n}") if f"sector_{n}" in pairs.columns else F.lit("*") for n in (1, 2)]
    named = pairs.select(F.col("ticker_1").alias("ticker"), sector[0].alias("key")).unionByName(
        pairs.select(F.col("ticker_2").alias("ticker"), sector[1].alias("key")))
    tickers = named.groupBy("ticker").agg(F.coalesce(F.min("key"), F.lit("")).alias("key"))
    counts = tickers.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
    return tickers.join(counts, "key").select(
        "ticker", F.concat_ws(":", "key", F.pmod(F.xxhash64("ticker"), F.col("n")).cast("string")).alias("block"))


def _steps(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log prices, those a row before, changes and returns, along the last axis."""
    logs = np.log(prices)
    return logs, logs[..., :-1], logs[..., 1:] - logs[..., :-1], prices[..., 1:] / prices[..., :-1] - 1


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=-1, keepdims=True)


def _same_dates(prices: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of pairs of rows of ``prices`` (no gaps) by matrix products."""
    n = prices.shape[1]
    logs, before, change, back = _steps(prices)
    y, b, d, r = map(_centred, (logs, before, change, back))

    def of(p, q, rows):
        # With too few rows there is no second moment.
        return (p @ q.T / (rows - 1))[left, right] if rows > 1 else np.full(len(left), np.nan)

    def own(p, q, rows, at):
        return (np.einsum("kt,kt->k", p, q) / (rows - 1))[at] if rows > 1 else np.full(len(at), np.nan)

    mean = logs.mean(axis=1)
    return {"n": np.full(len(left), n), "m": np.full(len(left), n - 1),
            "mean_y": mean[left], "mean_x": mean[right], "v_x": own(y, y, n, right), "c_yx": of(y, y, n),
            "r_yy": own(r, r, n - 1, left), "r_xx": own(r, r, n - 1, right), "r_yx": of(r, r, n - 1),
            "m_yy": own(b, b, n - 1, left), "m_xx": own(b, b, n - 1, right), "m_yx": of(b, b, n - 1),
            "m_dyy": own(d, b, n - 1, left), "m_dyx": of(d, b, n - 1), "m_dxy": of(b, d, n - 1),
            "m_dxx": own(d, b, n - 1, right), "m_vdy": own(d, d, n - 1, left), "m_vdx": own(d, d, n - 1, right),
            "m_vdyx": of(d, d, n - 1)}


def _other_dates(one: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of a price vector with each row of ``many``; NaN is a gap."""
    there = ~np.isnan(one)
    one, many = one[there], many[:, there]
    both = ~np.isnan(many)
    n = both.sum(axis=1)
    place = np.where(both, np.arange(both.shape[1]), -1)
    last = np.maximum.accumulate(place, axis=1)
    last = np.concatenate([np.full((len(many), 1), -1), last[:, :-1]], axis=1)
    step = both & (last >= 0)
    m = step.sum(axis=1)
    p1, p2 = np.broadcast_to(one, many.shape), many
    b1, b2 = one[last], np.take_along_axis(many, np.maximum(last, 0), axis=1)

    def centred(values, mask, rows):
        values = np.where(mask, values, 0.0)
        mean = values.sum(axis=1) / np.maximum(rows, 1)
        return np.where(mask, values - mean[:, None], 0.0), mean

    def moment(p, q, rows):
        return np.where(rows > 1, np.einsum("kt,kt->k", p, q) / np.maximum(rows - 1, 1), np.nan)

    with np.errstate(all="ignore"):
        ly, lx, by, bx = np.log(p1), np.log(p2), np.log(b1), np.log(b2)
        (y, mean_y), (x, mean_x) = centred(ly, both, n), centred(lx, both, n)
        values = [centred(v, step, m)[0] for v in (by, bx, ly - by, lx - bx, p1 / b1 - 1, p2 / b2 - 1)]
    by, bx, dy, dx, ry, rx = values
    return {"n": n, "m": m, "mean_y": mean_y, "mean_x": mean_x, "v_x": moment(x, x, n), "c_yx": moment(y, x, n),
            "r_yy": moment(ry, ry, m), "r_xx": moment(rx, rx, m), "r_yx": moment(ry, rx, m),
            "m_yy": moment(by, by, m), "m_xx": moment(bx, bx, m), "m_yx": moment(by, bx, m), "m_dyy": moment(dy, by, m),
            "m_dyx": moment(dy, bx, m), "m_dxy": moment(dx, by, m), "m_dxx": moment(dx, bx, m), "m_vdy": moment(dy, dy, m),
            "m_vdx": moment(dx, dx, m), "m_vdyx": moment(dy, dx, m)}


def tile(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Moments of one tile's pairs; a pair without a common date has no row."""
    closes = vectors.column("closes").combine_chunks()
    prices = closes.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(closes), -1)
    at = {t: k for k, t in enumerate(vectors.column("ticker").to_pylist())}
    left = np.array([at.get(t, -1) for t in pairs.column("ticker_1").to_pylist()], np.int64)
    right = np.array([at.get(t, -1) for t in pairs.column("ticker_2").to_pylist()], np.int64)
    known = np.flatnonzero((left >= 0) & (right >= 0))
    out = {k: np.zeros(len(left)) for k in ("n", "m", *MOMENTS)}
    if len(known):
        # Dates as bits tell the tickers with the same ones.
        dates = np.unique(np.packbits(~np.isnan(prices), axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        same = known[dates[left[known]] == dates[right[known]]]
        parts = []
        for group in np.unique(dates[left[same]]):
            some = same[dates[left[same]] == group]
            rows, place = np.unique(np.concatenate([left[some], right[some]]), return_inverse=True)
            inside = prices[rows][:, ~np.isnan(prices[rows[0]])]
            if inside.shape[1]:
                parts.append((some, _same_dates(inside, place[:len(some)], place[len(some):])))
        others = known[dates[left[known]] != dates[right[known]]]
        for one in np.unique(left[others]):
            some = others[left[others] == one]
            parts.append((some, _other_dates(prices[one], prices[right[some]])))
        for some, found in parts:
            for k, v in found.items():
                out[k][some] = v
    table = pa.table({"pair_id": pairs.column("pair_id").combine_chunks(), "overlap_observations": pa.array(out["n"].astype(np.int64)),
                      "m_n": pa.array(out["m"].astype(np.int64)),
                      **{k: pa.array(out[k], pa.float64(), from_pandas=True) for k in MOMENTS}})
    return table.filter(pa.array(out["n"] > 0))


def pair_moments(pairs: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Moments of every pair (pair_id, ticker_1, ticker_2, perhaps sectors) with a common date."""
    blocks = _blocks(pairs, block)
    sides = [blocks.select(F.col("ticker").alias(f"ticker_{n}"), F.col("block").alias(f"block_{n}")) for n in (1, 2)]
    dealt = pairs.select("pair_id", "ticker_1", "ticker_2").join(sides[0], "ticker_1").join(sides[1], "ticker_2").select(
        "pair_id", "ticker_1", "ticker_2", F.least("block_1", "block_2").alias("row"),
        F.greatest("block_1", "block_2").alias("column"))
    tiles = dealt.select("row", "column").distinct()
    wanted = tiles.select(F.col("row").alias("r"), F.col("column").alias("c"), F.explode(F.array_distinct(F.array("row", "column"))).alias("block"))
    shipped = vectors.join(blocks, "ticker").join(wanted, "block").select("r", "c", "ticker", "closes")
    return dealt.groupBy("row", "column").cogroup(shipped.groupBy("r", "c")).applyInArrow(tile, SCHEMA)
