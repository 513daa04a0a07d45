"""Statistics built from Spark aggregates, plus small Arrow functions.

The aggregates carry all the data volume. Arrow functions only see one row per
pair (an AR(1) likelihood in one unknown).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import ratio


DOUBLE = T.DoubleType()


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, DOUBLE) for n in names])


# --------------------------------------------------------------------------- AR(1) moments

def ar1_moments(y: str, x: str, y1: str, x1: str) -> list[Column]:
    """Second moments from which any spread ``y - beta*x`` can be tested later.

    The spread, its lag and its change are linear in the two log prices, so the
    regression of the change on the lag only needs covariances of the price
    columns. That lets ONE pass give beta, the Dickey-Fuller statistic and the
    half-life, instead of a second pass once beta is known.
    """
    y_, x_, ly, lx = F.col(y), F.col(x), F.col(y1), F.col(x1)
    dy, dx = y_ - ly, x_ - lx
    return [
        F.count(dy).alias("m_n"),
        F.var_samp(ly).alias("m_yy"), F.var_samp(lx).alias("m_xx"),
        F.covar_samp(ly, lx).alias("m_yx"),
        F.covar_samp(dy, ly).alias("m_dyy"), F.covar_samp(dy, lx).alias("m_dyx"),
        F.covar_samp(dx, ly).alias("m_dxy"), F.covar_samp(dx, lx).alias("m_dxx"),
        F.var_samp(dy).alias("m_vdy"), F.var_samp(dx).alias("m_vdx"),
        F.covar_samp(dy, dx).alias("m_vdyx"),
    ]


@dataclass(frozen=True)
class SpreadTest:
    gamma: Column
    statistic: Column
    half_life: Column


def spread_test(beta: Column) -> SpreadTest:
    """Dickey-Fuller statistic and half-life of ``y - beta*x`` from the moments."""
    m = {k: F.col(f"m_{k}") for k in
         ("n", "yy", "xx", "yx", "dyy", "dyx", "dxy", "dxx", "vdy", "vdx", "vdyx")}
    scale = m["yy"] + beta * beta * m["xx"]
    var_lag = m["yy"] - 2 * beta * m["yx"] + beta * beta * m["xx"]
    cov = m["dyy"] - beta * (m["dxy"] + m["dyx"]) + beta * beta * m["dxx"]
    var_delta = m["vdy"] - 2 * beta * m["vdyx"] + beta * beta * m["vdx"]
    # A spread that is constant up to rounding has no second regressor.
    usable = (m["n"] >= 2) & (var_lag > scale * 1e-13)
    gamma = F.when(usable, ratio(cov, var_lag))
    sse = F.greatest(var_delta - gamma * cov, F.lit(0.0)) * (m["n"] - 1)
    error = F.sqrt(ratio(ratio(sse, m["n"] - 2), var_lag * (m["n"] - 1)))
    statistic = (
        F.when(gamma.isNull() | (m["n"] <= 2), F.lit(0.0))
        .when(error == 0, F.when(gamma < 0, F.lit(-10.0)).otherwise(F.lit(0.0)))
        .otherwise(ratio(gamma, error))
    )
    half_life = F.when(gamma < 0, ratio(F.lit(-math.log(2)), gamma))
    return SpreadTest(gamma, statistic, half_life)


def erfc(x: Column) -> Column:
    """Complementary error function of a value that is not negative.

    Below 2 the all-positive series of the error function, from there the continued
    fraction; both are long enough for full double precision.
    """
    square = x * x
    series = F.lit(1.0)
    for k in range(45, 0, -1):
        series = series * square * F.lit(2.0 / (2 * k + 1)) + 1.0
    fraction = x
    for k in range(50, 0, -1):
        fraction = x + F.lit(k / 2) / fraction
    edge = F.exp(-square) / F.lit(math.sqrt(math.pi))
    return F.when(x < 2, F.lit(1.0) - 2.0 * edge * x * series).otherwise(edge / fraction)


def two_sided_normal(statistic) -> Column:
    """P(|Z| > |t|)."""
    t = F.col(statistic) if isinstance(statistic, str) else statistic
    return erfc(F.abs(t) / F.lit(math.sqrt(2)))


# --------------------------------------------------------------------------- unit-root test

# Published response-surface coefficients (MacKinnon 1994, constant
# case) for one and two integrated series: bounds, then the small-p and large-p
# polynomials in the statistic, constant term first.
TAU = {
    1: {"max": 2.74, "min": -18.83, "star": -1.61,
        "small": (2.1659, 1.4412, 0.038269),
        "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"max": 0.92, "min": -18.86, "star": -2.62,
        "small": (2.92, 1.5012, 0.039796),
        "large": (2.1945, 0.64695, -0.29198, -0.042377)},
}


# --------------------------------------------------------------------------- AR(1) likelihood

@F.pandas_udf(_doubles("phi", "mu"))
def ar1_fit(n: pd.Series, q: pd.Series, lag: pd.Series, first: pd.Series,
            last: pd.Series) -> pd.DataFrame:
    """Exact Gaussian AR(1) fit with a mean, for all pairs of a batch at once.

    Inputs are sums over the mean-centred series: squares ``q``, lagged products
    ``lag``, and the first and last value. Mean and variance drop out in closed
    form, which leaves one likelihood equation in phi, solved by bisection.
    """
    n, q, lag, a, b = (np.asarray(v, float) for v in (n, q, lag, first, last))

    def mean(phi):
        return phi * (a + b) / ((1 + phi) + (n - 1) * (1 - phi))

    def slope(phi):
        mu = mean(phi)
        cross = lag + mu * (a + b) + (n - 1) * mu ** 2
        early = q - b ** 2 + 2 * mu * b + (n - 1) * mu ** 2
        late = q - a ** 2 + 2 * mu * a + (n - 1) * mu ** 2
        squares = (1 - phi ** 2) * (a - mu) ** 2 + late - 2 * phi * cross + phi ** 2 * early
        change = 2 * (phi * (early - (a - mu) ** 2) - cross)
        return n * change / np.maximum(squares, 1e-300) + 2 * phi / (1 - phi ** 2)

    lo, hi = np.full(len(n), -1 + 1e-9), np.full(len(n), 1 - 1e-9)
    for _ in range(64):
        middle = (lo + hi) / 2
        falling = slope(middle) < 0
        lo, hi = np.where(falling, middle, lo), np.where(falling, hi, middle)
    phi = (lo + hi) / 2
    return pd.DataFrame({"phi": phi, "mu": mean(phi)})


# --------------------------------------------------------------------------- exact medians

def exact_median(df: DataFrame, keys: list[str], value: str, out: str, margin: float = 0.001) -> DataFrame:
    """Median per key without gathering a whole group in one task.

    A mergeable sketch first brackets the median (its rank error is a hundredth of
    the bracket's margin). Only values inside the bracket are then ranked, equal ones
    counted together, so the ranked part is a small share of the group. Exact.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [0.5 - margin, 0.5 + margin], 100_000).alias("b"))
    bounds = bounds.select(*keys, "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    marked = rows.join(bounds, keys)
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    counted = marked.filter(F.col("v") <= F.col("hi")).withColumn("v", F.when(inside, F.col("v")))
    # Values below the bracket collapse into one NULL row per key, which sorts first.
    counted = counted.groupBy(*keys, "n", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v"))
    ranked = counted.withColumn("upto", F.sum("c").over(w))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return ranked.groupBy(*keys).agg(
        ((F.min(F.when(F.col("upto") >= low, F.col("v"))) + F.min(F.when(F.col("upto") >= high, F.col("v"))))
         / 2).alias(out))


# --------------------------------------------------------------------------- expanding quantiles

class Ranks:
    """Counts of seen values by rank (a binary indexed tree): insert and k-th value in log n."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.unique(values)
        self.rank = np.searchsorted(self.sorted, values)
        self.tree = [0] * (len(self.sorted) + 1)
        self.top = 1 << max(0, len(self.sorted).bit_length() - 1)
        self.size = 0

    def insert(self, rank: int) -> None:
        self.size += 1
        at = rank + 1
        while at < len(self.tree):
            self.tree[at] += 1
            at += at & -at

    def kth(self, k: int) -> float:
        """Value with ``k`` seen values before it in order."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= k:
                at += step
                k -= self.tree[at]
            step >>= 1
        return float(self.sorted[at])

    def quantile(self, q: float) -> float | None:
        """Linear interpolation between the neighbours of rank q * (n - 1); None of nothing."""
        if not self.size:
            return None
        position = q * (self.size - 1)
        low, high = math.floor(position), math.ceil(position)
        a = self.kth(low)
        return a if low == high else (high - position) * a + (position - low) * self.kth(high)


def expanding_quantiles(df: DataFrame, keys: tuple, order: str, value: str, quantiles: dict) -> DataFrame:
    """``df`` with, per row, quantiles of the known values of all earlier rows of its series.

    A series (``keys``) is bounded by the calendar and one task's; it costs n log n.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(order, "ascending")])
        known = rows.column(value).is_valid().to_numpy()
        numbers = rows.column(value).to_numpy(zero_copy_only=False).astype(float)
        seen = Ranks(numbers[known])
        ranks = iter(seen.rank.tolist())
        out = {name: [] for name in quantiles}
        for there in known.tolist():
            for name, q in quantiles.items():
                out[name].append(seen.quantile(q))
            if there:
                seen.insert(next(ranks))
        for name, values in out.items():
            rows = rows.append_column(name, pa.array(values, pa.float64()))
        return rows

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, DOUBLE) for n in quantiles]])
    return df.groupBy(*keys).applyInArrow(run, schema)
