"""Unit-root tests with a chosen number of lagged changes, from mergeable lag products.

The regressors of such a test are the level and its lagged changes, all of them differences of
one series at some lag. So one aggregate with a sum per lag (products of the series with itself
that many rows before) and the values at its two ends give the Gram matrix of the regression for
any number of lags and any first row: along a diagonal it only changes by products of end values.
The aggregate combines before its shuffle and leaves one narrow row per series. Cholesky factors
of the small matrices, the choice of the lag by AIC and the p-value are column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .stats import TAU, erfc

#: A pivot below this share of its diagonal entry counts as zero.
SINGULAR = 1e-12


def lag_bound(n: int) -> int:
    """Greatest number of lags for a series of that length (before the bound by its half)."""
    return math.ceil(12.0 * (n / 100.0) ** 0.25)


def with_tau_p(df: DataFrame, statistic: str, out: str, series: int) -> DataFrame:
    """``df`` with the response-surface p-value of a unit-root statistic."""
    row, t = TAU[series], F.col(statistic)

    def powers(coefficients):
        out = F.lit(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = out * t + F.lit(c)
        return out

    z = F.when(t <= row["star"], powers(row["small"])).otherwise(powers(row["large"]))
    tail = erfc(F.col("_far")) * 0.5
    known = F.when(t > row["max"], F.lit(1.0)).when(t < row["min"], F.lit(0.0))
    return df.withColumn("_z", z).withColumn("_far", F.abs("_z") / F.lit(math.sqrt(2))).withColumn("_tail", tail).withColumn(
        out, F.when(t.isNotNull(), F.coalesce(known, F.when(F.col("_z") < 0, F.col("_tail")).otherwise(
            F.lit(1.0) - F.col("_tail"))))).drop("_z", "_far", "_tail")


def lag_sums(series: DataFrame, const: bool, longest: int, max_lag: int | None = None) -> DataFrame:
    """One row per (pair_id, s): its length n, the most lags tried, lag products and end values.

    ``longest`` bounds the length of a series. Series too short for any test are left out.
    """
    most = lag_bound(longest) if max_lag is None else min(max_lag, lag_bound(longest))
    base = 2 if const else 1
    n = F.size("s")
    bound = F.ceil(F.pow(n / F.lit(100.0), F.lit(0.25)) * 12.0).cast("int")
    limit = F.least(bound, F.floor(n / 2).cast("int") - base, F.lit(most))
    rows = series.select("pair_id", n.alias("n"), limit.alias("limit"), "s").filter("limit >= 0")
    # Row t holds s[t], s[t-1], ... as far as the lags go.
    before = F.transform("s", lambda v, t: F.struct(
        t.alias("t"), F.reverse(F.slice("s", F.greatest(t - most, F.lit(1)), t + 1 - F.greatest(t - most - 1, F.lit(0)))).alias("v")))
    rows = rows.select("pair_id", "n", "limit", F.inline(before))
    here = F.col("v")[0]
    products = [F.sum(here * F.get("v", F.lit(k))).alias(f"p{k}") for k in range(most + 2)]
    sums = rows.groupBy("pair_id").agg(
        F.max("n").alias("n"), F.max("limit").alias("limit"), F.sum(here).alias("total"), *products,
        F.max(F.when(F.col("t") == F.least(F.lit(most + 1), F.col("n") - 1), F.col("v"))).alias("head"),
        F.max(F.when(F.col("t") == F.col("n") - 1, F.col("v"))).alias("tail"))
    return sums.select("pair_id", "n", "limit", "total", F.array(*[f"p{k}" for k in range(most + 2)]).alias("products"),
                       F.reverse("head").alias("head"), "tail")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def raw_gram(lags: Column) -> Column:
    """Rows i of sums over t of s[t-i] * s[t-j], j = i..lags+1, over the t that have all lags.

    The first row is the products less those of the first rows of the series; the next row is the
    one above, moved by one row of the series: a product of first values enters, one of last
    values leaves.
    """
    head, tail = F.col("head"), F.col("tail")
    first = F.transform(F.sequence(F.lit(0), lags + 1), lambda j: F.get("products", j) - _dot(
        F.slice(head, j + 1, lags + 1 - j), F.slice(head, F.lit(1), lags + 1 - j)))

    def below(rows, i):
        above = F.element_at(rows, -1)
        moved = F.transform(F.slice(above, F.lit(1), F.size(above) - 1), lambda x, q: (
            x + F.get(head, lags - i + 1) * F.get(head, lags - i + 1 - q) - F.get(tail, i - 1) * F.get(tail, i - 1 + q)))
        return F.concat(rows, F.array(moved))

    return F.aggregate(F.sequence(F.lit(1), lags + 1), F.array(first), below)


def gram(order: Column, lags: Column, raw: Column, const: bool) -> Column:
    """Lower rows of the Gram matrix of the regressors in ``order``: -1 is the level, 0 the change,
    k the change k rows before; about their means where the regression has a constant."""
    rows = F.col("n") - 1 - lags

    def at(i, j):
        return F.get(F.get(raw, F.least(i, j)), F.abs(i - j))

    def level(j):
        return at(F.lit(1), j) - at(F.lit(1), j + 1)

    def total(a):
        # The level's sum leaves out the first rows and the last; sums of changes are differences.
        whole = F.col("total") - F.aggregate(F.slice("head", F.lit(1), lags), F.lit(0.0), lambda s, v: s + v) - F.col("tail")[0]
        return F.when(a < 0, whole).otherwise(F.get("tail", a) - F.get("head", lags - a))

    def entry(a, b):
        change = at(a, b) - at(a, b + 1) - at(a + 1, b) + at(a + 1, b + 1)
        value = (F.when((a < 0) & (b < 0), at(F.lit(1), F.lit(1))).when(a < 0, level(b)).when(b < 0, level(a))
                 .otherwise(change))
        return value - total(a) * total(b) / rows if const else value

    return F.transform(order, lambda a, i: F.transform(F.slice(order, F.lit(1), i + 1), lambda b: entry(a, b)))


def cholesky(lower: Column) -> Column:
    """Lower Cholesky rows; a pivot that rounding cannot tell from zero is 0, as is all that divides by it."""
    def row(done, values):
        def cell(out, j):
            rest = F.get(values, j) - _dot(out, F.slice(F.get(done, j), F.lit(1), j))
            pivot = F.element_at(F.get(done, j), -1)
            return F.concat(out, F.array(F.when(pivot > 0, rest / pivot).otherwise(0.0)))

        left = F.aggregate(F.when(F.size(done) > 0, F.sequence(F.lit(0), F.size(done) - 1)).otherwise(
            F.array().cast("array<int>")), F.array().cast("array<double>"), cell)
        whole = F.element_at(values, -1)
        last = whole - _dot(left, left)
        return F.concat(done, F.array(F.concat(left, F.array(
            F.when(last > whole * SINGULAR, F.sqrt(F.greatest(last, F.lit(0.0)))).otherwise(0.0)))))

    return F.aggregate(lower, F.array().cast("array<array<double>>"), row)


def _numbers(lags: Column) -> Column:
    """1..lags."""
    return F.when(lags > 0, F.sequence(F.lit(1), F.greatest(lags, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def unit_root(series: DataFrame, const: bool, longest: int, max_lag: int | None = None) -> DataFrame:
    """pair_id, statistic and lags of every series (pair_id, s); with ``const`` about a mean.

    The lag of least AIC (the shorter of equal ones) over the rows that all lag lengths have, then
    the t statistic of the level over all rows that this lag leaves. A regression with collinear
    columns, or with no error, has a NULL statistic.
    """
    base = 2 if const else 1
    limit, rows = F.col("limit"), F.col("n") - 1 - F.col("limit")
    level, change = F.array(F.lit(-1)), F.array(F.lit(0))
    sums = lag_sums(series, const, longest, max_lag)
    # Nested regressions: each column of the factor's last row takes its part off the error.
    sums = sums.withColumn("raw", raw_gram(limit))
    sums = sums.withColumn("lower", gram(F.concat(level, _numbers(limit), change), limit, F.col("raw"), const))
    sums = sums.withColumn("last", F.element_at(cholesky(F.col("lower")), -1)).withColumn(
        "all", F.element_at(F.element_at("lower", -1), -1))
    left = F.transform(F.sequence(F.lit(0), limit), lambda k: F.greatest(
        F.col("all") - _dot(F.slice("last", F.lit(1), k + 1), F.slice("last", F.lit(1), k + 1)), F.lit(1e-300)))
    scores = F.transform(left, lambda v, k: F.struct((rows * F.ln(v / rows) + 2 * (k + base)).alias("aic"), k.alias("k")))
    sums = sums.withColumn("lags", F.array_min(scores)["k"])

    lags = F.col("lags")
    sums = sums.withColumn("raw", raw_gram(lags))
    sums = sums.withColumn("lower", gram(F.concat(_numbers(lags), level, change), lags, F.col("raw"), const))
    sums = sums.withColumn("factor", cholesky(F.col("lower")))
    last = F.element_at("factor", -1)
    free = F.col("n") - 1 - lags - (lags + base)
    whole = F.forall(F.slice("factor", F.lit(1), F.size("factor") - 1), lambda r: F.element_at(r, -1) > 0)
    error = F.element_at(last, -1) / F.sqrt(free.cast("double"))
    statistic = F.when(whole & (free > 0) & (error > 0), F.element_at(last, -2) / error)
    return sums.select("pair_id", statistic.alias("statistic"), lags.cast("int").alias("lags"))
