"""Whitened embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries become whole numbers x = floor(64 * c) + 1000000, so counts and sums are exact. One pass
gives n and the sums S, a second the scatter of x - S/n: every task adds up d x d numbers of its
rows, which meet in one aggregate by matrix place. The driver then holds that one matrix (d^2
numbers whatever the number of rows). Its Cholesky factor with diagonal pivoting stops at the
numerical rank; one-sided Jacobi rotates pairs of the factor's columns until all are orthogonal.
Their squared norms are the scatter's eigenvalues, the columns over their norms its eigenvectors.
A last pass projects every row, and its own second moments say how far from white the result is.

Rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, and so are
those of another length than most vectors have (of equally common lengths the greatest counts).
Entries beyond 2^46 count as 2^46. Repeated rows and ids count each. Components with an
eigenvalue of zero (to rounding) are left out: one row, or equal rows, give no result, nor does an
empty table. ``deviation`` is exact; where it does not fit a long it is null. Other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import common

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Greatest magnitude of an entry.
LIMIT = 2.0 ** 46
#: Columns whose cosine is below this count as orthogonal.
ORTHOGONAL = 1e-15
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-14) -> np.ndarray:
    """A factor G (d x rank) with G G' = a, by the greatest remaining diagonal entry at each step.

    Its rows are in a's order; with rows in pivot order it is lower triangular.
    """
    d = len(a)
    rest = np.diag(a).astype(float).copy()
    stop = tolerance * d * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((d, d))
    free = np.ones(d, bool)
    for k in range(d):
        pivot = int(np.argmax(np.where(free, rest, -np.inf)))
        if rest[pivot] <= stop:
            return factor[:, :k]
        root = np.sqrt(rest[pivot])
        column = np.where(free, (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / root, 0.0)
        column[pivot] = root
        factor[:, k] = column
        free[pivot] = False
        rest = rest - column ** 2
    return factor


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs (a round-robin tournament)."""
    seats = np.arange(n + n % 2)
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        left, right = seats[:half], seats[half:][::-1]
        real = (left < n) & (right < n)
        yield left[real], right[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of factor factor', by rotations of
    pairs of its columns; a round rotates disjoint pairs at once."""
    g = factor.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > ORTHOGONAL
            zeta = (b - a) / (2 * np.where(turn, c, 1.0))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            cs = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = cs * x - cs * t * y, cs * t * x + cs * y
        if worst <= ORTHOGONAL * 10:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], g[:, order] / np.sqrt(values[order])


@dataclass(frozen=True)
class Model:
    """What a whitening needs: rows n, whole sums, eigenvectors (columns) and eigenvalues."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """floor(S/n) and the remainder S - n * floor(S/n) of each dimension."""
        whole = [divmod(s, self.n) for s in self.sums]
        return np.array([w for w, _ in whole], np.int64), np.array([r for _, r in whole], np.int64)


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """x of a batch whose vectors all have one length and no gaps."""
    column = batch.column("_v")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * np.clip(flat, -LIMIT, LIMIT)).astype(np.int64).reshape(batch.num_rows, -1) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums: high and low halves of x are added apart, so neither overflows."""
    def run(batches):
        low = high = 0
        n = 0
        for batch in batches:
            x = _whole(batch)
            low, high, n = low + (x & 0x3FFFFFF).sum(axis=0), high + (x >> 26).sum(axis=0), n + len(x)
        if n:
            k = len(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(np.full(k, n))],
                ["i", "low", "high", "n"])

    found = (rows.mapInArrow(run, "i int, low long, high long, n long").groupBy("i").agg(
        F.sum(F.col("low").cast("decimal(20,0)")).alias("low"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"),
        F.sum("n").alias("n")).orderBy("i").collect())
    return (found[0]["n"], [int(r["high"]) * (1 << 26) + int(r["low"]) for r in found]) if found else (0, [])


def _second_moments(rows: DataFrame, values) -> np.ndarray:
    """Sum over all rows of v v', where values(batch) gives the v's; d x d numbers a task."""
    def run(batches):
        total = None
        for batch in batches:
            v = values(batch)
            total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(total[i, j])], ["i", "j", "v"])

    found = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (found[c].to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = v
    out[j, i] = v
    return out


def _centred(n: int, sums: list[int]):
    base = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n for s in sums], np.float64) / n
    return lambda batch: (_whole(batch) - base).astype(np.float64) - part


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows (_id, _v) that take part: whole finite vectors of the commonest length."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col(key).cast("long").alias("_id"), v.alias("_v")).filter(
        F.col("_v").isNotNull() & (F.size("_v") > 0)).filter(F.coalesce(good, F.lit(False)))
    most = rows.groupBy(F.size("_v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return rows.filter(F.size("_v") == F.lit(most["k"] if most else 0))


def fit(rows: DataFrame) -> Model | None:
    """The whitening of usable rows; None without rows."""
    n, sums = _sums(rows)
    if not n:
        return None
    scatter = _second_moments(rows, _centred(n, sums))
    values, vectors = jacobi(pivoted_cholesky(scatter))
    return Model(n, tuple(sums), vectors, values / n, float(np.trace(scatter)) / n)


def _deviations(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sums of (n*x - S)^2; whole-number arithmetic, in Python's integers where a long might overflow."""
    near = np.abs((x - base).astype(np.float64) * n - rest).max(initial=0.0)
    if near * near * x.shape[1] < 2.0 ** 62:
        return pa.array((((x - base) * n - rest) ** 2).sum(axis=1))
    exact = ((((x - base).astype(object)) * n - rest.astype(object)) ** 2).sum(axis=1).tolist()
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(rows: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row: _id, deviation and its whitened numbers (an array)."""
    k = min(components, len(model.values))
    base, rest = model.base
    turn = model.vectors[:, :k] / np.sqrt(model.values[:k])
    n, part = model.n, rest.astype(np.float64) / model.n

    def run(batches):
        for batch in batches:
            x = _whole(batch)
            out = ((x - base).astype(np.float64) - part) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), _deviations(x, n, base, rest), lists],
                                             ["_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from those rows."""
    def values(batch):
        flat = batch.column("whitened").flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(batch.num_rows, -1)

    def centred(batch):
        return values(batch) - mean

    k = len(whitened.select("whitened").first()["whitened"])
    means = whitened.select([F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    mean = np.array([means[f"m{i}"] for i in range(k)])
    return float(np.abs(_second_moments(whitened, centred) / n - np.eye(k)).max())


def components(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id",
               most: int = COMPONENTS) -> DataFrame:
    """The operator: one row for each usable row and component."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows = usable(embeddings, vector, key)
    model = fit(rows)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    whitened = common.stage(whiten(rows, model, most), "whitened")
    error = identity_error(whitened, model.n)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:most]])
    return whitened.select(F.col("_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    return components(common.read_table(spark, sf_dir, "embeddings"))
