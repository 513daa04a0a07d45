"""Gradient-boosted regression trees: second-order gains over quantile bins, a histogram a level.

Inputs are cut once into at most ``BINS`` bins by quantiles weighted with the loss's second
derivative (1 for squared error, so plain quantiles). Each level of a tree is one job over blocks
of rows that executors keep: a task adds first and second derivatives of its rows per (node, input,
bin), and the driver sees a table of nodes x inputs x bins, whatever the number of rows. A split's
gain and a leaf's weight carry a squared penalty and an absolute one, and a split has to gain more
than a fixed price. The children's sums are those of the split, so leaves cost no pass.

Rows keep the sum of the trees so far; it is renewed every ``KEPT`` trees, so a pass replays few
trees. A lost executor's blocks are made again from the staged rows. Rows and inputs of a tree are
drawn by hash and seed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions import passes
from ..params import ForecastParams
from ..session import stage_table

BINS = 64
KEPT = 25


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: input (-1 is a leaf), first bin that goes right, value."""

    inputs: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of every row after ``depth`` levels."""
        node = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(depth):
            at = self.inputs[node]
            node = np.where(at >= 0, 2 * node + 1 + (bins[row, at] >= self.bins[node]), node)
        return node


def shrunk(g, alpha: float):
    """A sum of derivatives after the absolute penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def weight(g, h, p: ForecastParams):
    """Leaf weight of least penalised loss."""
    return -shrunk(g, p.l1) / (h + p.l2)


def best_split(g: np.ndarray, h: np.ndarray, p: ForecastParams):
    """(gain, input, bin) of a node's best split from histograms (inputs x bins), or None.

    Rows of bins below ``bin`` go left. Equal gains go to the first input and bin.
    """
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
    right_g, right_h = total_g - left_g, total_h - left_h

    def score(a, b):
        return shrunk(a, p.l1) ** 2 / (b + p.l2)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)) / 2 - p.split_price
    gain[(left_h < p.least_weight) | (right_h < p.least_weight) | ~np.isfinite(gain)] = -np.inf
    at = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[at]), int(at[0]), int(at[1]) + 1) if gain.size and gain[at] > 1e-12 else None


def quantile_cuts(rows: DataFrame, size: int, bins: int = BINS) -> list[np.ndarray]:
    """Borders of each input's bins; a value on a border belongs to the bin above it."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col("inputs")[i], shares, 10_000).alias(f"c{i}") for i in range(size)]).first()
    return [np.unique(np.array(found[f"c{i}"] or [], float)) for i in range(size)]


def binned(inputs: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, inputs[:, i], side="right") for i, c in enumerate(cuts)], axis=1)


def _inputs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("inputs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _drawn(uid: np.ndarray, tree: int, p: ForecastParams) -> np.ndarray:
    """Which rows a tree sees: a hash of row and tree below the share."""
    x = uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0xD6E8FEB8 + p.seed)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(float) / 2.0 ** 24 < p.subsample


def _sums(x: np.ndarray, slope: np.ndarray, tree: Tree, depth: int, columns: np.ndarray, bins: int) -> np.ndarray:
    """First, then second derivatives of rows by (node of ``depth``, input, bin), as one vector."""
    size = 2 ** depth * len(columns) * bins
    node = tree.place(x, depth) - (2 ** depth - 1)
    live = node >= 0
    place = ((node[live, None] * len(columns) + np.arange(len(columns))) * bins + x[live][:, columns]).reshape(-1)
    return np.concatenate([np.bincount(place, np.repeat(slope[live], len(columns)), size), np.bincount(place, minlength=size)])


def grow(histogram: Callable, size: int, bins: int, number: int, p: ForecastParams) -> Tree:
    """One more tree; ``histogram(tree, depth, columns)`` gives the ``_sums`` of all its rows."""
    draw = np.random.default_rng((p.seed, number))
    columns = np.sort(draw.choice(size, max(1, int(p.column_sample * size)), replace=False))
    count = 2 ** (p.tree_depth + 1) - 1
    tree = Tree(np.full(count, -1), np.zeros(count, np.int64), np.zeros(count))
    for depth in range(p.tree_depth):
        g, h = histogram(tree, depth, columns).reshape(2, 2 ** depth, len(columns), bins)
        for k in range(2 ** depth):
            node = 2 ** depth - 1 + k
            if depth == 0:
                tree.values[0] = p.learning_rate * weight(g[0, 0].sum(), h[0, 0].sum(), p)
            split = best_split(g[k], h[k], p) if h[k].any() else None
            if split:
                _, at, cut = split
                tree.inputs[node], tree.bins[node] = columns[at], cut
                for child, side in ((2 * node + 1, slice(0, cut)), (2 * node + 2, slice(cut, None))):
                    tree.values[child] = p.learning_rate * weight(g[k, at, side].sum(), h[k, at, side].sum(), p)
        if not (tree.inputs[2 ** depth - 1:2 ** (depth + 1) - 1] >= 0).any():
            break
    return tree


def _grown(kept: RDD, size: int, bins: int, p: ForecastParams) -> list[Tree]:
    """All trees over blocks (uid, inputs as bins, label, made)."""
    trees: list[Tree] = []
    fresh: list[Tree] = []
    for number in range(p.trees):
        def histogram(tree, depth, columns):
            def sums(uid, inputs, label, made):
                drawn = _drawn(uid, number, p)
                x, slope = inputs[drawn].astype(np.int64), (made - label)[drawn]
                for t in fresh:
                    slope = slope + t.values[t.place(x, p.tree_depth)]
                return _sums(x, slope, tree, depth, columns, bins)

            return passes.total(kept, sums)

        fresh.append(grow(histogram, size, bins, number, p))
        trees.append(fresh[-1])
        if len(fresh) == KEPT and number + 1 < p.trees:
            def add(block, some=tuple(fresh)):
                uid, inputs, label, made = block
                x = inputs.astype(np.int64)
                return [uid, inputs, label, made + sum(t.values[t.place(x, p.tree_depth)] for t in some)]

            before, kept, fresh = kept, kept.map(add).persist(StorageLevel.MEMORY_AND_DISK), []
            kept.foreach(lambda _: None)
            before.unpersist()
    kept.unpersist()
    return trees


@dataclass(frozen=True)
class Boosted:
    base: float
    cuts: list
    trees: list
    depth: int

    def predict(self, inputs: np.ndarray) -> np.ndarray:
        bins = binned(inputs, self.cuts)
        out = np.full(len(inputs), self.base)
        for t in self.trees:
            out += t.values[t.place(bins, self.depth)]
        return out


def fit(train: DataFrame, size: int, p: ForecastParams, bins: int = BINS) -> Boosted | None:
    """Trees for rows (inputs: array of ``size`` numbers, label); None without rows."""
    name = f"boosting-{uuid.uuid4().hex[:12]}"
    rows = train.select("inputs", F.col("label").cast("double").alias("label"))
    rows = stage_table(rows.withColumn("uid", F.monotonically_increasing_id()), f"{name}/rows")
    base, count = rows.agg(F.avg("label"), F.count(F.lit(1))).first()
    if base is None:
        return None
    cuts = quantile_cuts(rows, size, bins)

    def code(batch):
        return batch.column("uid"), binned(_inputs(batch), cuts), batch.column("label"), np.full(batch.num_rows, base)

    kept = passes.blocks(rows, count, code, [("<i8", ()), ("<i2", (size,)), ("<f8", ()), ("<f8", ())])
    trees = _grown(kept, size, bins, p)
    return Boosted(base, cuts, trees, p.tree_depth)


def predicted(rows: DataFrame, model: Boosted | None) -> DataFrame:
    """``rows`` (with inputs) and their ``prediction``; NULL without a model."""
    packed = rows.select(F.struct(*[c for c in rows.columns if c != "inputs"]).alias("row"), "inputs")
    if model is None:
        return packed.select("row.*", F.lit(None).cast("double").alias("prediction"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.predict(_inputs(batch)))], ["row", "prediction"])

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, prediction double").select("row.*", "prediction")
