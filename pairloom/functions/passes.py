"""Fits of many passes: rows become numpy blocks that executors keep, a pass is one job over them.

As a DataFrame query a pass costs planning, a scan and two stages, whatever the rows, and a fit of
hundreds of passes is then mostly that. Here the rows are turned into blocks once, kept in memory
or on the executors' disks, and a pass adds up one vector of fixed size a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

#: Rows of a task: at least, while there are cores for more tasks, and at most.
LEAST_ROWS, MOST_ROWS = 2000, 1_000_000
#: Rows of a block.
BLOCK_ROWS = 2000
#: Vectors that the driver adds by itself; more are first added by tasks.
VECTORS = 64


def blocks(table: DataFrame, rows: int, columns: Callable, kinds: list[tuple]) -> RDD:
    """The rows of ``table`` (``rows`` in all) as kept lists of arrays.

    ``columns`` gives the arrays of a batch, ``kinds`` the number type and a row's shape of each.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))
    names = [f"c{i}" for i in range(len(kinds))]

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                values = columns(batch.slice(a, BLOCK_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary())
                                                  for v, (kind, _) in zip(values, kinds)], names)

    def arrays(row):
        return [np.frombuffer(v, kind).reshape(-1, *shape) for v, (kind, shape) in zip(row, kinds)]

    made = table.repartition(tasks).mapInArrow(cut, ", ".join(f"{n} binary" for n in names))
    return made.select(*map(F.col, names)).rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def total(kept: RDD, vector: Callable) -> np.ndarray:
    """The sum of ``vector(*block)`` over all blocks."""
    def run(mine):
        out = None
        for block in mine:
            made = vector(*block)
            out = made if out is None else out + made
        return [] if out is None else [out]

    return kept.mapPartitions(run).treeReduce(np.add, depth=1 if kept.getNumPartitions() <= VECTORS else 2)
