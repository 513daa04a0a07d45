"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.session import remove_folder, stage_root

#: Characters of Unicode White_Space (fixed values). Each match of the split pattern ends
#: between another character and one of these.
WIDE_SPACES = "\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = "\\t-\\r\\x20" + WIDE_SPACES

#: Characters that libraries disagree about; a text holding one is not cut.
UNSURE = "[\\x1c-\\x1f\\u180e\\u200b\\u2060\\ufeff]"

#: Rows of a batch on its way to Python.
BATCH_ROWS = 1000

#: Bytes of text that a Python worker holds decoded at a time.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    Each call has a folder of its own, so two runs never overwrite each other's files.
    """
    path = f"{stage_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(table: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
        remove_folder(table.sparkSession, folder)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``BATCH_ROWS`` rows, unless the session says otherwise.

    The default of 10,000 rows makes batches of tens of MB, held on both sides of every task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def file_bytes(path: str) -> bytes:
    """A vocabulary file (a few MB at most), read by the driver and sent with the task."""
    return Path(path).read_bytes()


def worker_cache(owner: str) -> dict:
    """A dictionary that lives across the tasks of a Python worker, until another owner asks.

    Workers are reused by later stages, so what one operator remembers goes when the next
    one starts, and what is free after it goes back to the system.
    """
    module = sys.modules.setdefault("_pairloom_worker", types.ModuleType("_pairloom_worker"))
    if module.__dict__.get("owner") != owner:
        module.owner, module.cache = owner, {}
        gc.collect()
        give_back()
    return module.cache


def give_back() -> None:
    """Free memory of this process goes back to the system, that of Arrow and of C libraries too.

    An idle worker would keep what its largest batch needed beside the executor's own memory.
    """
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str,
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of ``column``, or one row.

    After the last one the task's free memory goes back to the system.
    """
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of many runs one after the other: start, start + 1, ... for each run."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def pack_row(docs: DataFrame, name: str = "_row") -> Column:
    """All columns of a table as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)
