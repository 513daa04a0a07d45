"""Packing documents into sequences by large-item matching and best fit.

A document is its ids and an end id. One longer than a sequence is cut into whole sequences
and a shorter first piece. Pieces above a third of a sequence fit at most twice in one: taken
from the longest, each is matched with the longest other one that fits. Shorter pieces, again
from the longest, go into the smallest gap that holds them, or open a sequence.

Only lengths matter, and there are at most ``size`` of them, so the plan is made from the
number of pieces of each length (a table of at most ``size`` rows on the driver, whatever the
input): it says which ranks of a length go to which run of sequences, at which offset. Pieces
get their rank within their length from counts per task, never in one task, and look their
place up. The plan grows with the number of lengths, not with the documents.

Null text is empty: one piece of the end id alone. Repeated rows and doc_ids are pieces of
their own. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm import common, tokens

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SIZE = 2048
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 19

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID,
           size: int = SIZE, units: int = tokens.UNITS) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their ids (binary, little-endian uint32).

    ``rank`` counts the pieces of a length within the task ``part`` that made them.
    """
    common.small_batches(docs.sparkSession)
    data = common.file_bytes(vocabulary or public_tokenizers.path(VOCABULARY))

    def run(batches):
        encoder, part = tokens.encoder(data, units), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            flat, each = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            total = each + 1
            ends = np.cumsum(total)
            ids = np.full(int(ends[-1]), end_id, "<u4")
            ids[common.spread(ends - total, each)] = flat
            n = -(-total // size)
            of = np.repeat(np.arange(len(n)), n)
            piece = common.spread(np.zeros(len(n), np.int64), n)
            first = total - (n - 1) * size
            length = np.where(piece == 0, first[of], size)
            start = np.where(piece == 0, 0, first[of] + (piece - 1) * size)
            # Rank of each piece among those of its length, in order of appearance.
            order = np.argsort(length, kind="stable")
            kinds, at, count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(at, count) + np.repeat(seen[kinds], count)
            seen[kinds] += count
            cuts = (np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length), pa.Array.from_buffers(
                    pa.binary(), len(of), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())]),
                pa.array(np.full(len(of), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset): the ranks of a length from one run's
    first up to the next one's go to consecutive sequences, each at that offset.
    """
    left = {n: c for n, c in counts.items() if c}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps = 0  # bit g: some sequence has a gap of g
    sequences = 0

    def place(length: int, first: int, bins: int, offset: int) -> None:
        runs.append((length, taken[length], first, offset))
        taken[length] += bins
        left[length] -= bins

    def leave(gap: int, first: int, bins: int) -> None:
        nonlocal open_gaps
        if gap:
            gaps[gap].append((first, bins))
            open_gaps |= 1 << gap

    large = sorted((n for n in left if 3 * n > size), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if left[n] and n <= size - a and (n != a or left[n] > 1)), None)
            bins = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            first, sequences = sequences, sequences + bins
            place(a, first, bins, 0)
            if b is not None:
                place(b, first, bins, a)
            leave(size - a - (b or 0), first, bins)

    for s in sorted((n for n in left if 3 * n <= size), reverse=True):
        while left[s]:
            fit = open_gaps >> s
            if not fit:
                each = size // s
                bins = max(1, left[s] // each)
                leave(size, sequences, bins)
                sequences += bins
                continue
            gap = s + (fit & -fit).bit_length() - 1
            first, bins = gaps[gap].pop()
            each = min(gap // s, left[s])
            use = min(bins, left[s] // each)
            for k in range(each):
                place(s, first, use, size - gap + k * s)
            if bins > use:
                gaps[gap].append((first + use, bins - use))
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
            leave(gap - each * s, first, use)
    return runs


def assign(staged: DataFrame, size: int = SIZE) -> DataFrame:
    """``staged`` pieces (length, part, rank; written once) with sequence_id and offset."""
    per_task = staged.groupBy("length", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    counts = {r["length"]: r["n"] for r in
              staged.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    runs = np.array(sorted(plan(counts, size)) or np.zeros((0, 4)), np.int64)
    # A key in order of (length, rank), since ranks stay below 2^48.
    keys = (runs[:, 0] << 48) + runs[:, 1]
    rest = [c for c in staged.columns if c not in ("part", "rank")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy() + batch.column("_base").to_numpy()
            key = (batch.column("length").to_numpy() << 48) + rank
            found = runs[np.searchsorted(keys, key, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])],
                [*rest, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema if f.name in rest)
    placed = staged.join(base, ["length", "part"]).select(*staged.columns, "_base")
    return placed.mapInArrow(run, f"{schema}, sequence_id long, `offset` long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: pieces' ids joined in order of offset (at most ``size`` ids)."""
    return placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("_p")).select(
        "sequence_id", F.concat(F.lit(b""), F.aggregate(
            "_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"),
        F.transform("_p", lambda x: x["doc_id"]).alias("doc_ids"))


def pack(docs: DataFrame, size: int = SIZE, units: int = tokens.UNITS) -> DataFrame:
    """Where each piece of each document goes, with a checksum of its ids.

    ``units``: what a worker remembers of the encoder's work (speed against memory).
    """
    made = pieces(docs, size=size, units=units).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(common.stage(made, "pieces"), size)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"))
