"""Token ids in wavelet-matrix shards: one compressed file for access, counting and lookup.

A shard holds the ids of consecutive documents. Bit plane ``k`` holds bit ``k`` of every id,
ordered stably by the bits above it; ``zeros`` of a plane is where its ones go on the next
one. Each plane is packed to bits, with the number of ones before each block of ``BLOCK`` bits,
so that rank and select touch one block per plane. Planes are compressed in pieces of ``PIECE``
bytes, each apart, and a reader inflates a piece when it first touches it: a lookup needs the
head of the file and a few pieces, whatever the shard's size.

Files are written by the tasks of a job into the shared folder through pyarrow's file systems
(local, HDFS, object stores), under names that a repeated task gives again, and moved into
place when complete: a lost executor leaves no half file. Rows are ordered by doc_id, nulls
first, then by text; a row is one document, repeated doc_ids included. Null text is empty and
gives the end id alone. An empty table gives no file. Other columns are left out.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.llm import common, tokens
from pairloom.session import stage_root

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 2048
#: Bytes of a plane that are compressed together.
PIECE = 1 << 16
SHARD_TOKENS = 4 << 20
MAGIC = b"PLWM0002"
HEAD = "<8sQQQHqq"
MANIFEST = "part int, shard int, path string, docs long, tokens long"


def count_ones(packed: np.ndarray) -> np.ndarray:
    """Ones of a plane's bytes before each block, and the total at the end."""
    whole = np.zeros(-(-max(8 * len(packed), 1) // BLOCK) * BLOCK // 8, np.uint8)
    whole[:len(packed)] = packed
    ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


class Plane:
    """Packed bits of a plane in compressed pieces, inflated when touched."""

    def __init__(self, pieces: list[bytes], size: int):
        self.pieces, self.size, self.open = pieces, size, {}

    def piece(self, k: int) -> np.ndarray:
        import zstandard

        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.pieces[k]), np.uint8)
        return self.open[k]

    def __getitem__(self, cut: slice) -> np.ndarray:
        start, stop = cut.start or 0, min(self.size, self.size if cut.stop is None else cut.stop)
        first, last = start // PIECE, max(start, stop - 1) // PIECE
        if first == last and first < len(self.pieces):
            return self.piece(first)[start - first * PIECE:stop - first * PIECE]
        parts = [self.piece(k) for k in range(first, min(last + 1, len(self.pieces)))]
        return np.concatenate([np.zeros(0, np.uint8), *parts])[start - first * PIECE:stop - first * PIECE]


class WaveletMatrix:
    """One shard: succinct planes, the documents' ids and their sizes."""

    def __init__(self, n, planes, zeros, ranks, doc_ids=(), null=(), sizes=(), part=0, shard=0):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.doc_ids, self.null, self.sizes = doc_ids, null, sizes
        self.part, self.shard = part, shard

    @property
    def levels(self) -> int:
        return len(self.planes)

    @classmethod
    def build(cls, ids, doc_ids=(), null=(), sizes=(), part=0, shard=0):
        """Planes by one stable partition a level, between two arrays that change places."""
        ids = np.asarray(ids)
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if levels <= 16 else np.uint32
        cur, spare = ids.astype(kind), np.empty(len(ids), kind)
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (cur & kind(1 << level)) != 0
            packed = np.packbits(bits, bitorder="little")
            ones = count_ones(packed)
            low = len(ids) - int(ones[-1])
            if level:
                np.compress(bits, cur, out=spare[low:])
                np.compress(~bits, cur, out=spare[:low])
                cur, spare = spare, cur
            planes.append(packed)
            ranks.append(ones)
            zeros.append(low)
        return cls(len(ids), planes, zeros, ranks, np.asarray(doc_ids, np.int64),
                   np.asarray(null, np.uint8), np.asarray(sizes, np.int64), part, shard)

    def to_bytes(self) -> bytes:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        blobs = [press(np.asarray(self.doc_ids, "<i8").tobytes()), press(np.asarray(self.null, "u1").tobytes()),
                 press(np.asarray(self.sizes, "<i8").tobytes())]
        for packed, ones in zip(self.planes, self.ranks):
            whole = packed[0:-(-self.n // 8)]
            blobs.append(press(ones.astype("<i8").tobytes()))
            blobs += [press(whole[a:a + PIECE].tobytes()) for a in range(0, len(whole), PIECE)]
        head = struct.pack(HEAD, MAGIC, self.n, len(self.doc_ids), len(blobs), self.levels, self.part, self.shard)
        table = np.array([*self.zeros, *map(len, blobs)], "<i8").tobytes()
        return b"".join([head, table, *blobs])

    @classmethod
    def from_bytes(cls, data: bytes):
        """A shard whose planes are still compressed; only the head and the counts are read."""
        import zstandard

        magic, n, n_docs, n_blobs, levels, part, shard = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(HEAD)
        table = np.frombuffer(data, "<i8", levels + n_blobs, at)
        at += table.nbytes
        inflate = zstandard.ZstdDecompressor().decompress
        ends = at + np.cumsum(table[levels:])
        view = memoryview(data)
        blobs = [view[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist())]
        size = -(-n // 8)
        each = 1 + -(-size // PIECE)
        planes = [Plane(blobs[3 + k * each + 1:3 + (k + 1) * each], size) for k in range(levels)]
        ranks = [np.frombuffer(inflate(blobs[3 + k * each]), "<i8") for k in range(levels)]
        return cls(n, planes, table[:levels].tolist(), ranks, np.frombuffer(inflate(blobs[0]), "<i8")[:n_docs],
                   np.frombuffer(inflate(blobs[1]), np.uint8), np.frombuffer(inflate(blobs[2]), "<i8"), part, shard)

    def bits(self, level: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else stop
        a = start // 8
        cut = np.unpackbits(self.planes[level][a:-(-stop // 8)], bitorder="little")
        return cut[start - 8 * a:stop - 8 * a]

    def rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block = i // BLOCK
        return int(self.ranks[level][block]) + int(self.bits(level, block * BLOCK, i).sum())

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for k in range(self.levels):
            bit = int(self.bits(k, i, i + 1)[0])
            ones = self.rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before position ``i``."""
        if token >> self.levels or not self.n:
            return 0
        a, b = 0, i
        for k in range(self.levels):
            ones_a, ones_b = self.rank1(k, a), self.rank1(k, b)
            if token >> (self.levels - 1 - k) & 1:
                a, b = self.zeros[k] + ones_a, self.zeros[k] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select_bit(self, level: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) such bit of a plane."""
        ones = self.ranks[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, j, side="right")) - 1
        cut = self.bits(level, block * BLOCK, min(self.n, (block + 1) * BLOCK))
        return block * BLOCK + int(np.flatnonzero(cut == bit)[j - int(before[block])])

    def select(self, token: int, j: int) -> int:
        """Position of the ``j``-th (from 0) occurrence of an id."""
        if not 0 <= j < self.count(token):
            raise IndexError("no such occurrence")
        a = 0
        for k in range(self.levels):
            ones = self.rank1(k, a)
            a = self.zeros[k] + ones if token >> (self.levels - 1 - k) & 1 else a - ones
        place = a + j
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            place = self.select_bit(k, bit, place - self.zeros[k] if bit else place)
        return place

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        out = np.empty(self.n, kind)
        for k in range(self.levels - 1, -1, -1):
            bits = self.bits(k).view(bool)
            cur[self.zeros[k]:] |= kind(1 << (self.levels - 1 - k))
            out[np.flatnonzero(bits)] = cur[self.zeros[k]:]
            out[np.flatnonzero(~bits)] = cur[:self.zeros[k]]
            cur, out = out, cur
        return cur


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme and host of the file system that Spark itself would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(root: str):
    from pyarrow import fs

    # Hadoop writes local paths as file:/..., which is a scheme without a host.
    return fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if re.match("file:/[^/]", root) else root)


def _write_file(root: str, name: str, data: bytes) -> str:
    store, folder = _store(root)
    attempt = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(data)
    store.move(attempt, f"{folder}/{name}")
    return f"{root}/{name}"


def write_shards(docs: DataFrame, root: str, vocabulary: str | None = None, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in doc_id order; one manifest row per file."""
    common.small_batches(docs.sparkSession)
    data = common.file_bytes(vocabulary or public_tokenizers.path(VOCABULARY))
    root = qualified(docs.sparkSession, root)
    store, folder = _store(root)
    store.create_dir(folder, recursive=True)

    def run(batches):
        encoder, part, shard = tokens.encoder(data), TaskContext.get().partitionId(), 0
        ids, doc_ids, null, sizes, held = [], [], [], [], 0

        def close():
            nonlocal ids, doc_ids, null, sizes, held, shard
            matrix = WaveletMatrix.build(np.concatenate(ids), doc_ids, null, np.concatenate(sizes), part, shard)
            path = _write_file(root, f"{part:06d}-{shard:06d}.plwm", matrix.to_bytes())
            row = (part, shard, path, len(doc_ids), matrix.n)
            ids, doc_ids, null, sizes, held, shard = [], [], [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "shard", "path", "docs", "tokens"])

        for batch in common.slices(batches, "text"):
            flat, each = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            with_end = each + 1
            out = np.full(len(flat) + len(each), end_id, np.uint32)
            out[common.spread(np.cumsum(with_end) - with_end, each)] = flat
            keys = batch.column("doc_id").to_pylist()
            ids.append(out)
            sizes.append(with_end)
            doc_ids += [0 if k is None else k for k in keys]
            null += [k is None for k in keys]
            held += len(out)
            if held >= shard_tokens:
                yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.stage(ordered.mapInArrow(run, MANIFEST), "token-shards")


def read_shards(spark: SparkSession, root: str, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens and its ids (binary, uint32).

    With ``digest`` the ids stay in the task that read them, and ids_crc32 tells about them.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.plwm").load(root).select("content"))

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                matrix = WaveletMatrix.from_bytes(content.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.sizes)
                starts = ends - matrix.sizes
                for a in range(0, len(ends), 2000):
                    b = min(a + 2000, len(ends))
                    blob = ids[starts[a]:ends[b - 1]].tobytes()
                    cuts = (np.concatenate([starts[a:b], ends[b - 1:b]]) - starts[a]) * 4
                    if digest:
                        view, ends_at = memoryview(blob), cuts.tolist()
                        value = pa.array([zlib.crc32(view[x:y]) for x, y in zip(ends_at, ends_at[1:])], pa.int64())
                    else:
                        value = pa.Array.from_buffers(pa.binary(), b - a, [
                            None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(blob)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(matrix.doc_ids[a:b], pa.int64(), mask=matrix.null[a:b].astype(bool)),
                        pa.array(np.full(b - a, matrix.part, np.int32)), pa.array(np.full(b - a, matrix.shard, np.int32)),
                        pa.array(starts[a:b]), pa.array(matrix.sizes[a:b]), value],
                        ["doc_id", "part", "shard", "inner", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    docs = files.mapInArrow(run, "doc_id long, part int, shard int, inner long, n_tokens long, "
                            + ("ids_crc32 long" if digest else "ids binary"))
    # Where each file starts: sums inside a writing task, then over one row per writing task.
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("part").agg(F.sum("tokens").alias("_sum"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_task"))
    begins = manifest.join(tasks, "part").select(
        "part", "shard", (F.col("_task") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("_begin"))
    return docs.join(begins, ["part", "shard"]).select(
        "doc_id", (F.col("_begin") + F.col("inner")).alias("start"), "n_tokens", name)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document written to shards and read back from them."""
    root = f"{stage_root(spark)}/llm/shards-{uuid.uuid4().hex[:12]}"
    manifest = write_shards(common.read_table(spark, sf_dir, "documents"), root)
    return read_shards(spark, root, manifest, digest=True)
