"""Byte-level BPE by the tiktoken library: whole texts to ids, and ids back to bytes.

A text longer than ``CUT`` characters is cut where a match of the split pattern always ends:
between a character that is no white space and a white-space character. Left of the cut no
match can go on, since no branch of the pattern puts white space after anything else, and the
look-ahead of the white-space branch only looks past white space. A stretch without such a
place (a long run of letters or of blanks) is split by the pattern itself with the regex
library, which has no stack limit, and each match goes to the library as one piece.

Null or empty text gives no ids; a null id list decodes to no bytes. Rows are independent:
repeated rows give repeated results, any other column stays as it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Characters after which a text is cut at the next safe place.
CUT = 50_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    """The encoding of one rank file."""

    def __init__(self, ranks: bytes, pattern: str, cut: int = CUT):
        import regex
        import tiktoken

        self.cut = cut
        self.encoding = tiktoken.Encoding(
            "pairloom", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        # Same white space as the library's engine, stated as characters.
        self.pattern = regex.compile(
            pattern.replace(r"[^\s", f"[^{common.SPACES}").replace(r"(?!\S)", f"(?![^{common.SPACES}])")
            .replace(r"\s", f"[{common.SPACES}]"))
        self.safe = re.compile(f"(?<=[^{common.SPACES}])(?=[{common.SPACES}])")
        self.unsure = re.compile(common.UNSURE)

    def chunks(self, text: str) -> Iterator[str]:
        """Parts that are encoded alone; their ids follow each other."""
        at = 0
        while len(text) - at > self.cut:
            place = self.safe.search(text, at + self.cut)
            if place is None:
                break
            yield text[at:place.start()]
            at = place.start()
        yield text[at:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.cut:
            return self.encoding.encode_ordinary(text)
        if self.unsure.search(text):
            return self.by_match(text)
        ids: list[int] = []
        for part in self.chunks(text):
            long = len(part) > 2 * self.cut
            ids += self.by_match(part) if long else self.encoding.encode_ordinary(part)
        return ids

    def by_match(self, text: str) -> list[int]:
        ids: list[int] = []
        for match in self.pattern.finditer(text):
            ids += self.encoding._encode_single_piece(match.group())
        return ids

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)


def _codec(ranks: bytes, pattern: str) -> Codec:
    cache = common.worker_cache("bpe")
    key = (hash(ranks), pattern)
    if key not in cache:
        cache[key] = Codec(ranks, pattern)
    return cache[key]


def encode(docs: DataFrame, ranks_path: str | None = None, text: str = "text",
           into: str = "ids") -> DataFrame:
    """``docs`` with ``text`` replaced by the list of its ids in ``into``; a column of that name goes."""
    common.small_batches(docs.sparkSession)
    ranks = common.file_bytes(ranks_path or public_tokenizers.path(RANKS))
    pattern = public_tokenizers.PATTERN
    rest = [c for c in docs.columns if c not in (text, into)]

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in common.slices(batches, text):
            ids = [np.asarray(codec.encode(t or ""), np.int32) for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], [*rest, into])

    schema = T.StructType([*(docs.schema[c] for c in rest),
                           T.StructField(into, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str | None = None, ids: str = "ids",
           into: str = "decoded") -> DataFrame:
    """``tokens`` with the raw bytes of its id lists in ``into``; a column of that name goes."""
    tokens = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c != into])
    ranks = common.file_bytes(ranks_path or public_tokenizers.path(RANKS))
    pattern = public_tokenizers.PATTERN

    def run(batches):
        codec = _codec(ranks, pattern)
        for batch in batches:
            lists = batch.column(ids)
            data = [b"" if x is None else codec.decode(x) for x in
                    (v.values.to_numpy().tolist() if v.is_valid else None for v in lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())],
                                             [*batch.schema.names, into])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema, T.StructField(into, T.BinaryType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
