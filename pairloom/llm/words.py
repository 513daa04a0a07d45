"""Words of texts as bytes: runs of 0-9, a-z and everything beyond ASCII, A-Z lower-cased.

Working on UTF-8 bytes lower-cases A-Z and nothing else, and every byte of a character beyond
ASCII lies above 0x7F, so a byte class says exactly what the pattern over characters says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

#: Bytes of a text whose words are held at once.
CHUNK = 1 << 20

#: The same words in DuckDB, of a column ``text``.
SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def chunks(data: bytes, most: int = CHUNK) -> Iterator[list[bytes]]:
    """Words of a text, in lists from about ``most`` bytes each; cuts lie between words."""
    at = 0
    while at < len(data):
        end = at + most
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield WORD.findall(data[at:end].lower())
        at = end


def words(data: bytes) -> list[bytes]:
    return WORD.findall(data.lower())


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return batch.column(column).fill_null("").cast(pa.binary()).to_pylist()


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
