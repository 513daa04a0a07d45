"""Ids of whole texts by the tokenizers library, each distinct piece encoded once.

The library takes several microseconds for a word, and most words return. A text is cut into
units (white space and what follows it up to the next white space); no match of the split
pattern crosses a unit's border, so the ids of a text are those of its units in order. A
worker remembers the ids of its units and asks the library only for new ones, many at once.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from pairloom.llm import common

#: Units and their characters that a worker remembers before it drops those seen once.
UNITS, UNIT_CHARS = 1_200_000, 48 << 20

#: Which bytes are white space by themselves.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: New units that go to the library as one text.
GROUP = 2000

#: Texts that go to the library at once: what it returns takes far more room than their ids.
BATCH = 8


class Texts:
    """Encoder of one tokenizer file."""

    def __init__(self, data: bytes, most: int = UNITS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size()
        # In the byte alphabet a token has one character for each byte.
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.units = re.compile(f"[{common.SPACES}]*[^{common.SPACES}]+|[{common.SPACES}]+")
        self.spaces = frozenset(filter(re.compile(f"[{common.SPACES}]").match, map(chr, range(0x3001))))
        self.unsure = re.compile(common.UNSURE)
        # Texts whose units are not found by the white space of ASCII alone.
        self.odd = re.compile(f"[{common.WIDE_SPACES}{common.UNSURE[1:-1]}]")
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Drop the units, but for those at the places ``keep``."""
        if keep is None:
            self.at: dict[str, int] = {}
            self.starts, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))
            self.ids = np.zeros(0, np.uint32)
        else:
            new = np.full(len(self.starts), -1)
            new[keep] = np.arange(len(keep))
            self.at = {u: n for u, n in zip(self.at, new.tolist()) if n >= 0}
            self.ids = self.ids[common.spread(self.starts[keep], self.sizes[keep])]
            self.sizes, self.used = self.sizes[keep], np.zeros(len(keep), np.int64)
            self.starts = np.cumsum(self.sizes) - self.sizes
        self.chars = sum(map(len, self.at))

    def make_room(self) -> None:
        """Past the bound, keep units that returned: most units of a language never do."""
        if len(self.at) > self.most or self.chars > UNIT_CHARS:
            keep = np.flatnonzero(self.used > 1)
            self.forget(keep if len(keep) <= self.most // 2 and self.chars <= UNIT_CHARS else None)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, set[str]]:
        """Distinct units, the unit at each place of the texts, how many each text has, and uncut texts.

        Units are slices of the texts' bytes, which Arrow tells apart: no string is made for a
        unit that returns within the batch.
        """
        blob = "".join(texts).encode("utf-8")
        sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        space = ASCII_SPACE[np.frombuffer(blob, np.uint8)]
        first = np.zeros(len(blob), bool)
        first[1:] = space[1:] & ~space[:-1]
        whole = set()
        for i, t in enumerate(texts):
            if self.odd.search(t):
                a, b = int(begins[i]), int(ends[i])
                first[a:b] = False
                if self.unsure.search(t):
                    whole.add(t)
                else:
                    lengths = [len(u.encode("utf-8")) for u in self.units.findall(t)]
                    first[a + np.cumsum(lengths)[:-1]] = True
        first[begins[sizes > 0]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(blob)).astype(np.int32)
        made = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).dictionary_encode()
        each = np.diff(np.searchsorted(starts, np.append(begins, len(blob))))
        return made.dictionary.to_numpy(zero_copy_only=False).tolist(), made.indices.to_numpy(), each, whole

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        self.make_room()
        units, at, each, whole = self.cut(texts)
        codes = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            self.learn(new, whole)
            codes[missing] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        self.used[codes] += np.bincount(at, minlength=len(codes))
        codes = codes[at]
        sizes = self.sizes[codes]
        ids = self.ids[common.spread(self.starts[codes], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(np.concatenate([[0], ends[np.cumsum(each)]]))

    def learn(self, units: list[str], whole: set[str]) -> None:
        """Encode new units, joined to longer texts wherever that leaves their borders.

        A unit that begins with white space and ends with something else can be joined, but for
        uncut texts (``whole``).
        """
        spaces = self.spaces
        alone = [u for u in units if u[0] not in spaces or u[-1] in spaces or u in whole]
        odd = set(alone)
        joined = [u for u in units if u not in odd] if odd else units
        units = [*joined, *alone]
        groups = ["".join(joined[i:i + GROUP]) for i in range(0, len(joined), GROUP)] + alone
        order = np.concatenate([
            np.asarray(e.ids, np.uint32) for i in range(0, len(groups), BATCH)
            for e in self.library.encode_batch_fast(groups[i:i + BATCH], add_special_tokens=False)])
        bytes_of = byte_lengths(units)
        ends = np.searchsorted(np.cumsum(self.width[order]), np.cumsum(bytes_of)) + 1
        sizes = np.diff(np.concatenate([[0], ends]))
        if int(ends[-1]) != len(order) or int(self.width[order].sum()) != int(bytes_of.sum()):
            raise ValueError("a unit's border lies inside a token")
        known = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int64)])
        self.ids = np.concatenate([self.ids, order])
        self.at.update(zip(units, range(known, known + len(units))))
        self.chars += sum(map(len, units))


def byte_lengths(units: list[str]) -> np.ndarray:
    """UTF-8 bytes of each unit."""
    places = np.flatnonzero(np.frombuffer("\0".join(units).encode("utf-8") + b"\0", np.uint8) == 0)
    if len(places) != len(units):  # a unit holds the separator
        return np.array([len(u.encode("utf-8")) for u in units], np.int64)
    return np.diff(np.concatenate([[-1], places])) - 1


def encoder(data: bytes, most: int = UNITS) -> Texts:
    cache = common.worker_cache("tokens")
    key = (hash(data), most)
    if key not in cache:
        cache[key] = Texts(data, most)
    return cache[key]
