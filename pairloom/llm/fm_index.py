"""Benchmark decontamination with an FM-index over the words of each training shard.

A shard is the text of consecutive documents as word codes, a separator after each document. Its
suffixes are sorted (prefix doubling over those still tied; the separators differ, so copies tie
no further than their own end). The Burrows-Wheeler transform lies in a wavelet matrix of bit
planes with ones counted before every 64 bits, and every ``SAMPLE``-th position of the text, and
each document's first, is kept with the place of its suffix. A shard is one row of a table, so an
index is built once and asked for many benchmarks.

An item's windows are all runs of ``WINDOW`` of its words (its whole text where it has fewer).
All windows of a block are searched backward at once: each step narrows every interval by two
ranks. The places of what is left are walked back to a sampled position. Occurrences become
cover counts over the shard, whose positive runs are the merged removal spans.

Pairs of window and item are dealt by hash into blocks of about ``PAIRS``; each block is searched
in one pass over the index, so what is sent to the tasks is bounded whatever the benchmark. A
document longer than ``SHARD`` words is cut into parts that overlap by a window less one word, so
no occurrence is lost and memory stays bounded; its spans are merged by document afterwards.

Null text has no words: its row has zeros and no items. A null or wordless item has no window.
Items are told apart by item_id: repeated rows of an id count once; a null id counts as one item
and is written as an empty string. Repeated documents each have their row. Equal words are equal
bytes (nothing is hashed). An empty table of documents gives no rows, an empty benchmark zeros.
Other columns are left out (``clean`` keeps those of the documents).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import common
from pairloom.llm.words import SQL_WORDS, chunks, text_column, texts_of, words

WINDOW = 10
#: Words of a shard.
SHARD = 1 << 20
#: Every so many-th position of a shard's text is kept.
SAMPLE = 16
#: Pairs of window and item that are searched in one pass.
PAIRS = 50_000

INDEX = ("levels int, size long, planes binary, words binary, marks binary, places binary, uid array<long>, "
         "doc_id array<long>, part array<long>, parts array<long>, n_words array<long>, own array<long>")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; symbol 0 is a separator and the first one is the smallest, and so on.

    The last symbol is a separator.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + (len(ends) - 1)
    rank[ends] = np.arange(len(ends))
    bits = max(1, int(rank.max()).bit_length())
    step = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(step):
        key <<= bits
        key[:n - j] |= rank[j:]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(at):
        suffix = order[at]
        key = rank[suffix] * n + rank[np.minimum(suffix + step, n - 1)]
        sort = np.argsort(key)
        suffix, key = suffix[sort], key[sort]
        order[at] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return order


class Ranks:
    """A bit vector with the ones before each 64 bits counted."""

    def __init__(self, packed: np.ndarray):
        self.bits = packed
        ones = np.bitwise_count(packed)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        whole[:len(packed)] = packed
        return whole.view(np.uint64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.bits[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Shard:
    """An FM-index over word codes: backward search and locating, many at a time."""

    def __init__(self, levels: int, size: int, planes: np.ndarray, marks: np.ndarray, places: np.ndarray):
        self.levels, self.size = levels, size
        self.planes = [Ranks(p) for p in planes.reshape(levels, -1)]
        self.zeros = [size - int(p.before[-1]) for p in self.planes]
        self.marks, self.places = Ranks(marks), places
        # Where each code's block begins in the order below the last plane, and in the suffix order.
        self.first = self._blocks()

    @classmethod
    def build(cls, symbols: np.ndarray, sample: int = SAMPLE) -> "Shard":
        n = len(symbols)
        order = suffix_array(symbols)
        cur = symbols[order - 1].astype(np.uint32)
        levels = max(1, int(symbols.max()).bit_length())
        planes = []
        for level in range(levels - 1, -1, -1):
            bits = (cur >> np.uint32(level) & np.uint32(1)).astype(bool)
            planes.append(Ranks.pack(bits))
            cur = np.concatenate([cur[~bits], cur[bits]])
        kept = np.zeros(n, bool)
        kept[::sample] = True
        kept[1:] |= symbols[:-1] == 0
        held = kept[order]
        return cls(levels, n, np.concatenate(planes), Ranks.pack(held), order[held].astype(np.int32))

    def _blocks(self) -> np.ndarray:
        """For all codes, where their symbols begin below the last plane."""
        a = np.zeros(1, np.int64)
        b = np.full(1, self.size, np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            ones_a, ones_b = plane.ones(a), plane.ones(b)
            a = np.stack([a - ones_a, zeros + ones_a], 1).reshape(-1)
            b = np.stack([b - ones_b, zeros + ones_b], 1).reshape(-1)
        self.starts = np.concatenate([[0], np.cumsum(b - a)])[:-1]
        return a

    def back(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Suffixes that begin with the code and go on with one of the first ``i`` suffixes, and all smaller ones."""
        place = i
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.ones(place)
            bit = (code >> (self.levels - 1 - k) & 1).astype(bool)
            place = np.where(bit, zeros + ones, place - ones)
        return self.starts[code] + place - self.first[code]

    def search(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that begin with each row of ``codes`` (its first ``sizes`` entries); -1 is unknown."""
        low = np.zeros(len(codes), np.int64)
        high = np.full(len(codes), self.size, np.int64)
        column = np.arange(codes.shape[1])
        high[((codes < 0) & (column < sizes[:, None])).any(axis=1)] = 0
        for j in range(1, codes.shape[1] + 1):
            go = np.flatnonzero((sizes >= j) & (low < high))
            if not len(go):
                break
            code = codes[go, sizes[go] - j]
            both = self.back(np.concatenate([code, code]), np.concatenate([low[go], high[go]]))
            low[go], high[go] = both[:len(go)], both[len(go):]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places of the order."""
        out = np.full(len(rows), -1, np.int64)
        where, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(rows):
            held = self.marks.at(rows)
            out[where[held]] = self.places[self.marks.ones(rows[held])] + steps
            where, rows = where[~held], rows[~held]
            if len(rows):
                code, place = np.zeros(len(rows), np.int64), rows
                for plane, zeros in zip(self.planes, self.zeros):
                    bit, ones = plane.at(place), plane.ones(place)
                    place = np.where(bit, zeros + ones, place - ones)
                    code = code << 1 | bit
                rows = self.starts[code] + place - self.first[code]
            steps += 1
        return out


def build(docs: DataFrame, shard: int = SHARD, window: int = WINDOW, sample: int = SAMPLE) -> DataFrame:
    """Index rows of ``docs`` (doc_id, text); the same row may lie in several shards, in parts."""
    def run(batches):
        task, count = TaskContext.get().partitionId() << 33, 0
        codes: dict[bytes, int] = {}
        symbols: list[np.ndarray] = []
        docs: list[tuple] = []
        held = 0

        def close():
            nonlocal codes, symbols, docs, held
            made = Shard.build(np.concatenate(symbols), sample)
            columns = list(zip(*docs))
            row = [pa.array([made.levels], pa.int32()), pa.array([made.size], pa.int64()),
                   *(pa.array([b], pa.binary()) for b in (
                       np.concatenate([p.bits for p in made.planes]).tobytes(), b" ".join(codes),
                       made.marks.bits.tobytes(), made.places.tobytes())),
                   *(pa.array([c], pa.list_(pa.int64())) for c in columns)]
            codes, symbols, docs, held = {}, [], [], 0
            return pa.RecordBatch.from_arrays(row, [x.split()[0] for x in INDEX.split(", ")])

        def coded(found):
            at = codes.setdefault
            return np.fromiter((at(w, len(codes) + 1) for w in found), np.uint32, len(found))

        def parts(data):
            """Code arrays of at most ``shard`` words, each but the first repeating the words before it."""
            rest = []
            size = 0
            for found in chunks(data):
                rest.append(found)
                size += len(found)
                while size > shard:
                    flat = [w for some in rest for w in some]
                    yield flat[:shard]
                    rest = [flat[shard - window + 1:]]
                    size = len(rest[0])
            yield rest[0] if len(rest) == 1 else [w for some in rest for w in some]

        for batch in common.slices(batches, "_text"):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "_text")):
                start = at = 0
                for k, found in enumerate(parts(data)):
                    if held and held + len(found) > shard:
                        yield close()
                    symbols += [coded(found), np.zeros(1, np.uint32)]
                    own = len(found) - (window - 1 if k else 0)
                    docs.append((task + count, doc_id, k, at, len(found), own))
                    at = at + len(found) - window + 1
                    held += len(found) + 1
                count += 1
        if docs:
            yield close()

    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("_text"))
    return common.stage(rows.mapInArrow(run, INDEX), "fm-index")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct rows (_words: words of a window joined by blanks, _item: the item's id as text)."""
    def run(batches):
        for batch in common.slices(batches, "_text"):
            out, ids = [], []
            for item, data in zip(batch.column("_item").to_pylist(), texts_of(batch, "_text")):
                found = words(data)
                made = {b" ".join(found[i:i + window]) for i in range(max(1, len(found) - window + 1))} if found else ()
                out += made
                ids += [item] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.string())], ["_words", "_item"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("_item"), text_column().alias("_text"))
    return rows.mapInArrow(run, "_words binary, _item string").distinct()


class Block:
    """Windows of one pass: word tables for a search, and the items of each window."""

    def __init__(self, pairs: pa.Table, window: int):
        texts, of = np.unique(np.array(pairs.column("_words").to_pylist(), object), return_inverse=True)
        self.items, item = np.unique(np.array(pairs.column("_item").to_pylist(), object), return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.item_of, self.item_at = item[order], np.searchsorted(of[order], np.arange(len(texts) + 1))
        cut = [t.split(b" ") for t in texts]
        self.sizes = np.array([len(c) for c in cut], np.int64)
        names: dict[bytes, int] = {}
        self.grid = np.full((len(cut), max([1, *self.sizes])), -1, np.int64)
        for k, c in enumerate(cut):
            self.grid[k, :len(c)] = [names.setdefault(w, len(names)) for w in c]
        self.names = list(names)

    def codes(self, dictionary: dict[bytes, int]) -> np.ndarray:
        known = np.array([*(dictionary.get(w, -1) for w in self.names), -1], np.int64)
        return known[self.grid]


FOUND = ("uid long, doc_id long, n_words long, part long, whole boolean, spans array<struct<start: long, stop: long>>, "
         "items array<string>")


def _found(row: dict, block: Block) -> pa.RecordBatch:
    """What a block's windows hit in one shard: a row for each document in it."""
    levels, size = row["levels"], row["size"]
    shard = Shard(levels, size, *(np.frombuffer(row[c], t) for c, t in (
        ("planes", np.uint64), ("marks", np.uint64), ("places", np.int32))))
    texts = row["words"].split(b" ") if row["words"] else []
    low, high = shard.search(block.codes(dict(zip(texts, range(1, len(texts) + 1)))), block.sizes)
    counts = high - low
    hit = np.flatnonzero(counts)
    window = np.repeat(hit, counts[hit])
    place = shard.locate(common.spread(low[hit], counts[hit]))

    inside = np.array(row["n_words"], np.int64)
    begin = np.cumsum(inside + 1) - inside - 1
    doc = np.searchsorted(begin, place, side="right") - 1
    cover = np.bincount(place, minlength=size + 1) - np.bincount(place + block.sizes[window], minlength=size + 1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(begin, starts, side="right") - 1
    shift = np.array(row["parts"], np.int64)[of] - begin[of]
    spans = pa.StructArray.from_arrays([pa.array(starts + shift), pa.array(stops + shift)], ["start", "stop"])
    docs = np.arange(len(inside) + 1)

    seen = np.unique(doc * len(block.sizes) + window)
    doc, window = seen // max(1, len(block.sizes)), seen % max(1, len(block.sizes))
    each = block.item_at[window + 1] - block.item_at[window]
    item = block.item_of[common.spread(block.item_at[window], each)]
    both = np.unique(np.repeat(doc, each) * len(block.items) + item)
    of_item, item = both // max(1, len(block.items)), both % max(1, len(block.items))
    names = pa.array(block.items, pa.string()).take(pa.array(item))

    uid, part = np.array(row["uid"], np.int64), np.array(row["part"], np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(uid), pa.array(row["doc_id"], pa.int64()), pa.array(np.array(row["own"], np.int64)), pa.array(part),
        pa.array(np.zeros(len(uid), bool)),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(of, docs), pa.int32()), spans),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(of_item, docs), pa.int32()), names)],
        [x.split()[0] for x in ("uid ", "doc_id ", "n_words ", "part ", "whole ", "spans ", "items ")])


def search(index: DataFrame, block: Block) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pydict()
                yield _found({c: v[0] for c, v in row.items()}, block)

    return index.mapInArrow(run, FOUND)


def blocks_of(items: DataFrame, window: int = WINDOW, pairs: int = PAIRS) -> list:
    """Readers of the blocks of a benchmark's windows (one without windows where there are none)."""
    table = common.stage(windows_of(items, window), "fm-windows")
    n = max(1, math.ceil(table.count() / pairs))
    at = F.pmod(F.xxhash64("_words", "_item"), F.lit(n))
    return [lambda k=k: Block(table.filter(at == k).toArrow(), window) for k in range(n)]


def _merged(spans):
    """Sorted spans with those that meet put together."""
    ordered = F.array_sort(spans)
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= span["start"]), longer).otherwise(
            F.concat(done, F.array(span)))

    return F.aggregate(ordered, empty, add)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard: int = SHARD, sample: int = SAMPLE,
                  pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_words, spans (merged, in words from 0) and items (their ids as sorted text) of every document."""
    index = build(docs, shard, window, sample)
    found = None
    for k, read in enumerate(blocks_of(items, window, pairs)):
        part = search(index, read()).withColumn("block", F.lit(k))
        found = part if found is None else found.unionByName(part)
    found = common.stage(found, "fm-found")
    several = found.filter("block > 0 OR part > 0").select("uid").distinct()
    if several.isEmpty():
        out = found.select("doc_id", "n_words", "spans", "items")
    else:
        # Only documents of several parts or blocks meet again; a group has a row for each of those.
        own = F.when(F.col("block") == 0, F.col("n_words")).otherwise(0)
        many = found.join(several, "uid").groupBy("uid").agg(
            F.first("doc_id").alias("doc_id"), F.sum(own).alias("n_words"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("uid")
        out = found.join(several, "uid", "left_anti").select("doc_id", "n_words", "spans", "items").unionByName(many)
    return out.withColumn("items", F.array_sort("items"))


def clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs``, its columns unchanged, without the words of all removal spans.

    A span goes from its first word's first byte to its last word's last; what stands around it
    stays. Rows are told apart by doc_id and text; equal rows have equal spans.
    """
    import re

    from pairloom.llm.words import WORD

    mark = F.sha2(text_column(), 256)
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("d"), mark.alias("t")).alias("_k"), "text")
    # The index knows doc_ids only: number the distinct rows, and look their texts up by that number.
    rows = common.stage(keyed.dropDuplicates(["_k"]).withColumn("doc_id", F.monotonically_increasing_id()), "fm-rows")
    spans = contamination(rows, items, **settings).filter(F.size("spans") > 0).select("doc_id", "spans")
    cuts = common.stage(rows.join(spans, "doc_id").select("_k", "spans"), "fm-cuts")

    def run(batches):
        for batch in batches:
            out = []
            for data, cut in zip(texts_of(batch, "_text"), batch.column("_spans").to_pylist()):
                lower = data.lower()
                ends = [m.span() for m in re.finditer(WORD, lower)]
                at, kept = 0, []
                for s in cut or ():
                    kept.append(data[at:ends[s["start"]][0]])
                    at = ends[s["stop"] - 1][1]
                out.append(b"".join([*kept, data[at:]]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    packed = docs.select(common.pack_row(docs), F.struct(F.col("doc_id").cast("long").alias("d"), mark.alias("t")).alias("_k"))
    joined = packed.join(cuts, "_k", "left")
    dirty = joined.filter("spans IS NOT NULL").select(
        "_row", F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("_text"), F.col("spans").alias("_spans"))
    kind = packed.schema["_row"].dataType.simpleString()
    cleaned = dirty.mapInArrow(run, f"_row {kind}, _text string").select(
        *[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
    return joined.filter("spans IS NULL").select("_row.*").unionByName(cleaned)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SQL_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
  SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i
  FROM b WHERE len(w) > 0)),
o AS MATERIALIZED (SELECT uid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
  SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT uid, i, k, item FROM o JOIN p USING (s, k)),
h AS (SELECT uid, count(DISTINCT j) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS j FROM f) GROUP BY uid),
t AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT uid, item FROM f) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN t USING (uid)
"""
