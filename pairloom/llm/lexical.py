"""Ranked lexical search of many items at once, with the sums that items share made once.

Items are searched in blocks of about ``PAIRS`` pairs of item and term, dealt by hash; a block
costs one pass over the documents. That pass turns each text into its number of terms and, for
the block's terms only, their occurrences (``postings``, one row per document, written once).
Counts over that table give N, L and df, so the weights; they cover every document.

An item's score is a sum of one number per document and term. The block's plan (``share``) is
mined for sets of terms that several items hold: the pair of terms, or of sets found before, that
most items still need becomes a set of its own, until no pair is in two items. The sets form a
graph in which each is the sum of two earlier ones and every item the sum of what it has left. A
task fills a matrix of term numbers over some documents, adds up each shared set's row once, then
each item's rows from the graph, so a set costs one addition however many items use it.

A task keeps ``top`` candidates per item, documents tied with the last one included until their
doc_ids decide; one window over those, a few rows per task and item, gives the ranks. Only
documents without a term of an item are missing from its list; nothing else is left out.

Null text has no term: such a document is never found (it does not count in N), such an item has
no rows. Every row of items is an item: rows with the same id rank apart, each from 1. Repeated
documents are found each; equal scores go by doc_id, null last. Empty tables give no rows. Terms
are equal bytes. Other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm import common
from pairloom.llm.words import SQL_WORDS, chunks, text_column, texts_of, words

TOP = 10
#: Pairs of item and term that are searched in one pass.
PAIRS = 100_000
#: Numbers of a task's matrix.
CELLS = 4 << 20
#: Terms of an item among which pairs are mined at a time (items of more are cut, commonest terms first).
MINED = 128


def terms_of(items: DataFrame, n_blocks: int = 1) -> DataFrame:
    """Rows (_item, item_id, _block, _term, _count) of the items' terms."""
    def run(batches):
        for batch in common.slices(batches, "_text"):
            columns = [[], [], [], []]
            for key, item, data in zip(batch.column("_item").to_pylist(), batch.column("item_id").to_pylist(),
                                       texts_of(batch, "_text")):
                counts: dict[bytes, int] = defaultdict(int)
                for w in words(data):
                    counts[w] += 1
                for column, values in zip(columns, ([key] * len(counts), [item] * len(counts), counts, counts.values())):
                    column += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                ["_item", "item_id", "_term", "_count"])

    rows = items.select(F.monotonically_increasing_id().alias("_item"), F.col("item_id").cast("long").alias("item_id"),
                        text_column().alias("_text"))
    return rows.mapInArrow(run, "_item long, item_id long, _term binary, _count long")


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text), codes (of ``terms`` in it) and counts, for texts with a term."""
    code = {t: k for k, t in enumerate(terms)}
    width = max(1, len(terms))

    def run(batches):
        for batch in common.slices(batches, "_text"):
            sizes, hits = [], []
            for k, data in enumerate(texts_of(batch, "_text")):
                n = 0
                for found in chunks(data):
                    n += len(found)
                    known = np.array([c for c in map(code.get, found) if c is not None], np.int64)
                    hits.append(known + k * width)
                sizes.append(n)
            both, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *hits]), return_counts=True)
            ends = pa.array(np.searchsorted(both, np.arange(len(sizes) + 1) * width), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(both % width, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], ["doc_id", "n", "codes", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n long, codes array<int>, counts array<long>").filter("n > 0")


class Plan:
    """Sums of symbols: symbol k is the k-th leaf, or the sum of the two earlier symbols ``sums`` names."""

    def __init__(self, leaves: list, sums: list[tuple[int, int]], items: list[list[int]]):
        self.leaves, self.sums, self.items = leaves, sums, items

    @property
    def additions(self) -> int:
        return len(self.sums) + sum(len(x) - 1 for x in self.items)

    def evaluate(self, leaf_rows: np.ndarray) -> np.ndarray:
        """One row for each item, from one row for each leaf."""
        rows = np.empty((len(self.leaves) + len(self.sums), leaf_rows.shape[1]), leaf_rows.dtype)
        rows[:len(self.leaves)] = leaf_rows
        for k, (a, b) in enumerate(self.sums, len(self.leaves)):
            np.add(rows[a], rows[b], out=rows[k])
        return np.stack([rows[x].sum(axis=0) for x in self.items]) if self.items else rows[:0]


def share(items: list[list]) -> Plan:
    """A plan for sums over hashable leaves, each item's without repeats; the commonest pair goes first."""
    holders: dict = defaultdict(set)
    for k, item in enumerate(items):
        for leaf in item:
            holders[leaf].add(k)
    leaves = sorted(holders, key=lambda x: (-len(holders[x]), x))
    number = {leaf: n for n, leaf in enumerate(leaves)}
    left = [sorted(number[x] for x in item) for item in items]
    at = [holders[x] for x in leaves]
    # A part is what pairs are mined within: neighbours in the common order.
    inside = [{s: r // MINED for r, s in enumerate(x)} for x in left]
    count: dict[tuple[int, int], int] = defaultdict(int)
    for part in inside:
        held = [s for s in part if len(at[s]) > 1]
        for i, a in enumerate(held):
            for b in held[i + 1:]:
                if part[a] != part[b]:
                    break
                count[a, b] += 1
    heap = [(-n, a, b) for (a, b), n in count.items() if n > 1]
    heapq.heapify(heap)
    del count
    sums: list[tuple[int, int]] = []
    while heap:
        n, a, b = heapq.heappop(heap)
        both = {k for k in at[a] & at[b] if inside[k][a] == inside[k][b]}
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), a, b))
            continue
        new = len(at)
        sums.append((a, b))
        at.append(both)
        at[a] -= both
        at[b] -= both
        near: dict[int, int] = defaultdict(int)
        for k in both:
            part = inside[k]
            part[new] = part.pop(a)
            part.pop(b)
            for s, p in part.items():
                if p == part[new] and s != new and len(at[s]) > 1:
                    near[s] += 1
        for s, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, s, new))
    return Plan(leaves, sums, [sorted(x) for x in inside])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Top:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[item, at]])
        self.doc = np.concatenate([self.doc, doc[at]])
        self.null = np.concatenate([self.null, null[at]])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        begin = np.searchsorted(self.item[order], self.item[order])
        order = order[np.arange(len(order)) - begin < self.top]
        self.item, self.score, self.doc, self.null = (x[order] for x in (self.item, self.score, self.doc, self.null))
        sizes = np.bincount(self.item, minlength=len(self.least))
        full = np.flatnonzero(sizes == self.top)
        self.least[full] = self.score[np.cumsum(sizes)[full] - 1]


def candidates(table: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Rows (_at: the item's number in the plan, doc_id, score): a task's best documents of each item."""
    code = np.array([c for c, _ in plan.leaves], np.int64)
    times = np.array([m for _, m in plan.leaves], np.int64)
    rows_of = np.argsort(code, kind="stable")
    first = np.searchsorted(code[rows_of], np.arange(len(weights) + 1))
    step = max(16, CELLS // max(1, len(plan.leaves) + len(plan.sums)))

    def run(batches):
        best = Top(len(plan.items), top)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                size = np.diff(np.concatenate([[0], np.cumsum(part.column("codes").value_lengths().to_numpy())]))
                doc = np.repeat(np.arange(part.num_rows), size)
                term = part.column("codes").flatten().to_numpy().astype(np.int64)
                count = part.column("counts").flatten().to_numpy()
                m = 25 + 75 * part.column("n").to_numpy() * n_docs // n_terms
                value = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m[doc]))
                each = first[term + 1] - first[term]
                row = rows_of[common.spread(first[term], each)]
                leaf = np.zeros((len(code), part.num_rows), np.int64)
                leaf[row, np.repeat(doc, each)] = np.repeat(value, each) * times[row]
                ids = part.column("doc_id")
                best.add(plan.evaluate(leaf), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.null.astype(bool)),
             pa.array(best.score)], ["_at", "doc_id", "score"])

    return table.mapInArrow(run, "_at int, doc_id long, score long")


def _search(docs: DataFrame, found: pa.Table, top: int) -> DataFrame | None:
    """Results of one block of items, given its rows of ``terms_of``."""
    of_item: dict[int, dict[bytes, int]] = defaultdict(dict)
    ids = {}
    for item, item_id, term, count in zip(*(found.column(c).to_pylist() for c in ("_item", "item_id", "_term", "_count"))):
        of_item[item][term] = count
        ids[item] = item_id
    if not of_item:
        return None
    keys = sorted(of_item)
    terms = sorted({t for x in of_item.values() for t in x})
    code = {t: k for k, t in enumerate(terms)}
    table = common.stage(postings(docs, terms), "postings")
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    counts = table.select(F.explode("codes").alias("c")).groupBy("c").count().toArrow()
    df[counts.column("c").to_numpy()] = counts.column("count").to_numpy()
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    plan = share([[(code[t], m) for t, m in of_item[key].items()] for key in keys])
    schema = "_at int, _item long, item_id long"
    names = docs.sparkSession.createDataFrame([(k, key, ids[key]) for k, key in enumerate(keys)], schema)
    # A block's items are bounded, and so is this table.
    return candidates(table, plan, weights, n_docs, max(1, n_terms), top).join(F.broadcast(names), "_at").drop("_at")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    common.small_batches(docs.sparkSession)
    table = common.stage(terms_of(items), "item-terms")
    n = max(1, math.ceil(table.count() / pairs))
    block = F.pmod(F.xxhash64("_item"), F.lit(n))
    parts = [_search(docs, table.filter(block == k).toArrow(), top) for k in range(n)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH t AS MATERIALIZED (SELECT uid, doc_id, term, count(*) AS tf FROM (
  SELECT uid, doc_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS uid, doc_id, {SQL_WORDS} AS w FROM documents))
  GROUP BY ALL),
d AS MATERIALIZED (SELECT uid, sum(tf)::BIGINT AS n FROM t GROUP BY uid),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
q AS MATERIALIZED (SELECT item, item_id, term, count(*) AS times FROM (
  SELECT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {SQL_WORDS} AS w FROM benchmark))
  GROUP BY ALL),
k AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term), c),
s AS (SELECT item, item_id, uid, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN k USING (term) JOIN t USING (term) JOIN d USING (uid), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
