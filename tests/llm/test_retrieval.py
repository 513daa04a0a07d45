"""Decontamination, lexical search and whitening against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import fm_index, lexical, whitening, words


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_words_are_those_of_the_pattern():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("aZ09 _\x00\n\x7f-ÄßİK日 '@[") for _ in range(draw.randrange(60)))
        want = [w.encode() for w in plain_words(text)]
        assert words.words(text.encode()) == want
        assert [w for part in words.chunks(text.encode(), 5) for w in part] == want


# ------------------------------------------------------------------ decontamination

def test_index_of_small_shards():
    draw = np.random.default_rng(0)
    for t in range(120):
        parts = [np.append(draw.integers(1, 4, draw.integers(0, 12)), 0) for _ in range(draw.integers(1, 6))]
        symbols = np.concatenate(parts * (1 + t % 2)).astype(np.uint32)
        ends = np.flatnonzero(symbols == 0)
        told = symbols.astype(int) + len(ends)
        told[ends] = np.arange(len(ends))
        assert fm_index.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: told[i:].tolist())
        shard = fm_index.Shard.build(symbols, 4)
        for m in (1, 2, 4):
            codes = draw.integers(1, max(2, symbols.max() + 1), (8, m))
            codes[0, 0] = -1
            for p, a, b in zip(codes, *shard.search(codes, np.full(8, m))):
                want = [i for i in range(len(symbols) - m + 1) if (symbols[i:i + m] == p).all()]
                assert sorted(shard.locate(np.arange(a, b)).tolist()) == want


def brute_contamination(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = plain_words(item)
            k = min(window, len(v))
            for a in range(len(v) - k + 1 if v else 0):
                for i in range(len(w) - k + 1):
                    if w[i:i + k] == v[a:a + k]:
                        hit |= set(range(i, i + k))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaks():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 10, 11, 25, 40, 14))]
    items += [(2, items[2][1]), (10, "One"), (None, "alpha beta gamma"), (11, None), (12, " .!"), (13, items[3][1].upper())]
    docs = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "one. two ONE"), (6, "alpha, beta; GAMMA alpha beta gamma")]
    for i in range(30):
        body = [draw.choice(vocabulary) for _ in range(draw.randrange(80))]
        for _ in range(draw.randrange(3)):
            at, (_, text) = draw.randrange(len(body) + 1), draw.choice(items[:6])
            body[at:at] = text.split()
        docs.append((10 + i, ", ".join(body)))
    docs += [docs[8], docs[9], (10, "other text"), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("shard, pairs", [(1 << 20, 50_000), (60, 7), (25, 50_000)])
def test_decontamination_equals_brute_force(spark, leaks, shard, pairs):
    docs, items = leaks
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _text int").repartition(3)
    got = fm_index.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), shard=shard, pairs=pairs)
    rows = [(r["doc_id"], r["n_words"], [i for s in r["spans"] for i in range(s["start"], s["stop"])], r["items"])
            for r in got.collect()]
    assert sorted(rows, key=str) == brute_contamination(docs, items)
    assert any(len(r[3]) > 2 for r in rows)


def test_decontamination_of_empty_tables(spark, leaks):
    docs = spark.createDataFrame(leaks[0], "doc_id long, text string")
    items = spark.createDataFrame(leaks[1], "item_id long, text string")
    rows = fm_index.contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(leaks[0]) and not any(r["spans"] or r["items"] for r in rows)
    assert fm_index.contamination(docs.limit(0), items).count() == 0


def test_long_copies_in_one_shard(spark):
    text = " ".join(f"x{i % 997}" for i in range(30_000))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, " ".join(f"x{i}" for i in range(900, 930)))], "item_id long, text string")
    rows = fm_index.contamination(docs, items).collect()
    assert [r["n_words"] for r in rows] == [30_000] * 5
    assert all(len(r["spans"]) == 30 and r["items"] == ["7"] for r in rows)


def test_clean_removes_the_spans(spark):
    docs = spark.createDataFrame([(1, "Keep (One two, THREE) this", "a"), (2, None, "b"), (1, "nothing here", "c"),
                                  (3, "one two three", "d"), (3, "one two three", "e")], "doc_id long, text string, spans string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = fm_index.clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "Keep () this", "a"), (2, None, "b"), (1, "nothing here", "c"), (3, "", "d"), (3, "", "e")], key=str)


def test_registered_decontamination_hashes_its_items(spark, tmp_path, leaks):
    docs, items = leaks
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, fm_index.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(d, n, len(h), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(h))
                          for d, n, h, f in brute_contamination(docs, items)], key=str)


# ------------------------------------------------------------------ lexical search

def brute_search(docs, items, top=10):
    counted = [(d, Counter(plain_words(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, k in Counter(plain_words(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    pick = lambda n: " ".join(f"t{int(draw.paretovariate(0.7)) % 60}" for _ in range(n))
    docs = [(i, pick(draw.randrange(1, 60))) for i in range(120)] + [(200 + i, "t1 T2 t3") for i in range(15)]
    docs += [(5, "t1 t2 t3"), (None, "t1 t2 t3"), (300, None), (301, ""), (302, "t7 " * 40_000)]
    items = [(i, pick(draw.randrange(1, 50))) for i in range(40)] + [(3, "t1 t2"), (60, None), (61, "absent"), (None, "T1-t2 t2")]
    return docs, items


@pytest.mark.parametrize("top, pairs", [(10, 100_000), (3, 40)])
def test_search_equals_brute_force(spark, corpus, top, pairs):
    docs, items = corpus
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, score int").repartition(4)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), top, pairs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, top)


def test_search_of_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_shared_sums_equal_plain_sums():
    draw = random.Random(2)
    items = [[(t, 1 + (t + i) % 7 // 6) for t in sorted(draw.sample(range(40), draw.randrange(1, 30)))] for i in range(50)]
    items += [[(i, 1) for i in range(300)], [(i, 1) for i in range(10, 310)], []]
    plan = lexical.share([x for x in items if x])
    rows = np.array([[draw.randrange(100) for _ in range(5)] for _ in plan.leaves])
    at = {leaf: k for k, leaf in enumerate(plan.leaves)}
    want = np.array([rows[[at[x] for x in item]].sum(axis=0) for item in items if item])
    assert (plan.evaluate(rows) == want).all()
    assert plan.additions < 0.6 * sum(len(x) - 1 for x in items if x)


# ------------------------------------------------------------------ whitening

def test_cholesky_and_jacobi_find_the_eigenvectors():
    draw = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (12, 7), (33, 33)):
        root = draw.normal(size=(d, rank)) * 10.0 ** draw.integers(-2, 2, rank)
        a = root @ root.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, rtol=0, atol=1e-12 * np.abs(a).max())
        values, vectors = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-6, atol=1e-13 * values[0])
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12) and (np.diff(values) <= 0).all()


def test_whitening_equals_brute_force(spark):
    draw = np.random.default_rng(8)
    vectors = [(i, (draw.normal(size=6) * [1, 2, 3, 4, 5, 0]).tolist(), "x") for i in range(60)]
    vectors += [(5, vectors[5][1], "x"), (None, vectors[6][1], "x")]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (103, [float("nan")] * 6, "x"),
           (104, [float("inf")] * 6, "x"), (105, [1.0, 2.0], "x")]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, whitened string").repartition(3)
    rows = whitening.components(frame).collect()
    x = np.floor(64 * np.array([v for _, v, _ in vectors])).astype(np.int64) + 1_000_000
    n = len(x)
    y = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(y.T @ y / n)
    want = y @ axes[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    assert len(rows) == n * 5 and {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-10
    for k in range(5):
        got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["whitened"]) for r in rows if r["component"] == k + 1)
        plain = [(i if i is not None else -1, w) for (i, _, _), w in zip(vectors, want[:, k])]
        assert any(np.allclose([v for _, v in got], [v for _, v in sorted((i, s * w) for i, w in plain)], atol=1e-9) for s in (1, -1))
        assert {r["explained"] for r in rows if r["component"] == k + 1}.pop() == pytest.approx(values[::-1][k] / values.sum(), rel=1e-9)
    deviation = {r["vec_id"]: r["deviation"] for r in rows}
    assert all(deviation[i] == int(((n * x[k] - x.sum(axis=0)) ** 2).sum()) for k, (i, _, _) in enumerate(vectors))


def test_deviation_is_exact_or_null(spark):
    vectors = [(i, [2.0 ** 20 * (i % 3), float(i)]) for i in range(40)]
    rows = whitening.components(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*x)]
    for r in rows:
        whole = sum((40 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["deviation"] == (whole if whole < 1 << 63 else None)
    far = whitening.components(spark.createDataFrame([(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.0, 0.5])],
                                                     "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in far if r["vec_id"] < 2} == {None}


def test_whitening_without_spread_has_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.components(spark.createDataFrame(rows, schema)).count() == 0


def test_rounds_meet_every_pair_once():
    for n in (1, 2, 5, 8):
        pairs = [tuple(sorted(p)) for a, b in whitening.rounds(n) for p in zip(a.tolist(), b.tolist())]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]
