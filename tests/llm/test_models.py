"""Language ID, near-duplicate join, page text and the pipeline."""

import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import langid, ngram_join, page_text

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def cuts(word):
    for n in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *at), (*at, len(word)))]


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "aba", "b", "ba", "▁", "▁a"]
    draw = np.random.default_rng(0)
    probs = np.vstack([draw.random((len(pieces) + 1, 2)), np.zeros((1, 2))])
    index = {p: i for i, p in enumerate(pieces)}
    words = ["▁abab", "▁aabb", "▁acba"]
    got = langid.Lattice(index, words).log_words(probs)
    expected = langid.Lattice(index, words).expected(probs[:, :1], np.array([1.0, 2.0, 3.0]))
    counts = np.zeros(len(pieces) + 2)
    for w, weight, row in zip(words, (1, 2, 3), got):
        codes = [[index.get(p, len(pieces) if len(p) == 1 else None) for p in cut] for cut in cuts(w)]
        codes = [c for c in codes if None not in c]
        for lang in (0, 1):
            assert row[lang] == pytest.approx(math.log(sum(np.prod(probs[c, lang]) for c in codes)))
        total = sum(np.prod(probs[c, 0]) for c in codes)
        for c in codes:
            for i in c:
                counts[i] += weight * np.prod(probs[c, 0]) / total
    assert expected == pytest.approx(counts)


def test_long_words_are_summed_whole():
    assert langid.marked_words("ab" * 35 + " x") == ["ab" * 35, "x"]
    pieces = ["a", "ab", "aba", "b", "ba", "bab"]
    index = {p: i for i, p in enumerate(pieces)}
    draw = np.random.default_rng(7)
    probs = np.vstack([draw.random((len(pieces) + 1, 2)) * 0.3, np.zeros((1, 2))])
    words = ["".join(draw.choice(["a", "b"], 60)) for _ in range(3)]
    lattice = langid.Lattice(index, words)
    assert lattice.n > langid.PLAIN
    assert lattice.log_words(probs) == pytest.approx(np.log(lattice.forward(probs)[lattice.n]), rel=1e-12)
    plain = sum(langid.Lattice(index, [w]).expected(probs[:, :1], np.array([2.0])) for w in words)
    assert lattice.expected(probs[:, :1], np.full(3, 2.0)) == pytest.approx(plain)
    limit, langid.PLAIN = langid.PLAIN, 100
    try:
        assert lattice.expected(probs[:, :1], np.full(3, 2.0)) == pytest.approx(plain, rel=1e-10)
    finally:
        langid.PLAIN = limit
    far = langid.Lattice(index, ["ab" * 3000]).log_words(probs)
    assert np.isfinite(far).all() and (far < -2000).all()


def test_predictions_equal_plain_sums_over_whole_documents(spark):
    rows = [(i, f"der und die das nicht {i}", "de") for i in range(12)] + [(20 + i, f"the and of that is {i}", "en") for i in range(12)]
    texts = {50: "Das ist the Haus, und " + "donaudampf" * 6 + "!", 51: "of that und die", 52: "the the the of is zzz"}
    docs = spark.createDataFrame(rows + [(k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string")
    model = langid.learn_from(docs)
    index = {p: i for i, p in enumerate(model.pieces)}
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for k, text in texts.items():
        total = np.array(model.priors, float).copy()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            marked = langid.MARK + word
            sums = [[1.0] * len(model.languages)]
            for end in range(1, len(marked) + 1):
                sums.append([sum(model.probs[index.get(marked[a:end], len(index) if end - a == 1 else -1), lang] * sums[a][lang]
                                 for a in range(end)) for lang in range(len(model.languages))])
            total += np.log(sums[-1])
        best = int(np.argmax(total))
        assert got[k]["lang_pred"] == model.languages[best]
        assert got[k]["score"] == pytest.approx(1 / np.exp(total - total[best]).sum(), rel=1e-6)


def test_long_pieces_are_used():
    pieces = langid.read_pieces(langid.common.file_bytes(langid.public_tokenizers.path(langid.VOCABULARY)))
    assert {"▁function", "▁different", "▁information"} <= set(pieces)
    index = {"▁different": 0, "▁": 1, "d": 2, "ifferent": 3}
    probs = np.array([[0.5], [0.2], [0.1], [0.3], [0.0], [0.0]])
    got = langid.Lattice(index, ["▁different"]).log_words(probs)
    assert math.exp(got[0, 0]) == pytest.approx(0.5 + 0.2 * 0.1 * 0.3)


def test_language_of_odd_texts(spark):
    rows = [(i, f"der und die das nicht {i}", "de", 0.5) for i in range(12)]
    rows += [(20 + i, f"the and of that is {i}", "en", 0.5) for i in range(12)]
    rows += [(50, None, "en", 0.1), (51, "12 34 !", None, 0.1), (52, "the " * 20_000, None, 0.1), (53, "", "de", 0.1),
             (54, "x" * 100_000, None, 0.1), (55, "die der", None, 0.1), (55, "die der", None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    model = langid.learn_from(docs)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert {k: got[k]["lang_pred"] for k in (50, 51, 52, 53, 55)} == {50: "und", 51: "und", 52: "en", 53: "und", 55: "de"}
    assert got[50]["score"] == 0 and 0.5 < got[55]["score"] <= 1 and got[54]["lang_pred"] in ("de", "en")
    kept = langid.keep(docs, model, 0.5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} & {50, 51, 53} == set()
    assert langid.learn_from(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


@needs_tables
def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = langid.query(spark, SF).join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and len(rows) > 20


def brute_classes(texts, words=5, similarity=0.8):
    """class_id, n_links, n_copies by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    classes = {}
    for i, s in enumerate(sets):
        classes.setdefault(s if s else i, []).append(i)
    keys = [k for k in classes if not isinstance(k, int)]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = dict.fromkeys(keys, 0)
    for a, b in itertools.combinations(keys, 2):
        both = len(a & b)
        if both >= similarity * (len(a) + len(b) - both):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), 1 << 60), *classes[k])
    return [(i, least[find(s)], links[s], len(classes[s]) - 1) if s else (i, i, 0, 0) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def near_texts():
    draw = random.Random(9)
    texts = [None, "", " \n", "one two", "one two", "one  two\n", "a b c d e"]
    for family, n in ((25, 150), (6, 200), (3, 120), (2, 400), (2, 5)):
        base = [f"w{draw.randrange(3000)}" for _ in range(n)]
        for k in range(family):
            words = list(base)
            for _ in range(draw.randrange(3)):
                words[draw.randrange(n)] = f"v{draw.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join(f"w{draw.randrange(3000)}" for _ in range(80)) for _ in range(30)]
    return texts


@pytest.mark.parametrize("block", [512, 4])
def test_join_equals_all_pairs(spark, near_texts, block):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(near_texts)], "doc_id long, text string, _set string")
    rows = ngram_join.classify(docs.repartition(3), block=block).select("doc_id", "class_id", "n_links", "n_copies").collect()
    want = brute_classes(near_texts)
    assert sum(w[2] for w in want) > 100 and sorted(tuple(r) for r in rows) == sorted(want)
    kept = ngram_join.keep_one(docs, block=block)
    assert kept.columns == docs.columns
    heads = {w[1] for w in want}
    assert {r["doc_id"] for r in kept.collect()} == heads


def test_no_link_at_the_threshold_is_lost(spark):
    draw = random.Random(3)
    texts = []
    for pair in range(3000):  # 45 shingles each, 40 of them common: similarity 0.8
        words = [f"p{pair}w{draw.randrange(10**9)}" for _ in range(49)]
        texts += [" ".join(words), " ".join([*words[:20], "other", *words[21:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (512, 1):
        rows = ngram_join.classify(docs, block=block).collect()
        assert len(rows) == 6000 and all(r["n_links"] == 1 and r["class_id"] == r["doc_id"] // 2 * 2 for r in rows)


def test_similar_sets_share_a_shingle_of_their_prefixes():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 60).astype(np.uint64)
    order = ngram_join.Order(base[:40], draw.integers(2, 9, 40))
    sets = [np.unique(np.concatenate([draw.choice(base, n, replace=False), draw.integers(0, 1 << 63, k).astype(np.uint64)]))
            for n, k in zip(draw.integers(1, 60, 300), draw.integers(0, 6, 300))]
    prefixes = order.prefixes(sets, 0.6)
    similar = 0
    for (a, p), (b, q) in itertools.combinations(zip(sets, prefixes), 2):
        both = len(np.intersect1d(a, b))
        if both >= 0.6 * (len(a) + len(b) - both):
            similar += 1
            assert set(p.tolist()) & set(q.tolist())
    assert similar > 50 and sum(map(len, prefixes)) < sum(map(len, sets))


def test_one_document_stays_of_each_class_with_null_and_repeated_ids(spark):
    def text(name, change=""):
        return " ".join(f"{name}{i}" for i in range(100)) + change

    rows = [(1, text("a")), (2, text("a", " x")), (1, text("b")), (3, text("b", " x")), (None, text("c")),
            (None, text("c", " x")), (None, text("d")), (7, text("d", " x")), (None, None), (4, text("e"))]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(kept) == 6 and {rows[i] for i in (0, 2, 6, 8, 9)} <= {tuple(r) for r in kept}
    assert sum((r["text"] or "").startswith("c0") for r in kept) == 1
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 1, 4]


def test_parity_bits_rule_out_no_link():
    draw = np.random.default_rng(6)
    sets = []
    for n in (3, 40, 500, 520, 3000, 3300, 20_000):
        base = draw.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.2, 0.9):
            gone = draw.random(n) < share
            sets.append(np.unique(np.concatenate([base[~gone], draw.integers(0, 1 << 63, int(gone.sum())).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    width = ngram_join.odd_width(sizes)
    odd = [np.packbits((np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1).astype(bool)).tobytes()
           for s, w in zip(sets, width.tolist())]
    left, right = np.triu_indices(len(sets), 1)
    may = ngram_join.may_link(odd, sizes, left, right, 0.8)
    ok = ngram_join._jaccard_pairs(sets, left, right, 0.8)
    near = np.minimum(sizes[left], sizes[right]) >= 0.8 * np.maximum(sizes[left], sizes[right])
    assert ok.sum() > 10 and may[ok].all() and may[near].sum() < 2 * ok.sum()


def test_matched_depth_shortens_to_the_recall():
    assert ngram_join.matched_depth() == 5
    assert ngram_join.matched_depth(recall=0.5) > 5 and ngram_join.matched_depth(recall=0.9999) < 5


def test_join_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.classify(docs).count() == 0 and ngram_join.keep_one(docs).count() == 0


def test_dense_and_sparse_verification_agree():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    for similarity in (0.3, 0.5):
        assert (ngram_join._jaccard_pairs(sets, left, right, similarity)
                == ngram_join._jaccard_block(sets, left, right, similarity)).all()


def test_shared_is_a_longest_common_subsequence():
    draw = random.Random(1)
    for _ in range(150):
        a = [draw.choice("abc") for _ in range(draw.randrange(12))]
        b = [draw.choice("abcd") for _ in range(draw.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = sorted(page_text.shared(a, b))
        assert len(got) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_main_text_of_pages(spark):
    open_page = "<body><div>Home</div><p>Story {0} &lt;b&gt;</p><p>More  {0}\n here</p><div>About us</div></body>"
    rows = [(1, "http://h.example/a", "<html><head><title>T</title></head><body><nav>Menu</nav><header>Top</header>"
             "<div class='ad'>Buy<div>x</div></div><article><h1>Head &amp; more</h1><p><b>One<br><p>Two&nbsp; words "
             "<i>and</i>\nso</p><aside>Side</aside><div id='comments'><article>Me too</article></div><script>a='</p>'"
             "</script><!-- no --></article><footer>End</footer>"),
            (2, "http://h.example/b/1", open_page.format(1)), (3, "http://h.example/b/2", open_page.format(2)),
            (4, "http://other.example/", "<p>Alone</p>"), (5, None, None), (6, "bad url", "text & <b>bold</b> 1 < 2"),
            (7, "http://h.example/b/3", open_page.format(3)), (8, "http://k.example", "<main><p>cut off <b>he")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    want = {1: "Head & more\nOne\nTwo words and so", 2: "Story 1 <b>\nMore 1 here", 3: "Story 2 <b>\nMore 2 here",
            4: "Alone", 5: "", 6: "text & bold 1 < 2", 7: "Story 3 <b>\nMore 3 here", 8: "cut off he"}
    for parts in (1, 5):
        got = {r["page_id"]: r["text"] for r in page_text.extract(pages.repartition(parts)).collect()}
        assert got == want
    assert page_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_nearest_does_not_depend_on_ranges(spark, parts):
    rows = [("h", f"/{a}/{b}", 10 * a + b) for a in range(6) for b in range(4)] + [("k", "/1", 100), ("l", "/1", 101), ("l", "/1", 102)]
    keys = spark.createDataFrame(rows, "_host string, _path string, _uid long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["_uid"]: r["_partner"] for r in page_text.nearest(keys).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows) and got[100] is None and got[101] == 102 and got[102] == 101
    assert all(got[10 * a + b] // 10 == a for a in range(6) for b in range(4))


def brute_pages(rows):
    """Texts of pages (page_id, url, html) by comparing each open page with all pages of its host."""
    cut = [re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", u or "") for _, u, _ in rows]
    pages = [(m[1] if m else "", m[2] if m else "", i, page_text.blocks(h or "")) for i, (m, (_, _, h)) in enumerate(zip(cut, rows))]
    out = {}
    for host, path, i, (main, inside, mine) in pages:
        def start(other):
            return 1 << 40 if other[1] == path else len(os.path.commonprefix([other[1], path]))

        def lines(page):
            return [] if page[3][0] and not page[3][2] else page[3][2]

        others = [p for p in pages if p[0] == host and lines(p) != mine]
        before = max((p for p in others if p[1:3] < (path, i)), key=lambda p: p[1:3], default=None)
        after = min((p for p in others if p[1:3] > (path, i)), key=lambda p: p[1:3], default=None)
        near = max((p for p in (before, after) if p), key=start, default=None)
        other = lines(near) if near else []
        best = {(x, y): 0 for x in range(len(mine) + 1) for y in range(len(other) + 1)}
        for x, y in itertools.product(range(len(mine)), range(len(other))):
            best[x + 1, y + 1] = best[x, y] + 1 if mine[x] == other[y] else max(best[x, y + 1], best[x + 1, y])
        x, y, gone = len(mine), len(other), set()
        while x and y:
            if mine[x - 1] == other[y - 1]:
                gone.add(x - 1)
                x, y = x - 1, y - 1
            elif best[x - 1, y] >= best[x, y - 1]:
                x -= 1
            else:
                y -= 1
        out[rows[i][0]] = "\n".join(inside if main else [t for k, t in enumerate(mine) if k not in gone])
    return out


def test_copies_without_markup_keep_their_text(spark):
    page = "<p>Home</p><p>The story</p><p>About us</p>"
    rows = [(i, f"http://copies.example/{i}", page) for i in range(6)] + [(10 + i, "http://one.example/x", page) for i in range(2)]
    rows += [(20 + i, f"http://mixed.example/a/{i}", page) for i in range(5)] + [(30, "http://mixed.example/b", page.replace("The", "Other"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages.repartition(3)).collect()}
    assert all(got[i] == "Home\nThe story\nAbout us" for i in (*range(6), 10, 11))
    assert all(got[20 + i] == "The story" for i in range(5)) and got[30] == "Other story"


@pytest.mark.parametrize("parts", ["1", "9"])
def test_pages_equal_brute_force(spark, parts):
    draw = random.Random(8)
    rows = []
    for i in range(90):
        body = f"<p>Menu</p><p>Story {draw.randrange(4)}</p><p>More {draw.randrange(2)}</p><p>End</p>"
        body = f"<article>{body}</article>" if draw.random() < 0.1 else body
        rows.append((i, f"http://{draw.choice('aaab')}.example/{draw.choice('xyz')}{i:02d}", body))
    rows += [(100 + i, f"http://c.example/{i:02d}", rows[3 if i < 20 else 4][2]) for i in range(30)]
    rows += [(200, None, None), (201, "http://d.example/", "<p>Alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: r["text"] for r in page_text.extract(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_pages(rows)


def test_registered_page_query_equals_brute_force(spark, tmp_path):
    page = "<p>Menu</p><p>Story {}</p><p>End</p>"
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i:02d}", page.format(i // 6)) for i in range(40)]
    rows += [(50, "http://a.example/05", "<main><p>Whole</p></main><p>Rest</p>"), (51, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.query(spark, str(tmp_path)).collect()}
    assert got == {i: (text, len(text)) for i, text in brute_pages(rows).items()}


@needs_tables
def test_pipeline_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == whole
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept[name] = {r["doc_id"] for r in after.collect()}
        if name == "exact_dedup":
            assert kept[name] == {max(i for i, t in rows.items() if t == text) for text in set(rows.values())}
        if name == "near_dedup":
            ids = sorted(rows)
            want = brute_classes([rows[i] for i in ids])
            assert kept[name] == {ids[w[1]] for w in want}
        docs = docs.filter(F.col("doc_id").isin(sorted(kept[name])))
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == kept["near_dedup"]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language_id", "exact_dedup", "near_dedup", "best_fit_packing"]
