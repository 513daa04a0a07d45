"""BPE, wavelet shards and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import bpe, common, packing, tokens, wavelet

LONG = "word " * 30_000
TEXTS = ["Hello  world!\n\nIt's 42 o'clock.", None, "", "a" * 120_000, " " * 70_000 + "x", LONG + "ä ß" + LONG,
         "tail  ", "\x1c odd\x1c ᠎ x", "naïve Straße 😀😀 日本語 テキスト", "same", "same", "<|endoftext|> text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"x{i}", i) for i, t in enumerate(TEXTS)] + [(9, "same", "x9", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, _row int").repartition(3)


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def codec():
    return bpe.Codec(common.file_bytes(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN)


def test_bpe_equals_the_library_and_decodes(spark, docs):
    plain = codec().encoding
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == plain.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["_row"] == r["doc_id"]


def test_bpe_cuts_only_where_a_match_ends():
    cut = bpe.Codec(common.file_bytes(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN, cut=5)
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice("ab'sé1 \n\t! 　\x1c") for _ in range(draw.randrange(80)))
        assert cut.encode(text) == cut.encoding.encode_ordinary(text), repr(text)
    blanks = cut.encode(" " * 1_200_000 + "a")  # the library itself overflows its stack here
    assert cut.decode(blanks) == b" " * 1_200_000 + b"a"


def test_bpe_of_an_empty_table(spark, docs):
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_units_give_the_ids_of_the_whole_text(library):
    encoder = tokens.Texts(common.file_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab'sé1 \n\t! 　\x1c᠎,") for _ in range(draw.randrange(60)))
             for _ in range(300)] + [t or "" for t in TEXTS]
    ids, sizes = encoder.encode(texts)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == library(text), repr(text[:80])


def test_a_batch_names_each_unit_once(library):
    encoder = tokens.Texts(common.file_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["to be or  not to be", "", "or not\u00a0to be\u3000", "or\x1c not", " \x85 be \n", "\0 to be"]
    units, at, each, whole = encoder.cut(texts)
    assert len(set(units)) == len(units) < len(at) and whole == {"or\x1c not"} and len(each) == len(texts)
    ends = np.cumsum(each)
    assert ["".join(units[k] for k in at[a:b]) for a, b in zip(ends - each, ends)] == texts
    ids, sizes = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library(t)] and sizes.tolist() == [len(library(t)) for t in texts]


def test_wavelet_matrix_against_a_plain_list():
    draw = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5000, 7), (9000, 50_000)):
        ids = draw.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, [3], [0], [n], 2, 4).to_bytes())
        assert (m.decode() == ids).all() and (m.part, m.shard) == (2, 4)
        for i in draw.integers(0, n, 20) if n else ():
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert m.access(int(i)) == token and m.count(token) == len(places)
            assert m.rank(token, int(i)) == (ids[:i] == token).sum()
            k = int(draw.integers(0, len(places)))
            assert m.select(token, k) == places[k]
        assert m.count(60_000) == 0
        with pytest.raises(IndexError):
            m.select(60_000, 0)


@pytest.mark.parametrize("shard_tokens", [1 << 20, 50])
def test_shards_read_back_in_order(spark, docs, library, tmp_path, shard_tokens):
    root = f"file://{tmp_path}/shards"
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    manifest = wavelet.write_shards(extra, root, shard_tokens=shard_tokens)
    rows = wavelet.read_shards(spark, root, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, *sorted([*range(len(TEXTS)), 9])]
    at = 0
    for r in rows:
        ids = library("no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]) + [wavelet.END_ID]
        assert r["start"] == at and r["n_tokens"] == len(ids)
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    assert manifest.agg({"tokens": "sum"}).first()[0] == at
    told = wavelet.read_shards(spark, root, manifest, digest=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in told] == [
        (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in rows]


def test_root_without_a_scheme_lies_where_spark_looks(spark, docs, tmp_path):
    root = f"{tmp_path}/plain"
    assert wavelet.qualified(spark, root).startswith("file:") and wavelet.qualified(spark, f"file://{root}").endswith("/plain")
    manifest = wavelet.write_shards(docs.select("doc_id", "text"), root)
    assert wavelet.read_shards(spark, root, manifest).count() == len(TEXTS) + 1


def test_a_lookup_inflates_a_few_pieces():
    draw = np.random.default_rng(5)
    ids = draw.integers(0, 3000, 3_000_000).astype(np.uint32)
    data = wavelet.WaveletMatrix.build(ids).to_bytes()
    matrix = wavelet.WaveletMatrix.from_bytes(data)
    pieces = sum(len(p.pieces) for p in matrix.planes)
    assert not any(p.open for p in matrix.planes) and pieces > 60
    assert matrix.access(1_234_567) == ids[1_234_567]
    assert 0 < sum(len(p.open) for p in matrix.planes) <= 2 * matrix.levels
    at = matrix.select(17, 40)
    assert ids[at] == 17 and (ids[:at] == 17).sum() == 40 == matrix.rank(17, at)
    assert (matrix.decode() == ids).all()


@pytest.mark.parametrize("n", [0, 1, 8, 9, 2047, 2048, 2049, 8 * wavelet.PIECE, 8 * wavelet.PIECE + 1])
def test_planes_of_every_size_are_read_back(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (matrix.decode() == ids).all() and (not n or matrix.access(n - 1) == ids[-1])


def test_shards_of_an_empty_table(spark, docs, tmp_path):
    root = f"file://{tmp_path}/none"
    manifest = wavelet.write_shards(docs.limit(0), root)
    assert wavelet.read_shards(spark, root, manifest).count() == 0


def check_packing(rows, size):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_places_every_piece(spark, docs, library):
    rows = packing.pack(docs, size=64).collect()
    total = 0
    for doc_id in [*range(len(TEXTS))]:
        ids = library(TEXTS[doc_id]) + [packing.END_ID]
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id)
        copies = 2 if doc_id == 9 else 1
        total += copies * len(ids)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert mine == sorted(want * copies)
    assert check_packing(rows, 64) <= -(-total // 64) + 1


def test_packed_sequences_hold_the_ids(spark, docs, library):
    made = common.stage(packing.pieces(docs.filter("length(text) < 100"), size=64), "t")
    rows = packing.sequences(packing.assign(made, 64)).collect()
    ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in rows])
    want = [x for i, t in [*enumerate(TEXTS), (9, "same")] if t is not None and len(t) < 100 for x in [*library(t), 0]]
    assert sorted(ids.tolist()) == sorted(want) and all(len(r["ids"]) <= 256 for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_covers_all_ranks_without_overlap():
    draw = random.Random(11)
    for size in (8, 30, 100):
        for _ in range(60):
            counts = {n: draw.choice([0, 1, 2, 5, 40]) for n in range(1, size + 1)}
            runs = sorted(packing.plan(counts, size))
            rows = []
            for (n, rank, first, offset), after in zip(runs, [*runs[1:], (0, 0, 0, 0)]):
                end = after[1] if after[0] == n else counts[n]
                rows += [{"sequence_id": first + k, "offset": offset, "length": n} for k in range(end - rank)]
            assert len(rows) == sum(counts.values())
            used = check_packing(rows, size)
            small = sum(n * c for n, c in counts.items())
            assert used >= -(-small // size)


def test_registered_query_hashes_what_the_library_says(spark, docs, tmp_path):
    docs.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain = codec().encoding
    rows = bpe.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_library_gets_few_texts_at_once_and_memory_goes_back_after_a_task(monkeypatch):
    import pyarrow as pa

    made = tokens.Texts(common.file_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    library, sizes = made.library, []

    class Counted:
        def encode_batch_fast(self, texts, **settings):
            sizes.append(len(texts))
            return library.encode_batch_fast(texts, **settings)

    made.library = Counted()
    text = " ".join(f"w{i} {i * 7919}" for i in range(40_000))
    ids, each = made.encode([text])
    assert len(sizes) > 1 and max(sizes) <= 8
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and each.tolist() == [len(ids)]
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", None])], ["text"])
    assert sum(b.num_rows for b in common.slices(iter([batch, batch]), "text", 1)) == 6
    assert calls == [1]
