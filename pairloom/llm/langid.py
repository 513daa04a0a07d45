"""Language ID by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary that a word can hold, of any length. A
language gives each piece a probability; a word's probability is the sum, over every way to cut
it into pieces, of the product of their probabilities, found by a forward pass over its
characters. A text's score in a language is the log prior plus the sum over all its words, and
the prediction is the best language with its posterior as the score.

Words are runs of letters in lower case with a word-start mark. Single characters outside the
vocabulary count as one unknown piece. Word probabilities do not depend on the text, so a
worker computes each distinct word once while it remembers it; forward passes run over many
words at a time. A run of over 32 letters counts as several words.

Training: expectation-maximisation (the same forward pass, and a backward one) on the words of
at most ``PER_LANGUAGE`` documents of each language, those with the smallest hash of doc_id,
whole texts; the bound is the documented sample of labelled rows. Priors are counted over all
labelled documents. The model has (pieces + 1) x languages numbers whatever the corpus.

Text that is null or has no letter is ``und`` with score 0. With no labelled document every
text is ``und``. Repeated rows are scored alike; an empty table gives no rows; ties go to the
first language by name. Other columns stay as they are or are left out by the query.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairloom.llm import common

VOCABULARY = "piece_bpe_32k.model"
PER_LANGUAGE = 400
ROUNDS = 3
#: Added to each expected count: a piece unseen in a language keeps some probability.
SMOOTH = 0.05
#: Distinct words that a worker remembers before it drops those seen once.
WORDS = 200_000
UNKNOWN = "und"
MARK = "▁"
#: A word: a run of letters of any length.
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters up to which products of probabilities stay above the smallest double; longer words
#: are summed by their logarithms.
PLAIN = 33


def read_pieces(data: bytes) -> list[str]:
    """Pieces of a sentencepiece vocabulary that can occur inside a marked lower-case word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    names = (model.id_to_piece(i) for i in range(model.vocab_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return sorted({p for p in names if LETTERS.fullmatch(p.removeprefix(MARK) or "a")
                   and p == p.lower()})


class Lattice:
    """Words of one length as piece numbers: ids[w, i, k] is the piece of k + 1 characters that
    ends at character i of word w, or -1."""

    def __init__(self, index: dict[str, int], words: list[str], longest: int | None = None):
        n = len(words[0])
        most = min(longest or max(map(len, index), default=1), n)
        self.n, self.unknown = n, len(index)
        get, unknown = index.get, len(index)
        codes = (get(w[i - k:i + 1], unknown if k == 0 else -1) if k <= i else -1
                 for w in words for i in range(n) for k in range(most))
        self.ids = np.fromiter(codes, np.int32, len(words) * n * most).reshape(len(words), n, most)

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Sum over all cuts of the first i characters, for each i, word and language.

        probs: (pieces + 2, languages); the last row is 0 and stands for "no such piece".
        """
        m, n, most = self.ids.shape
        alpha = np.zeros((n + 1, m, probs.shape[1]))
        alpha[0] = 1.0
        for i in range(n):
            for k in range(min(most, i + 1)):
                alpha[i + 1] += probs[self.ids[:, i, k]] * alpha[i - k]
        return alpha

    def log_forward(self, logs: np.ndarray, backward: bool = False) -> np.ndarray:
        """Logarithms of the same sums (``backward``: over the cuts of what follows each character)."""
        m, n, most = self.ids.shape
        out = np.full((n + 1, m, logs.shape[1]), -np.inf)
        out[n if backward else 0] = 0.0
        for i in range(n):
            if backward:
                begin = n - 1 - i  # pieces that start here end at begin + k
                terms = [logs[self.ids[:, begin + k, k]] + out[begin + k + 1] for k in range(min(most, i + 1))]
            else:
                terms = [logs[self.ids[:, i, k]] + out[i - k] for k in range(min(most, i + 1))]
            out[begin if backward else i + 1] = np.logaddexp.reduce(terms)
        return out

    def log_words(self, probs: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        if self.n > PLAIN:
            with np.errstate(divide="ignore"):
                return self.log_forward(np.log(probs))[self.n]
        return np.log(self.forward(probs)[self.n])

    def expected(self, probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of each piece, words weighted; probs has one language."""
        m, n, most = self.ids.shape
        p = probs[:, 0]
        if n > PLAIN:
            with np.errstate(divide="ignore"):
                logs = np.log(probs)
            ahead, behind = self.log_forward(logs)[:, :, 0], self.log_forward(logs, True)[:, :, 0]
            out = np.zeros(len(p))
            for i in range(n):
                for k in range(min(most, i + 1)):
                    ids = self.ids[:, i, k]
                    share = np.exp(ahead[i - k] + logs[ids, 0] + behind[i + 1] - ahead[n])
                    out += np.bincount(ids % len(p), share * weights, len(p))
            out[-1] = 0.0
            return out
        alpha = self.forward(probs)[:, :, 0]
        beta = np.zeros((n + 1, m))
        beta[n] = 1.0
        for i in range(n - 1, -1, -1):
            for k in range(min(most, i + 1)):
                beta[i - k] += p[self.ids[:, i, k]] * beta[i + 1]
        out = np.zeros(len(p))
        share = weights / alpha[n]
        for i in range(n):
            for k in range(min(most, i + 1)):
                ids = self.ids[:, i, k]
                out += np.bincount(ids % len(p), p[ids] * alpha[i - k] * beta[i + 1] * share, len(p))
        out[-1] = 0.0
        return out


def by_length(words: list[str], most: int = 20_000):
    """Groups of words of one length, with their places; ``most`` characters in a group."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        n = len(words[order[at]])
        end = at + 1
        while end < len(order) and end - at < max(1, most // n) and len(words[order[end]]) == n:
            end += 1
        yield order[at:end], [words[i] for i in order[at:end]]
        at = end


def marked_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """What a task needs: pieces, languages, log priors and probabilities."""

    def __init__(self, pieces, languages, priors, probs):
        self.pieces, self.languages, self.priors = pieces, languages, priors
        self.probs = np.vstack([probs, np.zeros((1, len(languages)))])
        self.name = hash((tuple(languages), probs.tobytes(), priors.tobytes()))

    def scorer(self) -> Scorer:
        cache = common.worker_cache("langid")
        if cache.get("langid", (None,))[0] != self.name:
            cache["langid"] = (self.name, Scorer(self))
        return cache["langid"][1]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.index = {p: i for i, p in enumerate(model.pieces)}
        self.longest = max(map(len, model.pieces), default=1)
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Drop the words, but for those at the places ``keep``."""
        if keep is None:
            self.at: dict[str, int] = {}
            self.rows = np.zeros((0, len(self.model.languages)))
        else:
            new = np.full(len(self.rows), -1)
            new[keep] = np.arange(len(keep))
            self.at = {w: n for w, n in zip(self.at, new.tolist()) if n >= 0}
            self.rows = self.rows[keep]
        self.used = np.zeros(len(self.rows), np.int64)

    def learn(self, words: list[str]) -> None:
        rows = np.zeros((len(words), len(self.model.languages)))
        for places, group in by_length([MARK + w for w in words]):
            rows[places] = Lattice(self.index, group, self.longest).log_words(self.model.probs)
        self.at.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.rows = np.concatenate([self.rows, rows])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        if len(self.at) > WORDS:  # most words never return
            keep = np.flatnonzero(self.used > 1)
            self.forget(keep if len(keep) <= WORDS // 2 else None)
        cut = [marked_words(t) for t in texts]
        flat = [w for words in cut for w in words]
        codes = np.fromiter(map(self.at.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = [flat[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            codes[missing] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        self.used += np.bincount(codes, minlength=len(self.used))
        sizes = np.array([len(words) for words in cut])
        total = np.tile(self.model.priors, (len(texts), 1))
        full = np.flatnonzero(sizes)
        if len(full):
            begins = (np.cumsum(sizes) - sizes)[full]
            total[full] += np.add.reduceat(self.rows[codes], begins, axis=0)
        best = total.argmax(axis=1)
        top = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)]
        return names, np.where(sizes > 0, top, 0.0)


def train(labelled: DataFrame, vocabulary: str | None = None, per_language: int = PER_LANGUAGE,
          rounds: int = ROUNDS) -> Model | None:
    """Fit on ``labelled`` (doc_id, text, lang); None without labelled rows."""
    common.small_batches(labelled.sparkSession)
    pieces = read_pieces(common.file_bytes(vocabulary or public_tokenizers.path(VOCABULARY)))
    rows = labelled.filter(F.col("lang").isNotNull()).select(
        "doc_id", "text", F.col("lang").alias("_lang"), F.xxhash64(common.text_or_empty()).alias("_mark"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    # The smallest hashes of each language: hashes under a bound that leaves about twice as many
    # rows as wanted, so that few rows meet in a language's window whatever the corpus.
    smallest = Window.partitionBy("_lang").orderBy("_hash", "doc_id", "_mark")
    bound = F.create_map(*[x for lang, n in counts.items() for x in (
        F.lit(lang), F.lit(min(1 << 31, (2 * per_language + 100) * (1 << 31) // n)))])
    ids = (rows.select("doc_id", "_lang", "_mark", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("_hash"))
           .filter(F.col("_hash") <= bound[F.col("_lang")])
           .withColumn("_k", F.row_number().over(smallest)).filter(F.col("_k") <= per_language)
           .select("doc_id", "_lang", "_mark").distinct())
    # Of repeated rows one counts, so a language's sample is as small as it says.
    sample = rows.join(F.broadcast(ids), ["doc_id", "_lang", "_mark"]).dropDuplicates(
        ["doc_id", "_lang", "_mark"]).select("_lang", "text")

    def count_words(batches):
        seen: dict[str, Counter] = {}
        for batch in common.slices(batches, "text"):
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(marked_words(text or ""))
        rows = [(lang, word, n) for lang, words in seen.items() for word, n in words.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                          pa.array(columns[2], pa.int64())], ["_lang", "word", "n"])

    words = common.stage(sample.mapInArrow(count_words, "_lang string, word string, n long")
                         .groupBy("_lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    probs = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        tasks = np.vstack([probs, np.zeros((1, len(languages)))])

        def expect(batches):
            index = {p: i for i, p in enumerate(pieces)}
            longest = max(map(len, pieces), default=1)
            total = np.zeros((len(pieces) + 1, len(languages)))
            for batch in batches:
                lang = np.array([languages.index(x) for x in batch.column("_lang").to_pylist()])
                text = batch.column("word").to_pylist()
                n = batch.column("n").to_numpy()
                for of in range(len(languages)):
                    mine = np.flatnonzero(lang == of)
                    for places, group in by_length([MARK + text[i] for i in mine]):
                        found = Lattice(index, group, longest).expected(tasks[:, of:of + 1], n[mine[places]].astype(float))
                        total[:, of] += found[:-1]
            piece, of = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(of), pa.array(total[piece, of])],
                                             ["piece", "of", "n"])

        found = (words.mapInArrow(expect, "piece long, of long, n double")
                 .groupBy("piece", "of").agg(F.sum("n").alias("n")).toArrow())  # pieces x languages rows at most
        new = np.full_like(probs, SMOOTH)
        new[found["piece"].to_numpy(), found["of"].to_numpy()] += found["n"].to_numpy()
        probs = new / new.sum(axis=0)
    priors = np.array([counts[x] + 1.0 for x in languages])
    return Model(pieces, languages, np.log(priors / priors.sum()), probs)


def predict(docs: DataFrame, model: Model | None, text: str = "text", drop: tuple = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with lang_pred and score; the text is the only input."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", *drop)]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in rest], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        scorer = model.scorer()
        for batch in common.slices(batches, text):
            names, score = scorer.score([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names, pa.string()),
                                              pa.array(score)], [*rest, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rest, text])]).mapInArrow(
        run, T.StructType([*(docs.schema[c] for c in rest), *fields]))


def learn_from(docs: DataFrame) -> Model | None:
    """The model of the labelled documents that are not held out."""
    return train(docs.filter(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), learn_from(docs)).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: Model | None, score: float) -> DataFrame:
    """``docs`` whose text has a language with that posterior or more, columns unchanged."""
    packed = docs.select(common.pack_row(docs), common.text_or_empty().alias("_text"))
    told = predict(packed, model, "_text", drop=("_text",))
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= score)).select("_row.*")
