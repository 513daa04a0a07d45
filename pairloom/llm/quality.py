"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text on one figure of it. Rules are tried in turn and the first that rejects
ends the work on that text, so the order decides the cost but never the verdict: each rule is
timed and counted on a bounded sample (``SAMPLE`` rows of at most ``SAMPLE_CHARS``
characters, used for the order alone), and rules
with more rejections per second go first.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return. Null text has no words and fails the base rules. Repeated rows are judged
alike; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import common

SAMPLE, SAMPLE_CHARS = 500, 20_000
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Distinct repeated windows up to which a list is searched; beyond it positions are sorted.
FEW = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def n_words(words: Column, text: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column, text: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(words: Column, text: Column) -> Column:
    rest = text
    for symbol in SYMBOLS:
        rest = F.replace(rest, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def n_bangs(words: Column, text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def n_lines(words: Column, text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(words: Column, text: Column) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, text: Column) -> Column:
    """Words in windows of three words that the text has twice or more.

    Windows are 64-bit hashes; sorted, equal ones are neighbours. With few repeated windows
    each window looks itself up in their list, otherwise hashes are sorted with their places.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2),
                           lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))

    def looked_up(h: Column, twice: Column, w: Column) -> Column:
        def covered(m: Column) -> Column:
            def hit(i: Column, back: int) -> Column:
                return F.coalesce(F.get(m, i - back), F.lit(False))

            return F.size(F.filter(w, lambda x, i: hit(i, 0) | hit(i, 1) | hit(i, 2)))

        return let(F.transform(h, lambda x: F.array_contains(twice, x)), covered)

    def sorted_places(h: Column) -> Column:
        def covered(s: Column) -> Column:
            mine = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(
                mine, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))
        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), covered)

    def count(w: Column) -> Column:
        return let(windows(w), lambda h: let(let(F.sort_array(h), repeated), lambda twice: (
            F.when(F.size(twice) == 0, 0).when(F.size(twice) <= FEW, looked_up(h, twice, w))
            .otherwise(sorted_places(h)))))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, count)).cast("long")


METRICS = {f.__name__: f for f in (
    n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words)}

#: Rule: what it rejects, from the figures it asks for.
BASE = {
    "few_words": lambda m: m("n_words") < 50,
    "repeated_words": lambda m: m("n_repeat_words") * 100 > m("n_words") * 50,
}
RULES = BASE | {
    "symbols": lambda m: m("n_symbols") * 10 > m("n_words"),
    "exclamations": lambda m: m("n_bangs") * 2 > m("n_words"),
    "duplicate_lines": lambda m: (m("n_dup_lines") >= 3) & (m("n_dup_lines") * 100 > m("n_lines") * 30),
    "word_length": lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 15),
}


def from_text(words: Column, text: Column) -> Callable[[str], Column]:
    """Figures worked out when a rule asks for them."""
    return lambda name: METRICS[name](words, text)


def rule_order(docs: DataFrame, text: str = "text", rules: dict = RULES, sample: int = SAMPLE) -> list[str]:
    """Rule names by rejections per second on ``sample`` rows, the best first.

    The figures are times, so the order can differ between runs; verdicts do not depend on it.
    """
    texts = docs.select(common.text_or_empty(text).alias("_text"))
    rows = texts.filter(F.length("_text") <= SAMPLE_CHARS).take(sample)  # reads as few files as it needs
    part = docs.sparkSession.createDataFrame(rows, "_text string").select(
        "_text", words_of(F.col("_text")).alias("_words"))
    metric = from_text(F.col("_words"), F.col("_text"))
    part.select(F.max(F.size("_words")), F.max(F.length("_text"))).collect()  # reads and compiles once
    figures = {}
    for name, rule in rules.items():
        start = time.perf_counter()
        row = part.agg(F.count("*").alias("n"), F.count_if(rule(metric)).alias("hits")).first()
        cost = time.perf_counter() - start
        figures[name] = (row["hits"] + 0.5) / (row["n"] + 1) / max(cost, 1e-6)
    return sorted(rules, key=lambda name: -figures[name])


def rejected_by(metric: Callable[[str], Column], order: list[str], rules: dict = RULES) -> Column:
    """Name of the first rule in ``order`` that rejects, null if none does."""
    out = F
    for name in order:
        out = out.when(rules[name](metric), F.lit(name))
    return out


def keep(docs: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """``docs`` that pass all rules, columns unchanged: the cascade over the whole texts."""
    order = rule_order(docs, text, rules)
    body = common.text_or_empty(text)
    passed = let(body, lambda t: let(words_of(t), lambda w: rejected_by(from_text(w, t), order, rules).isNull()))
    return docs.filter(passed)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every figure as a column."""
    rows = docs.select(common.pack_row(docs), common.text_or_empty(text).alias("_text"))
    rows = rows.select("_row", "_text", words_of(F.col("_text")).alias("_words"))
    return rows.select("_row", *(f(F.col("_words"), F.col("_text")).alias(k) for k, f in METRICS.items()))


def query(spark, sf_dir: str) -> DataFrame:
    """Base figures and the verdict of every document."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    order = rule_order(docs)
    rows = measure(docs)
    base = rejected_by(F.col, list(BASE)).isNotNull()
    return rows.select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & rejected_by(F.col, order).isNull()).alias("kept"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i:
           struct_pack(i := i, a := w[i], b := w[i + 1], c := w[i + 2]))) AS x
  FROM d),
r AS (SELECT doc_id, x.i AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x.a, x.b, x.c) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_bangs > n_words OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""
