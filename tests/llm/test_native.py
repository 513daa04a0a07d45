"""Operators in DataFrame functions: quality cascade, chat formatting, line and exact dedup."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.llm import chat, exact, line_dedup, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_bangs": text.count("!"), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    made = [None, "", " \t\n", "one", "a b c a b c", "x y z\n\n#*", "ß|ü " * 60, "w " * 5000]
    for vocabulary, n in ((3, 40), (12, 300), (400, 900), (5000, 300)):
        for _ in range(6):
            made.append("".join(f"w{draw.randrange(vocabulary)}" + draw.choice([" ", " ", "\n", "!\t", "  "])
                                for _ in range(n)))
    return made


def frame(spark, texts):
    rows = [(i, t, "mine", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, _text int").repartition(3)


def test_quality_figures_equal_brute_force(spark, texts):
    rows = quality.measure(frame(spark, texts)).select("_row.doc_id", *quality.METRICS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.asDict() == {"doc_id": r["doc_id"], **brute_figures(texts[r["doc_id"]] or "")}


def test_cascade_keeps_the_same_rows_in_any_order(spark, texts):
    docs = frame(spark, texts)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"] for r in kept.collect()}
    want = set()
    for i, t in enumerate(texts):
        m = brute_figures(t or "")
        if not any((m["n_words"] < 50, m["n_repeat_words"] * 2 > m["n_words"], m["n_symbols"] * 10 > m["n_words"],
                    m["n_bangs"] * 2 > m["n_words"], m["n_dup_lines"] >= 3 and m["n_dup_lines"] * 10 > m["n_lines"] * 3,
                    not m["n_words"] * 2 <= m["word_chars"] <= m["n_words"] * 15)):
            want.add(i)
    assert got == want and want
    order = quality.rule_order(docs, sample=5)
    assert sorted(order) == sorted(quality.RULES)
    names = list(quality.RULES)
    for order in (names, names[::-1]):
        metric = quality.from_text(quality.words_of(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")))
        passed = docs.filter(quality.rejected_by(metric, order).isNull())
        assert {r["doc_id"] for r in passed.collect()} == want


def test_quality_of_an_empty_table(spark, texts):
    assert quality.keep(frame(spark, texts).limit(0)).count() == 0


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, legal string")


def test_chat_round_trip_and_machine(spark):
    hard = r"\### <turn user> \l \b\g </turn> ok" + "\n>\\"
    data = talk(spark, [
        (1, 0, "system", "be kind"), (1, 1, "user", hard), (1, 2, "assistant", hard), (2, 0, "assistant", "hi"),
        (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, "user", "q"), (4, 1, "user", "q"), (5, 0, None, "n"),
        (6, 0, "user", "a"), (6, 1, "assistant", "b"), (6, 1, "assistant", "b"), (None, 0, "user", "lost"),
        (7, 1, "assistant", "late"), (7, 0, "user", "early"), (8, 0, "us<er>\\", "odd role")])
    rows = chat.format_turns(data).select(
        "conv_id", "legal", chat.formatted(F.col("segments")).alias("text"),
        chat.read_turns(chat.formatted(F.col("segments"))).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss")).collect()
    got = {r["conv_id"]: r for r in rows}
    assert {k: r["legal"] for k, r in got.items()} == {
        1: True, 2: False, 3: True, 4: False, 5: False, 6: False, None: False, 7: True, 8: False}
    plain = {k: [tuple(t) for t in r["turns"]] for k, r in got.items()}
    assert plain[1] == [("system", "be kind"), ("user", hard), ("assistant", hard)]
    assert plain[3] == [("user", ""), ("assistant", "")] and plain[5] == [("", "n")]
    assert plain[7] == [("user", "early"), ("assistant", "late")] and plain[8] == [("us<er>\\", "odd role")]
    assert got[1]["loss"] == hard and got[6]["loss"] == "bb" and got[4]["loss"] == ""
    assert got[2]["text"] == "<turn assistant>\nhi</turn>\n"
    assert chat.format_turns(data.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for i in range(60):
        lines = [f"<p>own {i} {k}</p>" for k in range(3)] + [f"<li>menu {draw.randrange(3)}</li>", "<div>footer</div>"]
        draw.shuffle(lines)
        rows.append((i, f"http://{draw.choice('Aab')}.example/x{i}", "".join(lines) + "<script>var footer;</script>"))
    rows += [(60, None, None), (61, None, "<p>footer"), (62, "http://a.example/", ""), (5, *rows[5][1:])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")

    def lines_of(html):
        plain = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", "\n", html or "")
        return [x.strip(quality.BLANKS) for x in plain.split("\n") if x.strip(quality.BLANKS)]

    host = [((re.match(r"^\w+://([^/?#]*)", r[1] or "") or [0, ""])[1]).lower() for r in rows]
    pages_of = Counter(host)
    seen = Counter((h, x) for h, r in zip(host, rows) for x in set(lines_of(r[2])))
    want = []
    for h, r in zip(host, rows):
        stay = [x for x in lines_of(r[2]) if not (seen[h, x] >= 2 and seen[h, x] > 0.3 * pages_of[h])]
        want.append((r[0], len(lines_of(r[2])), len(lines_of(r[2])) - len(stay), "\n".join(stay)))
    got = [tuple(r) for r in line_dedup.clean_pages(pages).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 50
    assert line_dedup.clean_pages(pages.limit(0)).count() == 0


def test_exact_dedup_equals_brute_force(spark):
    draw = random.Random(6)
    head = "h" * exact.PREFIX
    pool = ["", None, "a", "b", head + "x", head + "y", head + "z" * 500, "é", "e"]
    rows = [(i, draw.choice(pool), "x", i) for i in range(200)] + [(300, "only", "x", 0), (7, "again", "x", 0)]
    rows += [(7, "again", "y", 1), (None, "null id", "x", 0), (None, "null id", "x", 0), (1, "null id", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _uid int").repartition(4)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = exact.duplicates(docs, digest=True).collect()
    assert len(got) == len(rows)
    for text, ids in groups.items():
        import hashlib

        mine = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r["keep_id"] for r in mine} == {keep}
        assert {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [keep]
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted(groups)
    assert exact.duplicates(docs.limit(0)).count() == 0 and exact.keep_one(docs.limit(0)).count() == 0
